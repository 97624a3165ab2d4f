"""The registered queries of this subpackage and their SQL, where SQL can say them."""

from __future__ import annotations

from webcorpus.llm import (
    bpe, chat, codes, decontaminate, jaccard, line_dedup, lm, quality, revisits, rules, substrings, topk, trie,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_lm_score": lm.op2_lm_score,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_topk": topk.op5_topk,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_revisits": revisits.op7_revisits,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality": quality.op9_quality,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_quality_rules": rules.op13_quality_rules,
}

ORACLES = {
    "op5_topk": topk.OP5_SQL,
    "op7_revisits": revisits.OP7_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op12_vector_codes": codes.OP12_SQL,
    "op13_quality_rules": rules.OP13_SQL,
}
