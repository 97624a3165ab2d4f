"""Quality rules of documents and of their hosts, with DataFrame functions only.

A document fails rules of its own. Failures are counted per host and rule, the host's rates
are shrunk towards the rate of all hosts by a beta prior that is fitted to how much hosts
differ, and a host whose shrunk rate of some rule is too high takes its documents along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.spaced import WORD, words_of
from webcorpus.plans.skew import lookup_join
from webcorpus.plans.storage import stage

#: Words of a window that may repeat.
WINDOW = 8
#: Fixed value: the characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: A host goes if its shrunk rate of any rule is above this.
MOST = 0.5
#: Documents the prior counts for: bounds, and the value where hosts can't be compared.
LEAST_STRENGTH, USUAL_STRENGTH, MOST_STRENGTH = 4.0, 10.0, 1000.0
#: Rule by name: a document fails it where this holds.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
#: The rules that reject a document by itself.
OWN_RULES = ["few_words", "repeated_words"]


def _repeated(found: Column) -> Column:
    """Words inside the windows that start at the ascending positions `found`."""
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    step = lambda s, i: F.struct(
        i.alias("last"), (s["total"] + F.least(F.lit(WINDOW), i - s["last"])).alias("total")
    )
    # each window adds what it has beyond the one before
    return F.aggregate(found, start, step, lambda s: s["total"])


def measured(docs: DataFrame, keep: list[Column], column: str = "text") -> DataFrame:
    """The `keep` columns and, of every whole text: `n_words`, `word_chars` (code points in
    words), `n_symbols`, `n_lines` (with a word), `n_dup_lines` (equal to an earlier one) and
    `n_repeat_words` (inside windows of 8 words that occur twice or more).

    A NULL text has no words. Windows are told apart by their 64-bit hash. Every step is a
    projection, so a text is never shuffled; the windows of a text are sorted only if some
    two are alike.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    rows = docs.select(F.struct(F.lit(0).alias("__"), *keep).alias("row"), text.alias("text"), words_of(text).alias("words"))
    last = F.size("words") - (WINDOW - 1)
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    rows = rows.select(
        "row", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(last > 0, windows).alias("windows"),
    )
    paired = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.select(
        "row", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(paired)).alias("ordered"),
    )
    same = lambda e, i: F.get("ordered", i)["h"] == e["h"]
    alike = F.filter("ordered", lambda e, i: F.coalesce(same(e, i - 1), F.lit(False)) | F.coalesce(same(e, i + 1), F.lit(False)))
    found = F.array_sort(F.transform(alike, lambda e: e["i"]))
    return rows.withColumn(
        "n_repeat_words", F.when(F.col("ordered").isNull(), 0).otherwise(_repeated(found)).cast("long")
    ).drop("ordered")


def host_verdicts(failures: DataFrame, rules: list[str]) -> DataFrame:
    """`(host, n, rate_RULE..., rejected)` of every host of a table `(host, RULE...)`.

    `rejected` is whether a shrunk rate is above `MOST`. Rows without host count for none.
    The prior of a rule is Beta(m * s, (1 - m) * s): m is the rate of all documents, and
    1 / (s + 1) the share of variance that lies between hosts (analysis of variance), with s
    from 4 to 1000; 10 where there is one host or no host has two documents.
    """
    counted = failures.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r)).alias(r) for r in rules]
    )
    hosts = stage(counted, "rules-hosts")
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("nn")]
    for r in rules:
        f = F.col(r).cast("double")
        sums += [F.sum(f).alias(f"f_{r}"), F.sum(f * f / F.col("n")).alias(f"ff_{r}")]
    # one row, however many hosts there are
    total = hosts.agg(*sums).first()
    shrunk = {}
    for r in rules:
        mean, strength = _prior(total["hosts"], total["n"] or 0.0, total["nn"] or 0.0, total[f"f_{r}"] or 0.0, total[f"ff_{r}"] or 0.0)
        shrunk[f"rate_{r}"] = (F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    rejected = reduce(lambda a, b: a | b, [F.col(name) > MOST for name in shrunk])
    return hosts.withColumns(shrunk).select("host", "n", *shrunk).withColumn("rejected", rejected)


def _prior(hosts: int, n: float, nn: float, f: float, ff: float) -> tuple[float, float]:
    """Mean and strength of the beta prior, from sums over hosts of documents n, n * n,
    failures f and f * f / n."""
    if not n:
        return 0.0, USUAL_STRENGTH
    mean = f / n
    if hosts < 2 or n <= hosts or not 0 < mean < 1:
        return mean, USUAL_STRENGTH
    between, inside = (ff - f * mean) / (hosts - 1), (f - ff) / (n - hosts)
    size = (n - nn / n) / (hosts - 1)
    spread = between + (size - 1) * inside
    share = (between - inside) / spread if spread > 0 else 1.0
    strength = 1 / share - 1 if share > 0 else MOST_STRENGTH
    return mean, min(max(strength, LEAST_STRENGTH), MOST_STRENGTH)


def judged(docs: DataFrame, keep: list[Column], host: Column, column: str = "text") -> DataFrame:
    """What `measured` gives, `base_failed` (an own rule), `host_rejected` and `kept` (neither).

    Documents without host stand for themselves. Repeated rows count each.
    """
    flags = {r: F.coalesce(F.expr(rule), F.lit(False)) for r, rule in RULES.items()}
    rows = measured(docs, [*keep, host.alias("__host")], column).withColumns(flags)
    rows = stage(rows.withColumn("host", F.col("row.__host")), "rules-measured")
    bad = host_verdicts(rows.select("host", *RULES), list(RULES)).where("rejected").select("host", "rejected")
    rows = rows.withColumn("base_failed", reduce(lambda a, b: a | b, [F.col(r) for r in OWN_RULES]))
    joined = lookup_join(rows, bad, "host", ["row", "n_words"]).withColumn("host_rejected", F.coalesce("rejected", F.lit(False)))
    return joined.drop("rejected").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op13_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, [F.col("doc_id")], F.col("source")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), tokens AS (
  SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs
), starts AS (
  SELECT rid, i, w, lead(w, 1) OVER q AS w1, lead(w, 2) OVER q AS w2, lead(w, 3) OVER q AS w3, lead(w, 4) OVER q AS w4,
         lead(w, 5) OVER q AS w5, lead(w, 6) OVER q AS w6, lead(w, 7) OVER q AS w7
  FROM tokens WINDOW q AS (PARTITION BY rid ORDER BY i)
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w1, w2, w3, w4, w5, w6, w7) AS n FROM starts WHERE w7 IS NOT NULL
), gaps AS (
  SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS fresh FROM windows WHERE n > 1
), repeats AS (
  SELECT rid, CAST(sum(fresh) AS BIGINT) AS n_repeat_words FROM gaps GROUP BY rid
), lined AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
), base AS (
  SELECT d.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs d JOIN lined USING (rid) LEFT JOIN repeats USING (rid)
), fails AS (
  SELECT rid, source, unnest([1, 2, 3, 4, 5]) AS rule,
         CAST(unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 100 * n_dup_lines > 30 * n_lines, 10 * n_symbols > n_words,
                 word_chars < 2 * n_words OR word_chars > 15 * n_words]) AS DOUBLE) AS failed
  FROM base
), hosts AS (
  SELECT rule, source, CAST(count(*) AS DOUBLE) AS n, sum(failed) AS f FROM fails WHERE source IS NOT NULL GROUP BY rule, source
), sums AS (
  SELECT rule, count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS m, sum(f) AS f, sum(n) - sum(n * n) / sum(n) AS spare, sum(f * f / n) AS ff
  FROM hosts GROUP BY rule
), parts AS (
  SELECT *, (ff - f * m) / nullif(k - 1, 0) AS between_hosts, (f - ff) / nullif(n - k, 0) AS inside FROM sums
), priors AS (
  SELECT rule, m, CASE WHEN k < 2 OR n <= k OR m <= 0 OR m >= 1 THEN 10
       WHEN between_hosts <= inside THEN 1000
       ELSE least(1000, greatest(4, (between_hosts + (spare / (k - 1) - 1) * inside) / (between_hosts - inside) - 1)) END AS s
  FROM parts
), bad AS (
  SELECT DISTINCT source FROM hosts h JOIN priors p USING (rule) WHERE (h.f + p.m * p.s) / (h.n + p.s) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM base
"""
