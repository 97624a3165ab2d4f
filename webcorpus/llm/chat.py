"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees. Iterative self-joins double the distance each message sees towards its
root, so a path of n messages takes log2(n) joins, each spread by (tree, message). Leaves
are ranked by the sum of scores on their path; each chosen path becomes one text whose
template marks turns and escapes its control strings, plus the spans to learn from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.plans.storage import stage

#: Control characters and what stands for them inside texts and roles. In an escaped text
#: every backslash begins such a pair, so the replacements can be undone one by one.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]
OPEN, OPENED, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def _key(column: Column) -> Column:
    """A join key that holds NULL as a value of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def chains(rows: DataFrame) -> DataFrame:
    """Messages of a table `(conv_id, turn, role, text)`: each replies to the one before.

    Turns are taken in the order (turn, role, text), NULL first: equal turn numbers and
    repeated rows stay, side by side. Rows without `conv_id` form one conversation. A NULL
    text or role is empty. Columns: `(tree, conv_id, id, parent, role, text, score)`.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn(
        "id", F.row_number().over(order).cast("long")
    )
    return numbered.select(
        _key(F.col("conv_id")).alias("tree"),
        "conv_id",
        "id",
        F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(0.0).alias("score"),
    )


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Root-to-leaf paths: `(tree, leaf, rank, pos, id)`, one row per message of a path.

    `messages` has `(tree, id, parent, score)`, unique by (tree, id). The `branches` leaves
    with the highest sum of scores on their path are kept per tree (ties: smaller leaf id),
    all with None. A message whose parent is absent is a root; NULL scores count as 0.
    Messages on a cycle have no root and are on no path.
    """
    nodes = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    step = stage(
        nodes.join(known, ["tree", "parent"], "left").select(
            "tree", "id", F.when(F.col("known"), F.col("parent")).alias("up"), "score",
            F.lit(1).cast("long").alias("seen"),
        ),
        "reply-steps-0",
    )
    steps = [step]
    reached = step.where(F.col("up").isNotNull()).count()
    depth_bound = max(1, step.count()).bit_length()
    while reached and len(steps) <= depth_bound:
        further = step.select(
            "tree", F.col("id").alias("up"), F.col("up").alias("__up"),
            F.col("score").alias("__score"), F.col("seen").alias("__seen"),
        )
        joined = step.where(F.col("up").isNotNull()).join(further, ["tree", "up"]).select(
            "tree", "id", F.col("__up").alias("up"),
            (F.col("score") + F.col("__score")).alias("score"),
            (F.col("seen") + F.col("__seen")).alias("seen"),
        )
        step = stage(
            joined.unionByName(step.where(F.col("up").isNull())), f"reply-steps-{len(steps)}"
        )
        steps.append(step)
        reached = step.where(F.col("up").isNotNull()).count()
    inner = steps[0].where(F.col("up").isNotNull()).select("tree", F.col("up").alias("id")).distinct()
    leaves = step.where(F.col("up").isNull()).join(inner, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "id")
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        leaves = leaves.where(F.col("rank") <= branches)
    found = leaves.select(
        "tree", F.col("id").alias("leaf"), "rank", "id", F.col("seen").alias("pos")
    )
    for k, jump in enumerate(steps):
        ahead = found.where(F.col("pos") > 1).join(
            # a message with fewer than 2**k above it has nothing at that distance
            jump.where(F.col("up").isNotNull()).select("tree", "id", "up"), ["tree", "id"]
        )
        found = stage(
            found.unionByName(
                ahead.select(
                    "tree", "leaf", "rank", F.col("up").alias("id"),
                    (F.col("pos") - (1 << k)).alias("pos"),
                )
            ),
            f"reply-paths-{k}",
        )
    return found


def format_paths(path_rows: DataFrame, messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One conversation per path: `(tree, leaf, rank, conversation, loss_spans)`.

    A turn is `<turn ROLE>`, its text and `</turn>`, each on lines of their own. `loss_spans`
    are (start, length) in code points of the texts whose role is `loss_role`.
    """
    turns = path_rows.join(messages.select("tree", "id", "role", "text"), ["tree", "id"])
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(OPENED))
    body = escape(F.col("text"))
    turns = turns.select(
        "tree", "leaf", "rank", "pos", head.alias("head"), body.alias("body"),
        (F.col("role") == loss_role).alias("learn"),
    ).withColumn("chars", F.length("head") + F.length("body") + len(CLOSE))
    before = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    one = F.struct(
        "pos",
        F.concat("head", "body", F.lit(CLOSE)).alias("turn"),
        F.when(
            F.col("learn"),
            F.struct((F.col("start") + F.length("head")).alias("start"), F.length("body").alias("length")),
        ).alias("span"),
    )
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return whole.select(
        "tree", "leaf", "rank",
        F.array_join(F.col("turns.turn"), "").alias("conversation"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(conversation: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    blocks = F.filter(F.split(conversation, CLOSE), lambda b: b != "")

    def turn(block: Column) -> Column:
        head = F.substring_index(block, OPENED, 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(block, F.length(head) + len(OPENED) + 1)).alias("text"),
        )

    return F.transform(blocks, turn)


def read_loss(conversation: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, in order, unescaped.

    Spans are cut from a form of fixed width, so each costs its own length only.
    """
    wide = F.encode(conversation, "UTF-32")
    cut = F.transform(
        loss_spans,
        lambda s: F.decode(
            F.substr(wide, (s["start"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int")), "UTF-32"
        ),
    )
    return unescape(F.array_join(cut, ""))


def op10_chat_formatting(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    messages = stage(chains(rows.unionByName(planted)), "chat-messages")
    texts = format_paths(paths(messages), messages)
    names = messages.where(F.col("id") == 1).select("tree", "conv_id")
    read = texts.join(names, "tree").select(
        "conv_id", "conversation",
        read_turns(F.col("conversation")).alias("turns"),
        read_loss(F.col("conversation"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("conversation").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'))
          + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g')) + 16 AS chars
  FROM rows
)
SELECT CAST(conv_id AS BIGINT) AS conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
