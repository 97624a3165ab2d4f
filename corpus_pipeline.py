"""From raw documents to token ids: five stages, each written and read again by the next.

A stage is `(spark, docs, sf_dir) -> DataFrame` over all rows its predecessor kept, whatever
columns `docs` has besides `doc_id` and `text`; all but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.llm import bpe, decontaminate, jaccard, line_dedup, quality
from webcorpus.plans.storage import stage

#: Documents below this probability of good quality are rejected, as by op9.
LEAST_QUALITY = 0.7


def _counted(docs: DataFrame) -> DataFrame:
    """`n_chars`, where the table has it, of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier finds bad. It learns from the labelled rows whose
    crc32 modulo 4 is not 2. A document without text gets the score of an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    network = quality.learn(docs, labels, quality.remainder(F.col("doc_id"), 4) != 2)
    scored = quality.score(docs, network, docs.columns)
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks of lines that an earlier document has. A document all of whose lines
    are deleted goes; one that had none stays. Other texts are unchanged, NULL ones NULL."""
    found = line_dedup.without_repeated_lines(docs, docs.columns)
    found = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return _counted(found.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))


def one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return jaccard.one_of_each(docs)


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts."""
    return _counted(decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`(doc_id, n_tokens, ids, decoded)`; ids are packed as little-endian 32-bit integers."""
    encoded = bpe.encode_documents(docs, bpe.default_path())
    return encoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", unrepeated_lines),
    ("n-gram Jaccard join", one_near_duplicate),
    ("benchmark decontamination", no_benchmark_passages),
    ("BPE encoding and decoding", token_ids),
]

#: Patience diff, components and merges are not for SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, function) in enumerate(STAGES):
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
