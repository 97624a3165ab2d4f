"""Joins under a hot key."""

from pyspark.sql import functions as F

from webcorpus.plans import skew


def _tables(spark):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key")
    )
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(40)]], "key string, v int")
    return left, right


def test_same_result_as_a_plain_join(spark):
    left, right = _tables(spark)
    for how in ("left", "inner", "left_anti", "left_semi"):
        plain = sorted(left.join(right, "key", how).collect(), key=str)
        salted = skew.salted_join(left, right, "key", ["id"], how, hot_rows=100)
        small = skew.lookup_join(left, right, "key", ["id"], how)
        assert sorted(salted.select(*left.join(right, "key", how).columns).collect(), key=str) == plain
        assert sorted(small.collect(), key=str) == plain


def test_hot_key_is_split(spark):
    left, _ = _tables(spark)
    (row,) = skew.hot_keys(left, "key", 100).collect()
    (name,) = spark.createDataFrame([("hot",)], "k string").select(F.xxhash64("k")).first()
    assert (row["__hash"], row["__groups"]) == (name, 10)


def test_broadcast_depends_on_measured_size(spark):
    left, right = _tables(spark)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(skew.lookup_join(left, right, "key", ["id"]))
    assert "__salt" in plan(skew.lookup_join(left, right, "key", ["id"], broadcast_bytes=100))
    assert skew.measured_bytes(right.where("false")) == 0
