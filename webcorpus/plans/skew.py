"""Joins that stay balanced when one key holds a large share of the rows.

A side is broadcast only after its size has been measured. Above the bound the join is
a shuffle in which each hot key is split into salted groups of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest side that is broadcast, in bytes of its JSON form.
BROADCAST_BYTES = 64 << 20
#: Rows of one key that one task may receive.
HOT_ROWS = 1_000_000
#: Bits of the bitmap that stands for a set of keys: 16 MB.
BITMAP_BITS = 1 << 27
#: Groups the rows with a NULL key are spread over; they match nothing anyway.
NULL_GROUPS = 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows, by one aggregate over the table."""
    row_bytes = F.octet_length(F.to_json(F.struct(*df.columns))) + F.lit(32)
    return df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("n")).first()["n"]


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The same rows, marked for a broadcast if they measure small."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hashes of the keys with at least `hot_rows` rows, and the number of groups each is
    split into.

    There are at most rows / hot_rows of them, of 12 bytes each whatever the keys are, so
    the result can be broadcast. Keys of one hash are split alike on both sides.
    """
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.xxhash64(key).alias("__hash"))
        .agg(F.count(F.lit(1)).alias("__rows"))
        .where(F.col("__rows") >= hot_rows)
        .select("__hash", F.ceil(F.col("__rows") / hot_rows).cast("int").alias("__groups"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shuffle join; the left rows of a hot key go to several groups by a hash of the
    `spread` columns, and the matching right rows are repeated once per group."""
    hot = F.broadcast(hot_keys(left, key, hot_rows))
    groups = F.coalesce(F.col("__groups"), F.lit(1))
    salt = F.pmod(
        F.xxhash64(*spread), F.when(F.col(key).isNull(), NULL_GROUPS).otherwise(groups)
    ).cast("int")
    marked_left, marked_right = (
        side.withColumn("__hash", F.xxhash64(key)).join(hot, "__hash", "left").drop("__hash")
        for side in (left, right)
    )
    salted_left = marked_left.withColumn("__salt", salt).drop("__groups")
    salted_right = marked_right.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), groups - 1))
    ).drop("__groups")
    return salted_left.join(salted_right, [key, "__salt"], how).drop("__salt")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: list[str],
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a lookup table: broadcast if it measures small, else salted shuffle."""
    if measured_bytes(right) <= broadcast_bytes:
        return left.join(F.broadcast(right), key, how)
    return salted_join(left, right, key, spread, how, hot_rows)


def likely_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in `keys`, and few others, without a shuffle of `df`. NULL keys
    are left out."""
    return with_likely(df, keys, key, "__likely").where("__likely").drop("__likely")


def with_likely(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Adds `name`: true for the rows whose key is in `keys`, and few others, never for NULL.

    Keys are hashed to the bits of one bitmap, which is broadcast in pieces of 4 KB and has
    16 MB at most, however many keys there are. `df` is not shuffled.
    """
    def bit(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))

    pieces = (
        keys.where(F.col(key).isNotNull())
        .select(bit(key).alias("__bit"))
        .groupBy(F.bitmap_bucket_number("__bit").alias("__piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__bits"))
    )
    marked = df.withColumn("__piece", F.bitmap_bucket_number(bit(key)))
    place = F.bitmap_bit_position(bit(key))
    byte = F.conv(F.hex(F.substr("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.expr("shiftright(__byte, __shift) % 2 = 1"), F.lit(False))
    return (
        marked.join(F.broadcast(pieces), "__piece", "left")
        .withColumns({"__byte": byte, "__shift": (place % 8).cast("int")})
        .select(*df.columns, (is_set & F.col(key).isNotNull()).alias(name))
    )
