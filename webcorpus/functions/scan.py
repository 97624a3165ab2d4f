"""Running folds over arrays: every element's output depends on the state left by those before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions.binding import let


def scan(
    items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str
) -> Column:
    """The array of outputs of `step(state, item) -> (state, output)`, from the first item on.

    A fold that appends to one array copies it at every item. Here items are folded in blocks
    of about the square root of their number, so n of them cost about n ** 1.5 small copies.
    """
    def appended(held: Column, item: Column) -> Column:
        state, out = step(held["state"], item)
        done = F.struct(state.alias("state"), out.alias("out"))
        return let(done, lambda d: F.struct(
            d["state"].alias("state"), F.concat(held["out"], F.array(d["out"])).alias("out")
        ))

    def block(held: Column, part: Column) -> Column:
        first = F.struct(held["state"].alias("state"), F.array().cast(f"array<{out_type}>").alias("out"))
        done = F.aggregate(part, first, appended)
        return let(done, lambda d: F.struct(
            d["state"].alias("state"), F.concat(held["blocks"], F.array(d["out"])).alias("blocks")
        ))

    def whole(bound: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(bound))).cast("int"))
        count = F.ceil(F.size(bound) / size).cast("int")
        parts = F.transform(F.sequence(F.lit(1), count), lambda b: F.slice(bound, (b - 1) * size + 1, size))
        nothing = F.array().cast(f"array<array<{out_type}>>")
        begin = F.struct(start.alias("state"), nothing.alias("blocks"))
        folded = F.aggregate(parts, begin, block, lambda held: F.flatten(held["blocks"]))
        return F.when(F.size(bound) > 0, folded).otherwise(F.array().cast(f"array<{out_type}>"))

    return let(items, whole)


def states(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The array of integer states `step(state, item)`, from the first item on; it starts at 0.

    As `scan` where the outputs are the states themselves, with fewer copies: the last
    number of the array that grows is the state.
    """
    def block(held: Column, part: Column) -> Column:
        first = F.array(F.coalesce(F.try_element_at(F.try_element_at(held, F.lit(-1)), F.lit(-1)), F.lit(0)))
        done = F.aggregate(part, first, lambda done, item: F.concat(done, F.array(step(F.element_at(done, -1), item))))
        return F.concat(held, F.array(F.slice(done, F.lit(2), F.size(part))))

    def whole(bound: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(bound))).cast("int"))
        count = F.ceil(F.size(bound) / size).cast("int")
        parts = F.transform(F.sequence(F.lit(1), count), lambda b: F.slice(bound, (b - 1) * size + 1, size))
        folded = F.aggregate(parts, F.array().cast("array<array<int>>"), block, F.flatten)
        return F.when(F.size(bound) > 0, folded).otherwise(F.array().cast("array<int>"))

    return let(items, whole)
