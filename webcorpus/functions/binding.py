"""Evaluate an expression once and use its value several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with one evaluation of `value`.

    Long expressions that repeat their input grow exponentially in the plan; a filter
    that is pushed down even copies them. Bound, they stay as long as they are written.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a fixed table, NULL for another key. The table is one literal."""
    # no key or value has these control characters
    text = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit("\x01"), F.lit("\x02")), key)


def computed_once(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with the given columns evaluated here and nowhere else.

    The optimizer moves a later filter on a computed column below its projection and
    evaluates the expression twice. It does not move it below a generator.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*columns)))).select(*df.columns)
