"""Words between ASCII white space, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ends a word.
SPACES = r"[\x20\x09-\x0D]+"
#: A byte of a word.
WORD = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """The array of words `[^\\x20\\x09-\\x0D]+`, in order; NULL has none."""
    # what stands before the first and after the last white space may be empty
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
