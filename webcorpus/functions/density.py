"""Which text blocks of a page are lists of links: a block's score depends on its neighbours.

A block is made of links if at least half of its characters stand in anchors. What follows
from that is decided by two folds over the blocks, one in page order and one against it:
each block learns what the nearest block that tells something is on either side. Runs of
link blocks go, with the short labels between them; a link between paragraphs stays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions.scan import scan

#: Share of a block's characters in anchors that makes it a block of links.
LINKED = 0.5
#: Characters from which a block without that share tells that it is text.
TEXT_CHARS = 40
#: Characters outside of anchors from which a block is never made of links.
OWN_CHARS = 80
#: Link blocks in a row, with labels between them, from which a run goes.
RUN = 3

#: Marks of the start and the end of an anchor: characters no text block can hold, as the
#: parser reads them as white space.
OPENED, CLOSED = "\x1e", "\x1f"


def marked_anchors(markup: Column, in_tag: str) -> Column:
    """Markup with anchor tags replaced by marks; marks that were there before go."""
    plain = unmarked(markup)
    opened = F.regexp_replace(plain, rf"(?i)<a(?=[\s/>]){in_tag}>", OPENED)
    return F.regexp_replace(opened, r"(?i)</a(?=[\s/>])[^<>]*>", CLOSED)


def unmarked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPENED), F.lit("")), F.lit(CLOSED), F.lit(""))


def _chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s+", ""))


def has_mark(piece: Column) -> Column:
    return F.contains(piece, F.lit(OPENED)) | F.contains(piece, F.lit(CLOSED))


def link_chars(pieces: Column) -> Column:
    """Characters in anchors, white space aside, of every piece of marked markup without tags.
    An anchor that a piece leaves open goes on in the next one."""
    def step(inside: Column, piece: Column) -> tuple[Column, Column]:
        marked = has_mark(piece)
        whole = F.concat(F.when(inside, F.lit(OPENED)).otherwise(F.lit("")), piece)
        linked = F.array_join(F.regexp_extract_all(whole, F.lit(f"{OPENED}([^{OPENED}{CLOSED}]*)"), F.lit(1)), "")
        # the mark that comes last
        opened = F.length(F.substring_index(piece, OPENED, -1)) < F.length(F.substring_index(piece, CLOSED, -1))
        return F.when(marked, opened).otherwise(inside), F.when(marked | inside, _chars(linked)).otherwise(0)

    return scan(pieces, F.lit(False), step, "int")


# what a block tells about its neighbours
_NOTHING, _TEXT, _LINKS = 0, 1, 2


def _kind(text: Column, linked: Column) -> Column:
    # white space in a block is single blanks
    chars = F.length(F.replace(text, F.lit(" "), F.lit("")))
    made_of_links = (linked >= chars * LINKED) & (chars - linked < OWN_CHARS) & (linked > 0)
    return F.when(made_of_links, _LINKS).when(chars >= TEXT_CHARS, _TEXT).otherwise(_NOTHING)


def _run_lengths(kinds: Column) -> Column:
    """Link blocks since the last text block, up to and with this one."""
    step = lambda run, kind: (lambda n: (n, n))(
        F.when(kind == _LINKS, run + 1).when(kind == _TEXT, 0).otherwise(run)
    )
    return scan(kinds, F.lit(0), step, "int")


def is_list_of_links(texts: Column, linked: Column) -> Column:
    """An array of whether each block goes, of the blocks' texts and `link_chars`.

    A link block goes if it is in a run of `RUN` or more without a text block between them.
    A short block goes if such a run goes on on both of its sides.
    """
    kinds = F.zip_with(texts, linked, _kind)
    both = F.zip_with(_run_lengths(kinds), F.reverse(_run_lengths(F.reverse(kinds))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # a link block counts on both sides of itself
    return F.zip_with(kinds, both, lambda kind, n: F.when(kind == _LINKS, n["a"] + n["b"] > RUN).otherwise(
        (kind == _NOTHING) & (n["a"] > 0) & (n["b"] > 0) & (n["a"] + n["b"] >= RUN)
    ))
