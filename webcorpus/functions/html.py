"""HTML expressions: `Column -> Column` over the raw page text.

Every pattern is linear on any input. Loops over groups are possessive (Java then
iterates instead of recursing), and a region whose closing tag is missing runs to the
end of the page, as it does for a parser, so it is looked for only once.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions import density
from webcorpus.functions.binding import let, lookup
from webcorpus.functions.scan import states

_OPEN = r"(?:[\s/][^<>]*)?>"
# Inside of a tag. Quoted values may hold any bracket; outside of quotes "<" ends the
# attempt, so that text full of unfinished tags is not scanned once per tag.
_IN_TAG = r"""(?:[^"'<>]++|"[^"]*+"|'[^']*+'|["'])*+"""
_VALUE = r"""("[^"]*+"|'[^']*+'|[^\s"'<>][^\s<>]*+)"""
# whole attributes, up to the wanted one
_SKIP_ATTRIBUTES = (
    r"""(?:[\s/"'=]++|(?!{wanted})[^\s"'<>/=]++"""
    r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>][^\s<>]*+))?+)*+"""
)
# any run of white space but a lone blank
_BLANKS = r"[\t\n\x0B\f\r\u00a0][\s\u00a0]*+| [\s\u00a0]++"

#: Elements whose content no reader of the page sees.
RAW_TEXT_TAGS = ("script", "style")
HIDDEN_TAGS = (*RAW_TEXT_TAGS, "noscript", "template")
#: Regions left out of the main text, besides comment areas.
BOILERPLATE_TAGS = ("nav", "footer", "aside")

_BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|caption|center|dd|details|dialog|dir|div|dl|dt|"
    "fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|legend|li|main|menu|nav|"
    "ol|option|p|pre|section|select|summary|table|tbody|tfoot|thead|title|tr|ul"
)
_COMMENT_NAME = "(?:comments?|comment-?list|disqus_thread)"
_COMMENT_ATTRIBUTE = (
    r"(?:class|id)\s*+=\s*+(?:"
    rf"""["'](?:[^"'<>]*[\s_-])?{_COMMENT_NAME}(?:[\s_-][^"'<>]*)?["']"""
    rf"""|(?:[^\s"'<>]*[_-])?{_COMMENT_NAME}(?:[_-][^\s"'<>]*)?(?=[\s>]))"""
)
_COMMENT_AREA = (
    r"<(?:section|div|ul|ol)(?=[\s/])"
    + _SKIP_ATTRIBUTES.replace("{wanted}", _COMMENT_ATTRIBUTE)
    + rf"{_COMMENT_ATTRIBUTE}{_IN_TAG}>"
)
_AREA_TAGS = ("section", "div", "ul", "ol")


def is_blank(html: Column) -> Column:
    """True for NULL and for white space only."""
    return ~F.coalesce(html.rlike(r"\S"), F.lit(False))


def _without(html: Column, tags: tuple[str, ...], *others: str) -> Column:
    """Drop the given elements in one pass; whatever opens first wins."""
    elements = rf"({'|'.join(tags)}){_OPEN}.*?(?:</\1\s*>|\z)"
    return F.regexp_replace(html, rf"(?is)<(?:{'|'.join((elements, *others))})", "")


_COMMENT = r"!--.*?(?:-->|\z)"


def without_raw_text(html: Column) -> Column:
    """Comments, scripts and styles removed."""
    return _without(html, RAW_TEXT_TAGS, _COMMENT)


def visible(html: Column) -> Column:
    """The page without comments, scripts, styles, noscript and template content."""
    return _without(html, HIDDEN_TAGS, _COMMENT)


# marks before and after a tag, and what stands for such characters of the page
_BEFORE, _AFTER, _ESCAPE = "\x1e", "\x1f", "\x1a"
_ESCAPED = {mark: f"{_ESCAPE}{n}" for n, mark in enumerate((_ESCAPE, _BEFORE, _AFTER))}
# an element around no other tag that opens no region, of the tags of comment areas
_LEAF = (
    rf"(?i){_BEFORE}(<({'|'.join(_AREA_TAGS)})(?=[\s/>])(?![^{_AFTER}]*(?:comment|disqus))[^{_AFTER}]*+{_AFTER}[^{_BEFORE}]*+)"
    rf"{_BEFORE}(</\2(?=[\s/>]))"
)


def _without_regions(page: Column, tags: tuple[str, ...]) -> Column:
    """Visible markup without boilerplate regions, of which `tags` are the elements.

    The page is cut at the tags of these elements, and a fold over them keeps the element
    that opened a region and how deep it is nested in itself. A region ends with that element,
    at any depth, or with the page; closing tags that belong to no region stay. Elements that
    hold no tag and open no region change neither, and are not cut. The fold is over numbers:
    a state is 64 times the depth plus the number of the element, 0 outside of regions and -1 at
    the tag that ends one.
    """
    tag = rf"(?is)</?(?:{'|'.join(tags)})(?=[\s/>]){_IN_TAG}>"
    starts = rf"(?is)^(?:<(?:{'|'.join(BOILERPLATE_TAGS)})(?=[\s/>])|{_COMMENT_AREA})"
    names = f" {' '.join(tags)} "

    def code(piece: Column) -> Column:
        token = F.substring_index(piece, _AFTER, 1)
        name = F.lower(F.regexp_extract(token, "^</?([a-zA-Z]+)", 1))
        number = F.instr(F.lit(names), F.concat(F.lit(" "), name, F.lit(" ")))
        # 0 closes, 64 opens, 128 opens a region
        return number + F.when(F.startswith(token, F.lit("</")), 0).when(token.rlike(starts), 128).otherwise(64)

    def step(state: Column, code: Column) -> Column:
        return (
            F.when(state <= 0, F.when(code >= 128, code - 64).otherwise(0))
            .when(state.bitwiseXOR(code).bitwiseAND(F.lit(63)) != 0, state)
            .when(code >= 64, state + 64)
            .when(state < 128, -1)
            .otherwise(state - 64)
        )

    def kept(piece: Column, state: Column) -> Column:
        text = F.substr(piece, F.instr(piece, F.lit(_AFTER)) + 1)
        return F.when(state == 0, piece).when(state < 0, text).otherwise("")

    def join(pieces: Column) -> Column:
        def kept_of(after: Column) -> Column:
            return F.array_join(F.zip_with(after, states(F.transform(after, code), step), kept), "")

        return F.concat(F.get(pieces, 0), let(F.slice(pieces, F.lit(2), F.size(pieces)), kept_of))

    plain = page
    for mark, escaped in _ESCAPED.items():
        plain = F.replace(plain, F.lit(mark), F.lit(escaped))
    marked = F.regexp_replace(plain, tag, f"{_BEFORE}$0{_AFTER}")
    if set(_AREA_TAGS) <= set(tags):
        marked = F.regexp_replace(marked, _LEAF, "$1$3")
    joined = F.replace(let(F.split(marked, _BEFORE, -1), join), F.lit(_AFTER), F.lit(""))
    for mark, escaped in reversed(_ESCAPED.items()):
        joined = F.replace(joined, F.lit(escaped), F.lit(mark))
    return joined


def without_boilerplate(html: Column) -> Column:
    """The visible page without navigation, footer, aside and comment areas."""
    def cut(page: Column) -> Column:
        return (
            F.when(page.rlike(rf"(?is){_COMMENT_AREA}"), _without_regions(page, (*BOILERPLATE_TAGS, *_AREA_TAGS)))
            .when(page.rlike(rf"(?i)<(?:{'|'.join(BOILERPLATE_TAGS)})[\s/>]"), _without_regions(page, BOILERPLATE_TAGS))
            .otherwise(page)
        )

    return let(visible(html), cut)


# --- character references ---------------------------------------------------------

_NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
# names that need no semicolon, longer ones first
_OPEN_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
_COMMON = {name: _NAMED[name] for name in ("lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "ndash", "mdash")}
# Numbers 128-159 mean the characters of Windows-1252 that have them, where there is one.
_WINDOWS = {
    str(code): bytes([code]).decode("cp1252")
    for code in range(128, 160)
    if code not in (129, 141, 143, 144, 157)
}


def _from_codepoint(code: Column) -> Column:
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    # the byte order mark keeps U+FEFF itself from being read as one
    utf32 = F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0")))
    character = F.when(valid, F.decode(utf32, "UTF-32")).otherwise("")
    return F.when(code.between(128, 159), F.coalesce(lookup(_WINDOWS, code.cast("string")), character)).otherwise(character)


def _codepoint(digits: Column) -> Column:
    """Number of `#65` or `#x41` digits; nine of them are beyond any character."""
    nine = F.substring(F.regexp_replace(digits, "^[xX]?0*", "0"), 1, 10)
    is_hex = F.lower(F.substring(digits, 1, 1)) == "x"
    return F.when(is_hex, F.conv(nine, 16, 10)).otherwise(F.conv(nine, 10, 10)).cast("bigint")


def _split_reference(piece: Column) -> Column:
    """The text after an ampersand with the reference it may start with."""
    return F.struct(
        piece.alias("text"),
        F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1).alias("name"),
        # in attributes such names may be parameters, so they end before "=" and letters
        F.regexp_extract(piece, rf"^({'|'.join(_OPEN_NAMES)})(?![=;A-Za-z0-9])", 1).alias("open"),
        F.regexp_extract(piece, r"^#([xX][0-9A-Fa-f]+|[0-9]+)", 1).alias("digits"),
    )


def _join_reference(piece: Column) -> Column:
    name, digits, text = piece["name"], piece["digits"], piece["text"]
    rest = F.substr(text, F.length(name) + 2)
    number = F.transform(F.array(_codepoint(digits)), _from_codepoint)
    opened = piece["open"]
    return (
        F.when(name == "amp", F.concat(F.lit("&"), rest))
        .when(
            name != "",
            F.concat(F.coalesce(lookup(_COMMON, name), lookup(_NAMED, name), F.concat(F.lit("&"), name, F.lit(";"))), rest),
        )
        .when(opened != "", F.concat(lookup(_NAMED, opened), F.substr(text, F.length(opened) + 1)))
        .when(
            digits != "",
            F.concat(F.get(number, 0), F.regexp_replace(text, r"^#[xX]?[0-9A-Fa-f]+;?", "")),
        )
        .otherwise(F.concat(F.lit("&"), text))
    )


def unescape(text: Column) -> Column:
    """Named and numeric character references decoded, each exactly once."""
    pieces = F.split(text, "&", -1)
    tail = F.transform(
        F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _split_reference), _join_reference
    )
    decoded = F.concat(F.get(pieces, 0), F.array_join(tail, ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


# --- blocks -----------------------------------------------------------------------


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank, both ends are trimmed."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def strip_tags(markup: Column) -> Column:
    return F.regexp_replace(markup, rf"<[a-zA-Z/!?]{_IN_TAG}>", "")


def _cells(row: Column) -> Column:
    """Cells of a table row parted by bars; the tags of a cell need not be closed."""
    first = F.regexp_replace(row, rf"(?i)^\s*<t[dh]{_OPEN}", "")
    return F.regexp_replace(first, rf"(?i)(?:</t[dh]\s*>\s*)?<t[dh]{_OPEN}", " | ")


_BLOCK_TAG = rf"(?i)</?(?:{_BLOCK_TAGS})(?=[\s/>]){_IN_TAG}>"


def _block_text(piece: Column) -> Column:
    return squeeze(unescape(strip_tags(_cells(piece))))


def _is_empty(text: Column) -> Column:
    # bars alone are empty cells
    return text.rlike(r"^[|\s]*$")


def blocks(markup: Column) -> Column:
    """Ordered text blocks of visible markup; the cells of a table row share a block."""
    texts = F.transform(F.split(_without(markup, ("title",)), _BLOCK_TAG, -1), _block_text)
    return F.filter(texts, lambda text: ~_is_empty(text))


def scored_blocks(markup: Column) -> Column:
    """The blocks as `(text, linked)`: whether a block belongs to a list of links."""
    body = density.marked_anchors(_without(markup, ("title",)), _IN_TAG)

    def read(pieces: Column) -> Column:
        texts = F.transform(pieces, lambda piece: _block_text(density.unmarked(piece)))
        # a character reference counts as one character
        chars = density.link_chars(
            F.transform(pieces, lambda piece: F.regexp_replace(strip_tags(piece), "&#?[A-Za-z0-9]+;", "x"))
        )
        both = F.zip_with(texts, chars, lambda text, n: F.struct(text.alias("text"), n.alias("chars")))
        return F.filter(both, lambda block: ~_is_empty(block["text"]))

    def score(found: Column) -> Column:
        linked = density.is_list_of_links(found["text"], found["chars"])
        return F.zip_with(found, linked, lambda block, flag: F.struct(block["text"].alias("text"), flag.alias("linked")))

    return let(let(F.split(body, _BLOCK_TAG, -1), read), score)


# --- metadata ---------------------------------------------------------------------


def unquoted(value: Column) -> Column:
    """An attribute value without its quotes."""
    quoted = F.startswith(value, F.lit('"')) | F.startswith(value, F.lit("'"))
    return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def attribute_pattern(tag: str, name: str) -> str:
    """Pattern whose group 1 is the (quoted) value of the tag's first such attribute."""
    skip = _SKIP_ATTRIBUTES.replace("{wanted}", rf"{name}[\s=/>]")
    return rf"(?is)<{tag}(?=[\s/]){skip}{name}\s*+=\s*+{_VALUE}"


def attribute(markup: Column, tag: str, name: str) -> Column:
    """Value of the attribute in the first such tag as it is written, '' if there is none."""
    return unquoted(F.regexp_extract(markup, attribute_pattern(tag, name), 1))


def plain(markup: Column) -> Column:
    """Text of inline markup."""
    return squeeze(unescape(strip_tags(F.regexp_replace(markup, "(?i)<br", " <br"))))


def texts(markup: Column) -> Column:
    """The title element, the html element's lang, the first time element's datetime,
    then every h1, as text ('' if there is none)."""
    found = F.array(
        F.regexp_extract(markup, rf"(?is)<title{_OPEN}(.*?)(?:</title\s*>|\z)", 1),
        attribute(markup, "html", "lang"),
        attribute(markup, "time", "datetime"),
    )
    headings = F.regexp_extract_all(
        markup, F.lit(rf"(?is)<h1{_OPEN}((?:[^<]++|<(?!/h1))*+)(?:</h1|\z)"), F.lit(1)
    )
    return F.transform(F.concat(found, headings), plain)


def metas(markup: Column) -> Column:
    """All meta tags as (key, content)."""
    tags = F.regexp_extract_all(markup, F.lit(rf"(?is)<meta(?=[\s/]){_IN_TAG}>"), F.lit(0))
    key = r"""(?is)[\s"'](?:name|property|http-equiv|itemprop)\s*=\s*["']?([^\s"'>]*)"""
    return F.transform(
        tags,
        lambda tag: F.struct(
            F.lower(F.regexp_extract(tag, key, 1)).alias("key"),
            plain(attribute(tag, "meta", "content")).alias("content"),
        ),
    )


def meta(tags: Column, *keys: str) -> Column:
    """Content of the first meta tag with one of the keys, else NULL."""
    return F.get(F.filter(tags, lambda tag: tag["key"].isin(*keys) & (tag["content"] != "")), 0)[
        "content"
    ]


def title(found: Column) -> Column:
    """The only h1 of the page, else its title element, else its first h1."""
    headings = F.filter(F.slice(found, F.lit(4), F.size(found)), lambda text: text != "")
    return F.coalesce(
        F.when(F.size(headings) == 1, F.get(headings, 0)),
        F.nullif(F.get(found, 0), F.lit("")),
        F.get(headings, 0),
    )


def language(found: Column, tags: Column) -> Column:
    """Primary subtag of the html element's lang, else of the content-language meta."""
    def primary(code: Column) -> Column:
        return F.nullif(F.lower(F.regexp_extract(code, "^([A-Za-z]{2,8})(?![A-Za-z])", 1)), F.lit(""))

    return F.coalesce(primary(F.get(found, 1)), primary(meta(tags, "content-language")))


def linked_data(html: Column) -> Column:
    """The JSON-LD texts of a page, joined."""
    script = r"(?is)<script(?=[\s/])[^<>]*application/ld\+json[^<>]*>(.*?)(?:</script|\z)"
    return F.array_join(F.regexp_extract_all(html, F.lit(script), F.lit(1)), "\n")


def _json_text(value: Column) -> Column:
    """A JSON string without its quotes, escapes undone."""
    return F.get_json_object(F.concat(F.lit('{"v":"'), value, F.lit('"}')), "$.v")


def _marked(markup: Column, name: str) -> tuple[Column, Column]:
    """Tag and first text of the first element marked as `name` by rel or itemprop."""
    tag = rf"""(?is)<(?:a|address|abbr|div|h[1-6]|li|p|span|strong|time)\s[^<>]*?(?:rel|itemprop)\s*=\s*["']?{name}(?=["'\s>])[^<>]*>"""
    text = r"(?:\s*+<(?!/)[^<>]*+>)*+\s*+([^<]*)"
    return F.regexp_extract(markup, tag, 0), plain(F.regexp_extract(markup, tag + text, 1))


def author(tags: Column, markup: Column, data: Column) -> Column:
    """The author named by meta tags, else by JSON-LD, else by a marked element."""
    string = r'"((?:[^"\\]|\\.)*+)"'
    given = F.regexp_extract(data, rf'(?s)"author"\s*:\s*(?:\[\s*)?{string}', 1)
    named = F.regexp_extract(data, rf'(?s)"author"\s*:\s*(?:\[\s*)?\{{[^{{}}]*?"name"\s*:\s*{string}', 1)
    empty = F.lit("")
    return F.coalesce(
        meta(tags, "author", "article:author", "dc.creator"),
        F.nullif(_json_text(F.nullif(given, empty)), empty),
        F.nullif(_json_text(F.nullif(named, empty)), empty),
        F.nullif(_marked(markup, "author")[1], empty),
    )


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"


def iso_date(raw: Column) -> Column:
    """A date at the start of a text as YYYY-MM-DD: 2024-03-15, 2024/3/15, 20240315,
    15 March 2024 or March 15, 2024. NULL where there is none, or no such day."""
    forms = [
        (r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", (1, 2, 3)),
        (r"^\s*(\d{4})(\d{2})(\d{2})(?!\d)", (1, 2, 3)),
        (rf"(?i)^\s*(?:[a-z]{{3,9}},?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\.?\s+{_MONTH},?\s+(\d{{4}})(?!\d)", (3, 2, 1)),
        (rf"(?i)^\s*{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?!\d)", (3, 1, 2)),
    ]

    months = dict(zip(_MONTHS.split(), map(str, range(1, 13)), strict=True))
    out = []
    for pattern, groups in forms:
        year, month, number = (F.regexp_extract(raw, pattern, g) for g in groups)
        numbered = F.coalesce(lookup(months, F.lower(month)), month)
        text = F.concat_ws("-", year, F.lpad(numbered, 2, "0"), F.lpad(number, 2, "0"))
        out.append(F.when(year != "", F.try_to_date(text, "yyyy-MM-dd").cast("string")))
    return F.coalesce(*out)


def date(found: Column, tags: Column, markup: Column, data: Column) -> Column:
    """Publication date as an ISO string, from article metadata, JSON-LD, a marked element
    or the first time element: the first of these that is a date."""
    tag, text = _marked(markup, "datePublished")
    stated = r"""(?is)\s(?:content|datetime)\s*=\s*["']?([^"'<>]*)"""
    return F.coalesce(
        iso_date(meta(tags, "article:published_time", "datepublished", "dc.date", "date")),
        iso_date(F.regexp_extract(data, r'"datePublished"\s*:\s*"([^"]*)"', 1)),
        iso_date(F.regexp_extract(tag, stated, 1)),
        iso_date(text),
        iso_date(F.get(found, 2)),
    )


def hrefs(html: Column) -> Column:
    """Decoded href of every anchor in document order, blank ones included."""
    found = F.regexp_extract_all(
        without_raw_text(html), F.lit(attribute_pattern("a", "href")), F.lit(1)
    )
    return F.transform(found, lambda value: unescape(unquoted(value)))
