"""URL expressions: `Column -> Column`, evaluated in the JVM.

They follow RFC 3986 as Python's ``urllib.parse`` reads it. Each expression uses its
argument as few times as it can: the same expressions also run inside array lambdas,
where Spark shares no common subexpressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions.binding import let

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_HEAD = rf"^(?:{SCHEME}:)?"


def clean(url: Column) -> Column:
    """Leading control characters and blanks, and every tab and line break, removed."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def scheme(url: Column) -> Column:
    """Lower-cased scheme, '' if there is none."""
    return F.lower(F.regexp_extract(clean(url), rf"^({SCHEME}):", 1))


def netloc(url: Column) -> Column:
    """Authority part with its case and port, '' if there is none."""
    return F.regexp_extract(clean(url), _HEAD + r"//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(clean(url), _HEAD + r"(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(clean(url), r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(clean(url), r"^[^#]*#(.*)$", 1)


def parts(url: Column) -> Column:
    """scheme, netloc, path, query and fragment of a URL as a struct."""
    return F.struct(
        scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        path(url).alias("path"),
        query(url).alias("query"),
        fragment(url).alias("fragment"),
    )


def origin(url: Column) -> Column:
    """``scheme://netloc``, the key of robots rules."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def robots_url(url: Column) -> Column:
    return F.concat(origin(url), F.lit("/robots.txt"))


def domain(url: Column) -> Column:
    """Domain column of a crawl task."""
    return netloc(url)


def host(url: Column) -> Column:
    """Authority up to the first colon, lower-cased."""
    return F.lower(F.regexp_extract(clean(url), _HEAD + r"//([^/?#:]*)", 1))


def malformed(url: Column) -> Column:
    """True when the authority has an unbalanced square bracket."""
    authority = netloc(url)
    return F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]"))


def defrag(url: Column) -> Column:
    """The URL without its fragment; a URL that has none is returned untouched."""
    bare = clean(F.substring_index(url, "#", 1))
    rebuilt = F.concat(
        F.lower(F.regexp_extract(bare, rf"^(?:{SCHEME}:)?", 0)),
        drop_empty_parts(F.regexp_replace(bare, rf"^{SCHEME}:", "")),
    )
    return F.when(F.contains(url, F.lit("#")), rebuilt).otherwise(url)


def strip_slash(url: Column) -> Column:
    """The URL without any trailing slash, also one that ends a query."""
    return F.rtrim(url, F.lit("/"))


# --- resolution ------------------------------------------------------------------


def base_parts(url: Column) -> Column:
    """What `resolve_parts` needs of a base URL; compute it once per page."""
    bare_path = path(url)
    return F.struct(
        scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        bare_path.alias("path"),
        F.regexp_replace(bare_path, r"[^/]*$", "").alias("dir"),
        query(url).alias("query"),
    )


def reference_parts(href: Column) -> Column:
    """A reference split into the fields `resolve_parts` reads."""
    return F.struct(
        href.alias("raw"),
        scheme(href).alias("scheme"),
        F.regexp_extract(clean(href), _HEAD + r"(//[^/?#]*)", 1).alias("authority"),
        # an empty parameter list (";" at the end of the last segment) disappears
        F.regexp_replace(path(href), r"^((?:.*/)?[^/;]*);$", "$1").alias("path"),
        query(href).alias("query"),
        fragment(href).alias("fragment"),
    )


def _remove_dots(merged: Column) -> Column:
    """Dot segments resolved. One segment list per URL, so the fold stays short."""
    segments = F.split(merged, "/", -1)
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segments,
        empty,
        lambda kept, segment: F.when(
            segment == "..",
            F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept),
        )
        .when(segment == ".", kept)
        .otherwise(F.concat(kept, F.array(segment))),
    )
    tail = F.when(merged.rlike(r"(?:^|/)\.\.?$"), F.array(F.lit(""))).otherwise(empty)
    return F.array_join(F.concat(folded, tail), "/")


def _path_of(base: Column, ref: Column) -> Column:
    relative = F.regexp_replace(
        F.concat(base["dir"], F.when(base["dir"] == "", "/").otherwise(""), ref["path"]),
        "//+",
        "/",
    )
    merged = F.when(F.startswith(ref["path"], F.lit("/")), ref["path"]).otherwise(relative)
    resolved = F.when(merged.rlike(r"(?:^|/)\.\.?(?:/|$)"), _remove_dots(merged)).otherwise(merged)
    return F.when(F.startswith(resolved, F.lit("/")), resolved).otherwise(
        F.concat(F.lit("/"), resolved)
    )


def _suffix(mark: str, part: Column) -> Column:
    return F.when(part != "", F.concat(F.lit(mark), part)).otherwise("")


def resolve_parts(base: Column, ref: Column) -> Column:
    """Resolve a split reference against a split base."""
    tail = _suffix("#", ref["fragment"])
    own_query = _suffix("?", ref["query"])
    site = F.concat(base["scheme"], F.lit("://"), base["netloc"])
    return (
        F.when(~ref["scheme"].isin("", base["scheme"]), ref["raw"])
        .when(
            F.length(ref["authority"]) > 2,
            F.concat(
                base["scheme"], F.lit(":"), ref["authority"], ref["path"], own_query, tail
            ),
        )
        .when(
            ref["path"] == "",
            F.concat(
                site,
                base["path"],
                F.when(ref["query"] != "", own_query).otherwise(_suffix("?", base["query"])),
                tail,
            ),
        )
        .otherwise(F.concat(site, _path_of(base, ref), own_query, tail))
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of `href` found on the page at `base`."""
    split = F.struct(base_parts(base).alias("base"), reference_parts(href).alias("ref"))
    absolute = let(split, lambda x: resolve_parts(x["base"], x["ref"]))
    return F.when(base == "", href).when(href == "", base).otherwise(absolute)


def normalize(base: Column, href: Column) -> Column:
    """Resolve, drop the fragment, drop trailing slashes."""
    return let(resolve(base, href), lambda url: strip_slash(defrag(url)))


# --- percent-encoding ------------------------------------------------------------


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves `+` and broken escapes as they are."""
    safe = F.regexp_replace(
        F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25"
    )
    return F.when(F.contains(text, F.lit("%")), F.coalesce(F.try_url_decode(safe), text)).otherwise(
        text
    )


def drop_empty_parts(url: Column) -> Column:
    """An empty parameter list, query or fragment leaves no delimiter behind."""
    no_fragment = F.regexp_replace(url, r"^([^#]*)#$", "$1")
    no_query = F.regexp_replace(no_fragment, r"^([^?#]*)\?(#|$)", "$1$2")
    return F.regexp_replace(no_query, r"^((?:[^?#]*/)?[^/;?#]*);([?#]|$)", "$1$2")


def robots_path(url: Column) -> Column:
    """Decoded ``path?query#fragment`` that robots rules are matched against."""
    local = F.regexp_replace(clean(unquote(url)), _HEAD + r"(?://[^/?#]*)?", "")
    return F.coalesce(F.nullif(drop_empty_parts(local), F.lit("")), F.lit("/"))
