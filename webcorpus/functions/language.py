"""Language prediction from the URL alone, as one expression.

A prediction is a two-letter code, NULL (unknown: crawl it) or ``SKIP`` (certainly
outside the EU).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus import config
from webcorpus.functions import urls
from webcorpus.functions.binding import let, lookup

_PREFIX = rf"^(?:{urls.SCHEME}:)?(?://[^/?#]*)?"
_PATH = _PREFIX + r"/([a-z]{2})(?:-[a-z]{2})?(?:/|;[^/?#]*(?:[?#]|$)|[?#]|$)"
_QUERY = r"^[^?#]*\?(?:[^#]*?[&?])?(?:lang|language|locale)=([a-z]{2})"


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _tld(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.regexp_extract(host, r"\.([^.]*)$", 1))


def _allowlisted(host: Column) -> Column:
    domains = "|".join(re.escape(d) for d in config.LANGUAGE_ALLOWLIST)
    return host.rlike(rf"(?:^|\.)(?:{domains})$")


def _tld_language(host: Column) -> Column:
    primary = {tld: languages[0] for tld, languages in config.TLD_LANGUAGES.items()}
    return lookup(primary, _tld(host))


def _subdomain_language(host: Column) -> Column:
    return _or_null(F.regexp_extract(host, r"^(\p{L}{2})\.[^.]*\.", 1))


def is_allowlisted(url: Column) -> Column:
    """The host is one of the always-crawled domains or below one."""
    return _allowlisted(urls.host(url))


def tld(url: Column) -> Column:
    """Last label of a host with two labels or more, else NULL."""
    return _tld(urls.host(url))


def from_tld(url: Column) -> Column:
    """Primary language of a country-code TLD, NULL for any other TLD."""
    return _tld_language(urls.host(url))


def from_subdomain(url: Column) -> Column:
    """First label of a host with three labels or more, when it is two letters."""
    return _subdomain_language(urls.host(url))


def from_path(url: Column) -> Column:
    """Language of a leading ``/xx/`` or ``/xx-yy/`` path segment."""
    return _or_null(F.regexp_extract(urls.clean(url), _PATH, 1))


def from_query(url: Column) -> Column:
    """Language of the first ``lang=``, ``language=`` or ``locale=`` parameter."""
    return _or_null(F.regexp_extract(urls.clean(url), _QUERY, 1))


def is_non_eu(url: Column) -> Column:
    return F.coalesce(tld(url).isin(config.NON_EU_TLDS), F.lit(False))


def _predict(link: Column) -> Column:
    url, host = link["url"], link["host"]
    guess = F.coalesce(
        _tld_language(host),
        _subdomain_language(host),
        from_path(url),
        from_query(url),
        F.when(_tld(host).isin(config.NON_EU_TLDS), config.SKIP),
    )
    return F.when(~_allowlisted(host) & ~urls.malformed(url), guess)


def predict_language(url: Column) -> Column:
    """The whole chain; the order of the rules is the contract."""
    return let(F.struct(url.alias("url"), urls.host(url).alias("host")), _predict)


def keep_language(language: Column, allowed: list[str]) -> Column:
    """True for unknown languages and for the allowed ones; ``SKIP`` never passes."""
    known = [code for code in allowed if code != config.SKIP]
    return F.coalesce(language, F.lit("")).isin("", *known)
