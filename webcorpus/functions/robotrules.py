"""robots.txt texts and decisions as expressions.

Rules are matched in file order, the first path that is a prefix of the URL's path
decides; `*` and `$` in a path are literal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions import urls

_LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"
# a record: lines naming agents, then lines with rules, nothing in between
_RECORD = r"(?m)^((?:A[^\n]*+\n)++(?:R[^\n]*+\n)++)"


def _field(line: Column, key: str) -> Column:
    """Value of a `key: value` line without its comment, NULL for another line."""
    pattern = rf"(?i)^\s*{key}\s*:([^#]*)"
    return F.when(line.rlike(pattern), F.trim(F.regexp_replace(
        F.regexp_extract(line, pattern, 1), r"^\s+|\s+$", "")))


def _token(line: Column) -> Column:
    """One-letter kind plus value of a line that matters, NULL for any other."""
    return F.coalesce(
        F.when(line == "", "B"),
        F.concat(F.lit("A"), _field(line, "user-agent")),
        F.concat(F.lit("R-"), _field(line, "disallow")),
        F.concat(F.lit("R+"), _field(line, "allow")),
        F.concat(F.lit("Rd"), _field(line, "crawl-delay")),
        F.concat(F.lit("Rr"), _field(line, "request-rate")),
    )


def _values(record: Column, kind: str) -> Column:
    lines = F.filter(F.split(record, "\n", -1), lambda line: line.rlike(f"^{kind}"))
    width = 1 if kind == "A" else 2
    return F.transform(
        lines,
        lambda line: F.struct(
            F.substring(line, 1, width).alias("kind"),
            urls.unquote(F.substr(line, F.lit(width + 1))).alias("value"),
        ),
    )


def entries(body: Column) -> Column:
    """Records of a robots text in file order: agents, rules and delay."""
    tokens = F.filter(
        F.transform(F.split(body, _LINE_BREAK, -1), _token), lambda token: token.isNotNull()
    )
    text = F.concat(F.array_join(tokens, "\n"), F.lit("\n"))
    records = F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1))
    return F.transform(
        records,
        lambda record: F.struct(
            F.transform(_values(record, "A"), lambda x: x["value"]).alias("agents"),
            F.transform(
                _values(record, "R[+-]"),
                lambda x: F.struct(
                    # an empty Disallow allows everything
                    ((x["kind"] == "R+") | (x["value"] == "")).alias("allow"),
                    urls.drop_empty_parts(urls.clean(x["value"])).alias("path"),
                ),
            ).alias("rules"),
            F.try_element_at(
                F.filter(
                    F.transform(_values(record, "Rd"), lambda x: x["value"]),
                    lambda value: value.rlike("^[0-9]+$"),
                ),
                F.lit(-1),
            )
            .cast("double")
            .alias("delay"),
        ),
    )


def select_entry(records: Column, user_agent: str) -> Column:
    """The record for an agent: the first that names it, else the first `*` record."""
    token = F.lit(user_agent.split("/")[0].lower())
    star = lambda entry: F.array_contains(entry["agents"], "*")
    named = F.filter(
        records,
        lambda entry: ~star(entry)
        & F.exists(entry["agents"], lambda agent: F.contains(token, F.lower(agent))),
    )
    return F.coalesce(F.get(named, 0), F.get(F.filter(records, star), 0))


def allows(rules: Column, url: Column) -> Column:
    """Decision of the first rule that applies; no rule or no robots text allows."""
    target = urls.robots_path(url)
    # the decoded path is computed once per URL, not once per rule
    bound = F.transform(
        F.array(target),
        lambda path: F.get(F.filter(rules, lambda rule: F.startswith(path, rule["path"])), 0),
    )
    return F.coalesce(F.get(bound, 0)["allow"], F.lit(True))
