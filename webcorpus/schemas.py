"""Schemas of the tables the jobs read and write. Never inferred."""

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
}


def _schema(fields: str) -> T.StructType:
    # StructType.fromDDL would need a running session at import time
    pairs = (field.split() for field in fields.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


#: Fetched pages as they are stored: one row per URL.
PAGES = _schema("page_id bigint, url string, html string")

#: Crawl tasks. The first five fields are mandatory in a task feed.
FRONTIER = _schema(
    "id bigint, url string, priority int, domain string, status string, "
    "depth int, parent_score int, parent_url string"
)
TASK_FEED = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("domain", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
])

#: robots.txt answers, one row per origin; only status 200 carries rules.
ROBOTS_RAW = _schema("origin string, http_status int, body string")

#: HTTP answers. `error_kind` is NULL, 'request' (transport) or 'other'; `location` is the
#: header of that name, where it was stored.
FETCHES = _schema(
    "url string, http_status int, content_type string, html string, "
    "error_kind string, error string, location string"
)

STATUS_EVENTS = _schema(
    "task_id bigint, status string, error_message string, ts timestamp, seq bigint"
)

#: Admitted links as pending tasks, as `FRONTIER` reads them back.
ADMITTED = _schema(
    "id bigint, url string, priority int, domain string, status string, depth int, "
    "parent_score int, parent_url string"
)
#: What a crawl batch needs of a task.
DUE = _schema("id bigint, url string, depth int, parent_score int")
URLS = _schema("url string")
#: Content as it is stored.
PAYLOAD = _schema(
    "id bigint, url string, title string, content string, language string, "
    "author string, date string"
)
