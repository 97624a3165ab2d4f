import duckdb
from pyspark.sql import functions as F

from webcorpus.llm import revisits

SCHEMA = "record_id string, warc_type string, target_uri string, date timestamp, status int, headers map<string,string>, payload string, url string"


def resolved(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA.replace("date timestamp", "date string"))
    df = df.withColumn("date", F.to_timestamp("date"))
    return {r.record_id: r for r in revisits.resolve_revisits(df).collect()}


def response(i, url, date, headers, status=200):
    return (i, "response", url, date, status, headers, f"payload of {i}")


def revisit(i, url, date, headers):
    return (i, "revisit", url, date, 304, headers, None)


def test_latest_earlier_response(spark):
    u, v = "http://WWW.Example.com:80/a/?utm_source=x#top", "https://example.com/a"
    rows = [
        response("1", u, "2024-01-01 10:00:00", {"ETag": '"x"', "Age": "1"}),
        response("2", v, "2024-01-03 10:00:00", {"etag": 'W/"y"', "Content-Length": "9", "Vary": "a"}),
        response("3", v, "2024-01-03 09:00:00", {"etag": '"z"'}),
        response("9", v, "2024-01-03 11:00:00", {"etag": '"gone"'}, 404),
        revisit("a", v, "2024-01-02 23:00:00", {"ETAG": '"x"', "Age": "7"}),
        revisit("b", v, "2024-01-03 12:00:00", {"Etag": '"y"', "content-length": "0", "Date": "now", "vary": None}),
        revisit("c", v, "2024-01-03 09:30:00", {"Etag": '"y"'}),
        revisit("d", v, "2024-01-01 10:00:00", {"Etag": '"x"'}),
        revisit("e", v, "2024-01-04 10:00:00", {}),
        revisit("f", None, "2024-01-04 10:00:00", {"Etag": '"y"'}),
        revisit("g", v, None, None),
        revisit("h", "https://example.com/other", "2024-01-04 10:00:00", None),
        response("5", "https://example.com/plain", "2024-01-03 09:00:00", None),
        revisit("i", "https://example.com/plain/", "2024-01-05 09:00:00", None),
        (None, "response", v, "2024-01-03 11:30:00", 200, {"etag": '"y"'}, "no id"),
        ("j", None, v, None, None, None, None),
    ]
    got = resolved(spark, rows)
    assert {k: (r.outcome, r.refers_to) for k, r in got.items()} == {
        "a": ("resolved", "1"), "b": ("resolved", "2"), "c": ("validator mismatch", "3"), "d": ("no earlier response", None),
        "e": ("validator mismatch", "2"), "f": ("no earlier response", None), "g": ("no earlier response", None),
        "h": ("no earlier response", None), "i": ("resolved", "5"),
    }
    assert got["a"].headers == {"etag": '"x"', "age": "7"} and got["a"].payload == "payload of 1"
    assert got["b"].headers == {"etag": '"y"', "content-length": "9", "date": "now", "vary": "a"}
    assert got["i"].headers == {} and got["c"].payload is None


def test_ties_and_last_modified(spark):
    v = "example.org/x?b=1&utm_medium=2&a=3"
    rows = [
        response("1", v, "2024-01-01 10:00:00", {"Last-Modified": "m", "last-modified": "n"}),
        response("2", v, "2024-01-01 10:00:00", {"Last-Modified": "m"}),
        revisit("a", "https://example.org/x?b=1&a=3", "2024-06-01 10:00:00", {"last-modified": "m"}),
        revisit("b", "https://example.org/x?b=1&a=3", "2024-06-01 10:00:00", {"last-modified": "n"}),
    ]
    got = resolved(spark, rows)
    assert (got["a"].outcome, got["a"].refers_to) == ("resolved", "2")
    assert got["b"].outcome == "validator mismatch"
    assert resolved(spark, rows[:2]) == {}


def test_empty_table(spark):
    assert revisits.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_same_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    key = lambda r: r[0]
    want = sorted(db.execute(revisits.OP7_SQL).fetchall(), key=key)
    got = sorted((tuple(r) for r in revisits.op7_revisits(spark, folder).collect()), key=key)
    assert got == want and {r[2] for r in got} == {"resolved", "validator mismatch", "no earlier response"}
