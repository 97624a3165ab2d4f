"""Streams give what batches give, however the input is split, and survive reruns."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from webcorpus import schemas
from webcorpus.config import CrawlOptions
from webcorpus.operators import frontier
from webcorpus.sources import sinks, tables
from webcorpus.streaming import jobs

LINKS = "url string, priority int, depth int, parent_url string, position int"


def _source(spark, df, folder, files):
    df.repartition(files).write.parquet(folder)
    return tables.stream_table(spark, folder, df.schema, files_per_batch=1)


@pytest.mark.parametrize("files", [1, 4])
def test_admission_is_exact_across_batches(spark, tmp_path, files):
    rows = [(f"https://h.com/{i % 13}", 50, 1, f"p{i % 5}", i) for i in range(100)]
    links = spark.createDataFrame(rows, LINKS)
    known = spark.createDataFrame([("https://h.com/3",)], "url string")
    source = _source(spark, links, str(tmp_path / "in"), files)
    jobs.stream_admit_links(source, known, CrawlOptions(), str(tmp_path / "out")).awaitTermination()
    got = [r.url for r in sinks.read_batches(spark, str(tmp_path / "out/links"), schemas.ADMITTED).collect()]
    assert sorted(got) == sorted(r.url for r in frontier.admit_links(links, known).collect())


def test_rerun_of_a_batch_replaces_it(spark, tmp_path):
    folder = str(tmp_path / "links")
    rows = spark.createDataFrame([(7, "u", 1, "d", "pending", 1, 1, "p")], schemas.ADMITTED)
    for batch in (0, 1, 1):
        sinks.sink_links(rows, folder, batch)
    stored = sinks.read_batches(spark, folder, schemas.ADMITTED)
    assert sorted(r.batch_id for r in stored.collect()) == [0, 1]


def test_latest_status(spark, tmp_path):
    events = spark.range(200).select(
        (F.col("id") % 9).alias("task_id"),
        F.when(F.col("id") % 2 == 0, "crawling").otherwise("failed").alias("status"),
        F.concat(F.lit("e"), F.col("id")).alias("error_message"),
        F.timestamp_seconds(F.col("id") % 50).alias("ts"),
        F.col("id").alias("seq"),
    )
    source = _source(spark, events, str(tmp_path / "in"), 3)
    jobs.stream_latest_status(source, str(tmp_path / "out")).awaitTermination()
    got = sorted(jobs.read_latest_status(spark, str(tmp_path / "out")).collect())
    assert got == sorted(frontier.latest_status(events).collect())


def test_task_feed(spark, tmp_path):
    good = '{"id": 1, "url": "https://example.com", "priority": 5, "domain": "example.com", "status": "pending"}'
    (tmp_path / "good.json").write_text(good + "\n")
    (row,) = tables.scan_task_feed(spark, str(tmp_path / "good.json")).collect()
    assert (row.id, row.url, row.priority, row.status) == (1, "https://example.com", 5, "pending")
    (tmp_path / "empty.json").write_text("")
    assert tables.scan_task_feed(spark, str(tmp_path / "empty.json")).count() == 0
    for name, text in {"missing": good.replace('"priority": 5, ', ""), "type": good.replace("5", '"high"'), "broken": good[:-9]}.items():
        (tmp_path / f"{name}.json").write_text(text + "\n")
        with pytest.raises((PySparkException, Py4JJavaError)):
            tables.scan_task_feed(spark, str(tmp_path / f"{name}.json")).collect()


def test_content_payload(spark):
    row = spark.createDataFrame([(1, "u", None, "t", "en", "", "2024-01-01")], "id bigint, url string, title string, text string, language string, author string, date string")
    got = sinks.content_payload(row).first()
    assert (got.content, got.author, got.date, got.title) == ("t", None, "2024-01-01", None)


def test_task_feed_rejects_whatever_is_read(spark, tmp_path):
    good = '{"id": 1, "url": "https://a.example/x", "priority": 2, "domain": "a.example", "status": "pending"}'
    for name, bad in {"missing": good.replace('"priority": 2, ', ""), "broken": good[:-7]}.items():
        (tmp_path / f"{name}.json").write_text(good + "\n" + bad + "\n")
        feed = tables.scan_task_feed(spark, str(tmp_path / f"{name}.json"))
        for read in (feed.count, feed.select("url").collect, feed.collect):
            with pytest.raises((PySparkException, Py4JJavaError)):
                read()


def test_refused_tasks_added_later_are_settled(spark, tmp_path):
    rules = spark.createDataFrame([("https://a.example", None, [(False, "/no")])], "origin string, crawl_delay double, rules array<struct<allow: boolean, path: string>>")
    tasks = [(i, f"https://a.example/{'no' if i % 2 else 'yes'}/{i}") for i in range(6)]
    out = str(tmp_path / "out")
    for run, n in ((0, 3), (1, 6), (1, 6)):
        jobs.settle_refused(spark.createDataFrame(tasks[:n], "id bigint, url string"), rules, CrawlOptions(), out, run)
    stored = sinks.read_batches(spark, f"{out}/refused", schemas.STATUS_EVENTS)
    assert sorted((r.task_id, r.batch_id) for r in stored.where("status = 'failed'").collect()) == [(1, 0), (3, 1), (5, 1)]


def test_a_lost_checkpoint_stops_the_stream(spark, tmp_path):
    import shutil

    links = spark.createDataFrame([("https://h.com/1", 50, 1, "p", 0)], LINKS)
    out, known = str(tmp_path / "out"), spark.createDataFrame([], "url string")
    source = _source(spark, links, str(tmp_path / "in"), 1)
    jobs.stream_admit_links(source, known, CrawlOptions(), out).awaitTermination()
    jobs.stream_admit_links(source, known, CrawlOptions(), out).awaitTermination()
    shutil.rmtree(f"{out}/_checkpoint")
    with pytest.raises(ValueError, match="checkpoint is gone"):
        jobs.stream_admit_links(source, known, CrawlOptions(), out)
