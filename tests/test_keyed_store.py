"""The stored frontier: exact lookups that read few rows, and batches that can be run again."""

import random

import pytest
from pyspark.sql import functions as F

from webcorpus import schemas
from webcorpus.config import CrawlOptions
from webcorpus.operators import frontier
from webcorpus.plans import files, keyed_store
from webcorpus.plans.keyed_store import KeyedStore
from webcorpus.streaming import jobs

LINKS = "url string, priority int, depth int, parent_url string, position int"


def urls(spark, names):
    return spark.createDataFrame([(n,) for n in names], schemas.URLS)


def held(df):
    return sorted(r.url for r in df.collect())


def rows_in(store, paths):
    return store.spark.read.schema(store.schema).parquet(*paths).count() if paths else 0


def test_lookup_is_exact(spark, tmp_path):
    rng = random.Random(1)
    store = KeyedStore(spark, str(tmp_path), schemas.URLS, "url", slot_rows=7, broadcast_bytes=400)
    store.begin(urls(spark, [f"u{i}" for i in range(50)]))
    stored = {f"u{i}" for i in range(50)}
    for batch in range(6):
        new = {f"u{rng.randrange(400)}" for _ in range(60)} - stored
        store.add(urls(spark, new), batch)
        stored |= new
        asked = [f"u{rng.randrange(400)}" for _ in range(80)] + [None]
        # pieces of 400 bytes: several broadcasts
        assert held(store.lookup(urls(spark, asked))) == sorted(stored & set(asked))
    assert held(store.read()) == sorted(stored)
    assert held(store.lookup(urls(spark, []))) == []
    before = held(store.read(before=5))
    assert len(before) < len(stored) and set(before) <= stored


def test_runs_stay_few_and_lookups_small(spark, tmp_path):
    """Fifty batches: neither the runs nor the rows a lookup reads grow with the table."""
    store = KeyedStore(spark, str(tmp_path), schemas.URLS, "url", slot_rows=4)
    store.begin()
    read = []
    for batch in range(50):
        store.add(urls(spark, [f"b{batch}-{i}" for i in range(8)]), batch)
        runs = store.runs()
        assert len(runs) <= 7 and sum(r["rows"] for r in runs) == 8 * (batch + 1)
        sizes = [r["rows"] for r in runs]
        assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))
        keys = urls(spark, [f"asked{batch}-{i}" for i in range(2)]).withColumn("s", keyed_store._slot(F.col("url"), keyed_store.MOST_BITS))
        read.append(rows_in(store, store.paths(runs, {r.s for r in keys.collect()})))
    assert max(read[25:]) <= 2 * max(max(read[:25]), 2 * 4 * 3)
    assert max(read) < 8 * 50 / 4
    # what no batch can need any more is gone
    assert len(files.names(spark, f"{tmp_path}/runs")) <= 16 and len(files.names(spark, f"{tmp_path}/catalog")) == 2


def test_no_exchange_of_stored_rows(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), schemas.URLS, "url")
    store.begin(urls(spark, [f"u{i}" for i in range(500)]))
    asked = spark.createDataFrame([("u1",)], schemas.URLS)
    found = store.lookup(asked, ["url"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Repartition" not in plan
    physical = found._jdf.queryExecution().executedPlan().toString()
    joined = [line for line in physical.splitlines() if "BroadcastHashJoin" in line]
    scan = physical.splitlines()[physical.splitlines().index(joined[0]) + 1 :]
    stored_side = scan[: next(i for i, line in enumerate(scan) if "BroadcastExchange" in line)]
    assert joined and not any("Exchange" in line for line in stored_side)


@pytest.mark.parametrize("point", ["_write", "_publish", "_remove_unread"])
def test_a_batch_that_died_is_run_again(spark, tmp_path, monkeypatch, point):
    """Killed before and in the write of its (merged) run, before and after the catalog."""
    def filled(folder, dies):
        store = KeyedStore(spark, folder, schemas.URLS, "url", slot_rows=3)
        store.begin(urls(spark, ["first"]))
        for batch in range(3):
            rows = urls(spark, [f"{batch}-{i}" for i in range(4)])
            for nth in dies:
                real, calls = getattr(KeyedStore, point), []

                def dying(self, *args, real=real, calls=calls, nth=nth):
                    calls.append(args)
                    if nth:
                        real(self, *args)
                    raise RuntimeError("killed")

                with monkeypatch.context() as patch:
                    patch.setattr(KeyedStore, point, dying)
                    try:
                        store.add(rows, batch)
                    except RuntimeError:
                        pass
            store.add(rows, batch)
            # the same batch once more, as after a lost commit
            store.add(rows, batch)
        return held(store.read()), [r["rows"] for r in store.runs()]

    assert filled(str(tmp_path / "a"), (0, 1)) == filled(str(tmp_path / "b"), ())


def test_order_of_batches_is_kept(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), schemas.URLS, "url")
    with pytest.raises(ValueError, match="begin"):
        store.add(urls(spark, ["a"]), 0)
    store.begin(urls(spark, ["a"]))
    store.begin(urls(spark, ["other"]))
    assert held(store.read()) == ["a"]
    for batch in range(3):
        store.add(urls(spark, [f"b{batch}"]), batch)
    with pytest.raises(ValueError, match="after 0"):
        store.add(urls(spark, ["c"]), 0)


def test_empty_batches(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), schemas.URLS, "url")
    store.begin()
    assert held(store.read()) == [] and held(store.lookup(urls(spark, ["a"]))) == []
    for batch in range(3):
        store.add(urls(spark, []), batch)
    assert store.runs() == [] and store.last() == 2


def test_a_hot_key_keeps_its_rows(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), schemas.DUE, "url", slot_rows=10)
    rows = [(i, "hot" if i % 3 else f"u{i}", 0, None) for i in range(300)]
    store.begin(spark.createDataFrame(rows, schemas.DUE))
    got = store.lookup(urls(spark, ["hot", "u3", "u4"]))
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in rows if r[1] in ("hot", "u3", "u4"))


def test_admission_in_batches_is_admission(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"https://h.com/{rng.randrange(60)}", 50, 1, f"p{rng.randrange(9)}", i) for i in range(300)]
    known = urls(spark, [f"https://h.com/{i}" for i in range(0, 60, 7)])
    store = KeyedStore(spark, str(tmp_path), schemas.URLS, "url", slot_rows=5)
    store.begin(known)
    got = []
    for batch in range(4):
        links = spark.createDataFrame(rows[75 * batch : 75 * batch + 75], LINKS)
        admitted = [r.url for r in frontier.admit_to_store(links, store, batch).collect()]
        store.add(urls(spark, admitted), batch)
        got += admitted
    assert sorted(got) == held(frontier.admit_links(spark.createDataFrame(rows, LINKS), known))


def test_states_are_folded(spark, tmp_path):
    """Rows kept are those of the last events, and a task's state is read from its slots."""
    store = jobs._states(spark, str(tmp_path))
    store.begin()
    events = spark.range(400).select(
        (F.col("id") * 7 % 20).alias("task_id"), F.when(F.col("id") % 2 == 0, "crawling").otherwise("failed").alias("status"),
        F.concat(F.lit("e"), "id").alias("error_message"), F.timestamp_seconds(F.col("id") % 90).alias("ts"), F.col("id").alias("seq"),
    )
    for batch in range(8):
        store.add(events.where(F.col("seq") % 8 == batch), batch)
    assert sum(r["rows"] for r in store.runs()) <= 2 * 20
    want = sorted(frontier.latest_status(events).collect())
    assert sorted(jobs.read_latest_status(spark, str(tmp_path)).collect()) == want
    some = spark.createDataFrame([(3,), (5,), (99,)], "task_id bigint")
    assert sorted(jobs.read_latest_status(spark, str(tmp_path), some).collect()) == [r for r in want if r.task_id in (3, 5)]


def test_a_stream_from_before_the_store_goes_on(spark, tmp_path):
    """Links that were stored without a store are known to it."""
    from webcorpus.sources import sinks, tables

    out = str(tmp_path / "out")
    old = frontier.to_frontier(spark.createDataFrame([("https://h.com/1", 5, 1, "p", 0)], LINKS), CrawlOptions())
    sinks.sink_links(old, f"{out}/links", 7)
    spark.createDataFrame([(f"https://h.com/{i}", 5, 1, "p", i) for i in range(3)], LINKS).write.parquet(f"{tmp_path}/in")
    source = tables.stream_table(spark, f"{tmp_path}/in", old.sparkSession.createDataFrame([], LINKS).schema)
    jobs.stream_admit_links(source, urls(spark, []), CrawlOptions(), out).awaitTermination()
    got = sinks.read_batches(spark, f"{out}/links", schemas.ADMITTED)
    assert sorted(got.where("batch_id = 0").select("url").collect()) == [("https://h.com/0",), ("https://h.com/2",)]
