"""The jobs on streams. Every batch writes folders of its own batch id, so a batch that
is run again after a failure leaves the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from webcorpus import schemas
from webcorpus.config import CrawlOptions
from webcorpus.operators import frontier, language, outcomes, robots
from webcorpus.plans.crawl import crawl_batch
from webcorpus.plans.files import exists
from webcorpus.plans.keyed_store import KeyedStore
from webcorpus.plans.storage import scratch, stage
from webcorpus.sources import sinks

# written once a stream has begun, beside its checkpoint
_STARTED = "_started"


def _start(stream: DataFrame, step, out: str, poll: str | None) -> StreamingQuery:
    checkpoint = f"{out}/_checkpoint"
    spark = stream.sparkSession
    if not exists(spark, checkpoint) and exists(spark, f"{out}/{_STARTED}"):
        raise ValueError(f"{out} holds batches of a stream whose checkpoint is gone")

    def numbered(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            batch.sparkSession.range(0).write.mode("overwrite").parquet(f"{out}/{_STARTED}")
            step(batch, batch_id)

    writer = stream.writeStream.foreachBatch(numbered).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    if poll is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=poll).start()


def _written_before(spark, folder: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """Rows of the earlier batches only: those of a failed attempt do not count."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return sinks.read_batches(spark, folder, schema).where(F.col("batch_id") < batch_id)


def stream_crawl(
    fetches: DataFrame,
    tasks: DataFrame,
    rules: DataFrame,
    known: DataFrame,
    options: CrawlOptions,
    out: str,
    templates: DataFrame | None = None,
    poll: str | None = None,
) -> StreamingQuery:
    """Crawl batches over a stream of fetches: links, then content, then status.

    Writes `out/links`, `out/content` and `out/status`. `poll` is the trigger interval
    of an endless run; None processes what is there and stops. Tasks and known URLs are put
    into stores under `out` when the stream first starts; a batch then looks up those it
    meets, so what it reads does not grow with them. Tasks refused by robots rules have no
    fetch: `settle_refused` stores their outcome.
    """
    spark = fetches.sparkSession
    staged_rules = stage(rules, "stream-rules")
    due = KeyedStore(spark, f"{out}/tasks", schemas.DUE, "url")
    with scratch(spark):
        due.begin(tasks)
    seen = _known_urls(spark, known, out)

    def step(batch: DataFrame, batch_id: int) -> None:
        # where a URL is in many fetches or tasks, only URLs are compared
        own = stage(due.lookup(stage(batch.select("url"), "fetched-urls")), "own-tasks")
        result = crawl_batch(own, staged_rules, batch, options, templates)
        refused = result.outcomes.where(F.col("error_message").eqNullSafe(outcomes.DISALLOWED))
        status = result.status.join(refused.select(F.col("id").alias("task_id")), "task_id", "left_anti")
        _admit(result.links, seen, options, out, batch_id)
        sinks.sink_content(result.content, f"{out}/content", batch_id)
        sinks.sink_status(status, f"{out}/status", batch_id)

    return _start(fetches, step, out, poll)


def _known_urls(spark, known: DataFrame, out: str) -> KeyedStore:
    """The store of all URLs that are known, begun with those known before the stream and
    those that batches of it have stored without a store."""
    seen = KeyedStore(spark, f"{out}/frontier", schemas.URLS, "url")
    if seen.last() is None:
        first = known.select("url").where(F.col("url").isNotNull())
        if exists(spark, f"{out}/links"):
            first = first.union(sinks.read_batches(spark, f"{out}/links", schemas.ADMITTED).select("url"))
        with scratch(spark):
            seen.begin(first.distinct())
    return seen


def _admit(links: DataFrame, seen: KeyedStore, options: CrawlOptions, out: str, batch_id: int) -> None:
    """Stores the links to URLs that no earlier batch has, and makes those URLs known."""
    admitted = stage(frontier.admit_to_store(links, seen, batch_id), "admitted")
    sinks.sink_links(frontier.to_frontier(admitted, options), f"{out}/links", batch_id)
    seen.add(admitted.select("url"), batch_id)


def settle_refused(
    tasks: DataFrame, rules: DataFrame, options: CrawlOptions, out: str, run: int
) -> None:
    """Stores the outcome of tasks that robots rules refuse, as run `run` of `out/refused`.

    Run it whenever tasks were added: those that an earlier run stored are left out, and the
    same run again replaces its rows.
    """
    gated = robots.robots_gate(tasks, rules, options, ["id"])
    refused = gated.where(~F.col("allowed")).select(
        "id", F.lit("failed").alias("status"), F.lit(outcomes.DISALLOWED).alias("error_message")
    )
    stored = _written_before(tasks.sparkSession, f"{out}/refused", schemas.STATUS_EVENTS, run)
    fresh = refused.join(stored.select(F.col("task_id").alias("id")).distinct(), "id", "left_anti")
    sinks.sink_status(frontier.status_transitions(fresh), f"{out}/refused", run)


def stream_admit_links(
    links: DataFrame, known: DataFrame, options: CrawlOptions, out: str, poll: str | None = None
) -> StreamingQuery:
    """Exact de-duplication across batches against the stored frontier in `out/frontier`: a
    batch reads the slots its URLs hash to, however many URLs are known."""
    seen = _known_urls(links.sparkSession, known, out)

    def step(batch: DataFrame, batch_id: int) -> None:
        _admit(batch, seen, options, out, batch_id)

    return _start(links, step, out, poll)


def _states(spark, out: str) -> KeyedStore:
    return KeyedStore(spark, f"{out}/state", schemas.STATUS_EVENTS, "task_id", frontier.latest_events)


def stream_latest_status(events: DataFrame, out: str, poll: str | None = None) -> StreamingQuery:
    """Latest state per task, in the store `out/state`: each batch adds the last event it has
    of a task, and merges fold those of several batches. A task is in about log2(batches)
    runs at most, and batches that are run again change nothing."""
    store = _states(events.sparkSession, out)
    store.begin()

    def step(batch: DataFrame, batch_id: int) -> None:
        store.add(batch, batch_id)

    return _start(events, step, out, poll)


def read_latest_status(spark, out: str, tasks: DataFrame | None = None) -> DataFrame:
    """Current state per task, of all or of those in `tasks` `(task_id)`: then only the slots
    they hash to are read. Reads the runs of the store, not the history of events."""
    store = _states(spark, out)
    found = store.read() if tasks is None else store.lookup(tasks)
    return found.select("task_id", "status", "error_message")


def stream_language_filter(urls: DataFrame, options: CrawlOptions) -> DataFrame:
    """Prediction and filter on a stream of URLs; no state."""
    return language.filter_language(language.with_language(urls), options)


def write_stream(rows: DataFrame, out: str, poll: str | None = None) -> StreamingQuery:
    """Append a stream to Parquet files; the file sink commits each batch once."""
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", f"{out}/_checkpoint").option("path", f"{out}/rows")
    if poll is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=poll).start()
