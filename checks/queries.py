"""One registered query per operator. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import ALLOWED, table
from webcorpus import CrawlOptions, schemas
from webcorpus.functions import html, language, linkrules, urls
from webcorpus.operators import content, frontier, links, outcomes, redirects, robots
from webcorpus.operators import language as languages
from webcorpus.plans import crawl
from webcorpus.plans.keyed_store import KeyedStore
from webcorpus.plans.storage import new_folder, stage
from webcorpus.sources import sinks, tables
from webcorpus.streaming import jobs

OPTIONS = CrawlOptions(allowed_domains=ALLOWED)
CAP = 5  # links per page in the queries about the cap

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _url() -> F.Column:
    return F.col("url")


# --- sources and sinks -------------------------------------------------------------


@query
def scan_pages(spark, sf_dir):
    return tables.scan_pages(spark, f"{sf_dir}/pages.parquet")


@query
def scan_frontier(spark, sf_dir):
    feed = new_folder(spark, "task-feed")
    columns = schemas.TASK_FEED.fieldNames()
    table(spark, sf_dir, "tasks_x").select(*columns).write.json(feed)
    return tables.scan_task_feed(spark, feed)


@query
def scan_robots(spark, sf_dir):
    folder = new_folder(spark, "robots")
    table(spark, sf_dir, "robots_raw_x").write.parquet(folder)
    return tables.scan_robots(spark, folder)


def _contents(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "meta_x")
    return content.extract_site_content(pages, OPTIONS)


@query
def sink_content(spark, sf_dir):
    folder = new_folder(spark, "content")
    sinks.sink_content(_contents(spark, sf_dir).withColumnRenamed("page_id", "id"), folder, 0)
    return sinks.read_batches(spark, folder, schemas.PAYLOAD).drop("batch_id")


@query
def sink_links(spark, sf_dir):
    folder = new_folder(spark, "links")
    admitted = frontier.admit_links(_links(spark, sf_dir), _known(spark, sf_dir))
    sinks.sink_links(frontier.to_frontier(admitted, OPTIONS), folder, 0)
    return sinks.read_batches(spark, folder, schemas.ADMITTED).drop("batch_id")


@query
def sink_status(spark, sf_dir):
    folder = new_folder(spark, "status")
    sinks.sink_status(_status_events(spark, sf_dir), folder, 0)
    return sinks.read_batches(spark, folder, schemas.STATUS_EVENTS).drop("batch_id", "ts")


# --- URLs --------------------------------------------------------------------------


@query
def url_parts(spark, sf_dir):
    split = urls.parts(_url()).alias("parts")
    return table(spark, sf_dir, "urls_x").select("page_id", split).select("page_id", "parts.*")


def _count_by(df: DataFrame, name: str, column: F.Column) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("pages"))


@query
def url_origin(spark, sf_dir):
    return _count_by(table(spark, sf_dir, "pages"), "origin", urls.origin(_url()))


@query
def url_robots(spark, sf_dir):
    return _count_by(table(spark, sf_dir, "pages"), "robots_url", urls.robots_url(_url()))


@query
def url_domain(spark, sf_dir):
    return _count_by(table(spark, sf_dir, "urls_x"), "domain", urls.domain(_url()))


@query
def url_host(spark, sf_dir):
    return _count_by(table(spark, sf_dir, "urls_x"), "host", urls.host(_url()))


def _anchors(spark, sf_dir) -> DataFrame:
    """Every anchor with its page: `(page_id, base, position, href)`."""
    anchors = table(spark, sf_dir, "anchors_x").select(
        "page_id",
        _url().alias("base"),
        F.posexplode_outer(html.hrefs(F.col("html"))).alias("position", "href"),
    )
    return anchors.where(F.col("href").isNotNull())


@query
def url_resolve(spark, sf_dir):
    return _anchors(spark, sf_dir).select(
        "page_id", "position", "href", urls.resolve(F.col("base"), F.col("href")).alias("url")
    )


@query
def url_defrag(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.defrag(_url()).alias("url"))


@query
def url_strip_slash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.strip_slash(_url()).alias("url"))


@query
def url_normalize(spark, sf_dir):
    return _anchors(spark, sf_dir).select(
        "page_id", "position", urls.normalize(F.col("base"), F.col("href")).alias("url")
    )


# --- frontier ----------------------------------------------------------------------


@query
def next_tasks(spark, sf_dir):
    return frontier.next_tasks(table(spark, sf_dir, "tasks_x"), 10)


def _outcomes(spark, sf_dir) -> DataFrame:
    return _batch(spark, sf_dir).outcomes


def _status_events(spark, sf_dir) -> DataFrame:
    done = _outcomes(spark, sf_dir)
    return frontier.status_transitions(done, F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query
def status_transitions(spark, sf_dir):
    return _status_events(spark, sf_dir).drop("ts")


@query
def task_latest_status(spark, sf_dir):
    return frontier.latest_status(table(spark, sf_dir, "status_x"))


def _links(spark, sf_dir) -> DataFrame:
    return links.discover_links(table(spark, sf_dir, "scored_x"), OPTIONS)


def _known(spark, sf_dir) -> DataFrame:
    """Links of the pages with an even id count as known already."""
    pages = table(spark, sf_dir, "scored_x").where(F.col("page_id") % 2 == 0)
    every_page = CrawlOptions(allowed_domains=ALLOWED, min_parent_score=0, max_depth=100)
    return links.discover_links(pages, every_page).select("url")


@query
def admit_links(spark, sf_dir):
    admitted = frontier.admit_links(_links(spark, sf_dir), _known(spark, sf_dir))
    return admitted.select("url", "priority", "depth", "parent_url")


@query
def admit_counts(spark, sf_dir):
    return frontier.admit_counts(_links(spark, sf_dir), _known(spark, sf_dir))


@query
def stored_frontier(spark, sf_dir):
    """The frontier after links were admitted in three batches to a store of known URLs."""
    store = KeyedStore(spark, new_folder(spark, "frontier"), schemas.URLS, "url")
    store.begin(_known(spark, sf_dir).distinct())
    found = stage(_links(spark, sf_dir), "links")
    for batch in range(3):
        own = found.where(F.pmod(F.xxhash64("parent_url"), F.lit(3)) == batch)
        store.add(stage(frontier.admit_to_store(own, store, batch), "admitted").select("url"), batch)
    return store.read()


@query
def link_cap(spark, sf_dir):
    return links.cap_links(_links(spark, sf_dir), CAP).select("parent_url", "position", "url")


@query
def default_priority(spark, sf_dir):
    return frontier.with_priority(_links(spark, sf_dir), 6).select("parent_url", "url", "priority")


@query
def frontier_expand(spark, sf_dir):
    pages = table(spark, sf_dir, "graph_x")
    seeds = pages.groupBy(urls.host(_url()).alias("host")).agg(
        F.min_by("url", "page_id").alias("url")
    )
    known = pages.where(F.col("page_id") % 10 == 9).select(
        urls.strip_slash(urls.defrag(_url())).alias("url")
    )
    stored = pages.withColumn("url", urls.strip_slash(urls.defrag(_url())))
    start = seeds.select(urls.strip_slash(urls.defrag(_url())).alias("url"))
    return crawl.frontier_expand(start, stored, known, OPTIONS)


# --- robots ------------------------------------------------------------------------


def _parsed(spark, sf_dir) -> DataFrame:
    return robots.parse_robots(table(spark, sf_dir, "robots_raw_x"))


def _rules(spark, sf_dir) -> DataFrame:
    return robots.rules_for_agent(_parsed(spark, sf_dir), OPTIONS.user_agent)


def _tasks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "tasks_x")


@query
def robots_parse(spark, sf_dir):
    return robots.flat_rules(_parsed(spark, sf_dir))


@query
def robots_select(spark, sf_dir):
    paths = F.array_join(F.transform("rules", lambda r: r["path"]), " ")
    return _rules(spark, sf_dir).select("origin", "crawl_delay", paths.alias("paths"))


@query
def robots_allowed(spark, sf_dir):
    decided = robots.with_robots(_tasks(spark, sf_dir), _rules(spark, sf_dir), ["id"])
    return decided.select("id", "url", "allowed")


@query
def robots_delay(spark, sf_dir):
    decided = robots.with_robots(_tasks(spark, sf_dir), _rules(spark, sf_dir), ["id"])
    return decided.select("id", "robots_delay")


@query
def robots_at_fetch(spark, sf_dir):
    """Every origin has its text from hour 10 on, none from hour 20 on, and again from hour 25 on."""
    raw = table(spark, sf_dir, "robots_raw_x")
    hours = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + n * 3600)
    gone = raw.select("origin", F.lit(404).alias("http_status"), "body", hours(F.lit(20)).alias("fetched_at"))
    texts = raw.select("origin", "http_status", "body", F.explode(F.array(hours(F.lit(10)), hours(F.lit(25)))).alias("fetched_at"))
    rules = stage(robots.rules_by_time(texts.unionByName(gone), OPTIONS.user_agent), "rules-by-time")
    tasks = _tasks(spark, sf_dir).withColumn("fetched_at", hours(F.col("id") % 30))
    return robots.with_robots_at(tasks, rules, ["id"]).select("id", "allowed", "robots_delay")


def _gated(spark, sf_dir) -> DataFrame:
    return robots.robots_gate(_tasks(spark, sf_dir), _rules(spark, sf_dir), OPTIONS, ["id"])


@query
def effective_delay(spark, sf_dir):
    return _gated(spark, sf_dir).select("id", "delay")


@query
def robots_gate(spark, sf_dir):
    message = F.when(~F.col("allowed"), outcomes.DISALLOWED)
    return _gated(spark, sf_dir).select(
        "id", "url", message.alias("error_message"),
        F.when(~F.col("allowed"), "failed").otherwise(F.col("status")).alias("status"),
    )


# --- redirects ---------------------------------------------------------------------


def _moved(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    fetches = table(spark, sf_dir, "moved_x")
    return fetches, redirects.follow_redirects(fetches, max_redirects=2)


@query
def redirect_chains(spark, sf_dir):
    return _moved(spark, sf_dir)[1]


@query
def crawl_redirected(spark, sf_dir):
    """Outcomes and texts of a batch in which chains of redirects are followed."""
    fetches, ends = _moved(spark, sf_dir)
    tasks = _tasks(spark, sf_dir).withColumn("url", F.regexp_replace("url", "#.*$", ""))
    batch = crawl.crawl_batch(tasks, _rules(spark, sf_dir), fetches, OPTIONS, redirected=ends)
    texts = batch.content.select("id", F.md5("text").alias("text_md5"))
    return batch.outcomes.join(texts, "id", "left")


# --- outcomes ----------------------------------------------------------------------


def _batch(spark, sf_dir, staged: bool = False) -> crawl.CrawlBatch:
    return crawl.crawl_batch(
        _tasks(spark, sf_dir), _rules(spark, sf_dir), table(spark, sf_dir, "fetches_x"), OPTIONS,
        staged=staged,
    )


@query
def outcome_classify(spark, sf_dir):
    return _outcomes(spark, sf_dir)


def _outcome_query(name: str, condition: str) -> None:
    def run(spark, sf_dir):
        return _outcomes(spark, sf_dir).where(condition)

    run.__name__ = name
    query(run)


OUTCOME_CONDITIONS = {
    "outcome_robots": "error_message = 'Disallowed by robots.txt'",
    "outcome_request_error": "error_message like 'Request error: %'",
    "outcome_http_error": "error_message like 'HTTP %'",
    "outcome_not_html": "error_message like 'Not HTML: %'",
    "outcome_no_content": "error_message = 'Content extraction failed'",
    "outcome_unexpected": "error_message like 'Unexpected error: %'",
    "outcome_completed": "status = 'completed'",
}
for _name, _condition in OUTCOME_CONDITIONS.items():
    _outcome_query(_name, _condition)


@query
def size_guard(spark, sf_dir):
    guarded = outcomes.size_guard(table(spark, sf_dir, "pages"), 3000)
    return guarded.select("page_id", F.length("html").alias("chars"))


# --- content -----------------------------------------------------------------------


@query
def html_blank_guard(spark, sf_dir):
    fetched = table(spark, sf_dir, "fetches_x")
    return fetched.where(~html.is_blank(F.col("html"))).select("page_id", "url")


@query
def html_visible(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.visible(F.col("html")).alias("html"))


@query
def html_boilerplate_regions(spark, sf_dir):
    """Pages with nested regions put in: they go as wholes."""
    return table(spark, sf_dir, "nested_x").select(
        "page_id", html.without_boilerplate(F.col("html")).alias("html")
    )


@query
def html_deep_regions(spark, sf_dir):
    """Pages with a comment area of 120 elements inside each other put in."""
    return table(spark, sf_dir, "deep_x").select(
        "page_id", html.without_boilerplate(F.col("html")).alias("html")
    )


@query
def html_link_density(spark, sf_dir):
    """Blocks of pages that are alone on their hosts and have menus in no element of navigation."""
    return content.explode_blocks(table(spark, sf_dir, "menus_x"), "page_id")


@query
def html_blocks(spark, sf_dir):
    return content.explode_blocks(table(spark, sf_dir, "pages"), "page_id")


@query
def html_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.unescape(F.col("html")).alias("html"))


@query
def html_template_blocks(spark, sf_dir):
    found = content.site_templates(table(spark, sf_dir, "pages"), OPTIONS)
    return found.select("host", F.explode("templates").alias("key")).select(
        "host", F.lower(F.hex("key")).alias("block_md5")
    )


@query
def html_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    templates = content.site_templates(pages, OPTIONS)
    kept = content.without_templates(content.with_blocks(pages).drop("html"), templates)
    return kept.select("page_id", F.array_join("blocks", "\n").alias("text"))


def _metadata_query(name: str, column: str, source: str) -> None:
    def run(spark, sf_dir):
        return content.with_metadata(table(spark, sf_dir, source)).select("page_id", column)

    run.__name__ = name
    query(run)


_metadata_query("html_title", "title", "pages")
_metadata_query("html_language", "language", "meta_x")
_metadata_query("html_author", "author", "meta_x")
_metadata_query("html_date", "date", "meta_x")
_metadata_query("html_author_marked", "author", "meta_y")
_metadata_query("html_date_forms", "date", "meta_y")


@query
def content_min_length(spark, sf_dir):
    read = content.with_content(
        table(spark, sf_dir, "pages"), CrawlOptions(min_content_chars=1000)
    )
    return read.select("page_id", F.col("text").isNotNull().alias("long_enough"))


@query
def extract_content(spark, sf_dir):
    return _contents(spark, sf_dir)


# --- links -------------------------------------------------------------------------


@query
def links_gate_score(spark, sf_dir):
    return links.score_gate(table(spark, sf_dir, "scored_x"), OPTIONS).select("page_id", "parent_score")


@query
def links_gate_depth(spark, sf_dir):
    return links.depth_gate(table(spark, sf_dir, "scored_x"), OPTIONS).select("page_id", "depth")


@query
def links_extract(spark, sf_dir):
    return _anchors(spark, sf_dir).select("page_id", "position", "href")


@query
def links_skip_blank(spark, sf_dir):
    return _anchors(spark, sf_dir).where(F.col("href").rlike(r"\S")).select("page_id", "href")


def _rows(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.posexplode_outer("links").alias("position", "url"))
    return rows.where(F.col("url").isNotNull())


def _normalized(spark, sf_dir) -> DataFrame:
    pages = links.with_normalized(table(spark, sf_dir, "anchors_x"))
    return _rows(pages)


@query
def links_normalize(spark, sf_dir):
    return _normalized(spark, sf_dir)


def _kept(spark, sf_dir, condition: F.Column) -> DataFrame:
    return _normalized(spark, sf_dir).where(condition)


@query
def links_scheme(spark, sf_dir):
    return _kept(spark, sf_dir, linkrules.valid_scheme(_url()))


@query
def links_domain_allow(spark, sf_dir):
    return _kept(spark, sf_dir, linkrules.allowed_domain(_url(), OPTIONS.domains()))


@query
def links_block_pattern(spark, sf_dir):
    return _kept(spark, sf_dir, ~linkrules.blocked_pattern(_url(), OPTIONS.patterns()))


@query
def links_block_ext(spark, sf_dir):
    return _kept(spark, sf_dir, ~linkrules.blocked_extension(_url(), OPTIONS.extensions()))


@query
def links_should_crawl(spark, sf_dir):
    return _kept(spark, sf_dir, linkrules.should_crawl(_url(), OPTIONS))


@query
def links_priority(spark, sf_dir):
    scored = table(spark, sf_dir, "scored_x")
    return scored.select("page_id", linkrules.priority(F.col("parent_score")).alias("priority"))


@query
def links_depth_parent(spark, sf_dir):
    found = links.discover_links(table(spark, sf_dir, "scored_x"), OPTIONS, ("page_id",))
    return found.select("page_id", "url", "depth", "parent_url")


@query
def links_dedupe(spark, sf_dir):
    pages = links.with_links(table(spark, sf_dir, "anchors_x"), OPTIONS)
    return _rows(pages)


@query
def links_config(spark, sf_dir):
    options = CrawlOptions(
        allowed_domains=[], blocked_patterns=["/wiki/"], blocked_extensions=[], min_parent_score=40
    )
    found = links.discover_links(table(spark, sf_dir, "scored_x"), options, ("page_id",))
    return found.select("page_id", "url", "priority")


@query
def discover_links(spark, sf_dir):
    return _links(spark, sf_dir)


# --- languages ---------------------------------------------------------------------


def _language_query(name: str, column: str, expression: Callable[[F.Column], F.Column]) -> None:
    def run(spark, sf_dir):
        return table(spark, sf_dir, "urls_x").select("page_id", expression(_url()).alias(column))

    run.__name__ = name
    query(run)


_language_query("lang_allowlisted", "allowlisted", language.is_allowlisted)
_language_query("lang_tld", "tld", language.tld)
_language_query("lang_tld_map", "lang", language.from_tld)
_language_query("lang_subdomain", "lang", language.from_subdomain)
_language_query("lang_path", "lang", language.from_path)
_language_query("lang_query", "lang", language.from_query)
_language_query("lang_skip", "non_eu", language.is_non_eu)


def _predicted(spark, sf_dir) -> DataFrame:
    return languages.with_language(table(spark, sf_dir, "urls_x"))


@query
def lang_unknown(spark, sf_dir):
    return _predicted(spark, sf_dir).where(F.col("lang").isNull()).select("page_id", "url")


@query
def predict_language(spark, sf_dir):
    return _predicted(spark, sf_dir)


@query
def filter_language(spark, sf_dir):
    return languages.filter_language(_predicted(spark, sf_dir), OPTIONS)


# --- jobs --------------------------------------------------------------------------


@query
def crawl_batch(spark, sf_dir):
    """Every task of the batch with what became of it."""
    batch = _batch(spark, sf_dir, staged=True)
    # several tasks may have one URL
    found = batch.links.groupBy("task_id").agg(F.count(F.lit(1)).alias("links"))
    texts = batch.content.select(
        "id", "title", "language", F.md5("text").alias("text_md5")
    )
    return (
        batch.outcomes.join(texts, "id", "left")
        .join(found, F.col("id") == F.col("task_id"), "left")
        .select(
            "id", "url", "status", "error_message", "title", "language", "text_md5",
            F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
        )
    )


@query
def crawl_site_content(spark, sf_dir):
    """Contents of a batch without what their sites repeat."""
    templates = content.site_templates(table(spark, sf_dir, "pages"), OPTIONS)
    batch = crawl.crawl_batch(
        _tasks(spark, sf_dir), _rules(spark, sf_dir), table(spark, sf_dir, "fetches_x"), OPTIONS, templates
    )
    return batch.content.select("id", F.md5("text").alias("text_md5"))


@query
def crawl_two_rounds(spark, sf_dir):
    """Links of a first batch are stored as tasks, read back, and crawled in a second one."""
    options = CrawlOptions(allowed_domains=ALLOWED, respect_robots=False, filter_by_language=False)
    stored = table(spark, sf_dir, "graph_x").withColumn("url", urls.strip_slash(urls.defrag(_url())))
    # fetches have one row per URL
    first_page = F.min(F.struct("page_id", "html", "parent_score")).alias("p")
    stored = stored.groupBy("url").agg(first_page).select("url", "p.*")
    fetches = stored.select(
        "url", F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), "html",
        *[F.lit(None).cast("string").alias(c) for c in ("error_kind", "error")],
    )
    seeds = stored.groupBy(urls.host(_url()).alias("host")).agg(F.min_by(F.struct("url", "parent_score"), "page_id").alias("s"))
    seeds = seeds.select("s.*").select(frontier.url_id(_url()).alias("id"), "url", F.lit(0).alias("depth"), "parent_score")
    known = stored.where(F.col("page_id") % 10 == 9).select("url").union(seeds.select("url"))
    first = crawl.crawl_batch(seeds, None, fetches, options)
    folder = new_folder(spark, "two-rounds")
    sinks.sink_links(frontier.to_frontier(frontier.admit_links(first.links, known), options), folder, 0)
    found = tables.scan_frontier(spark, folder)
    second = frontier.next_tasks(found, found.count())
    return crawl.crawl_batch(second, None, fetches, options).outcomes.select("id", "url", "status")


@query
def crawl_results(spark, sf_dir):
    found = crawl.crawl_results(_batch(spark, sf_dir, staged=True).content, 20)
    return found.select("id", "url", "title", "text", "language")


@query
def report_links(spark, sf_dir):
    batch = _batch(spark, sf_dir, staged=True)
    return crawl.report_links(batch.links, _known(spark, sf_dir))


@query
def report_content(spark, sf_dir):
    return crawl.report_content(_batch(spark, sf_dir).content)


@query
def report_outcomes(spark, sf_dir):
    return crawl.report_outcomes(_outcomes(spark, sf_dir))


# --- streams -----------------------------------------------------------------------


def _stream_source(spark, rows: DataFrame, name: str, files: int) -> DataFrame:
    """The rows written as several files and read back as a stream, a file per batch."""
    folder = new_folder(spark, name)
    rows.repartition(files).write.parquet(folder)
    return tables.stream_table(spark, folder, rows.schema, files_per_batch=1)


@query
def stream_crawl(spark, sf_dir):
    out = new_folder(spark, "stream-crawl")
    fetches = _stream_source(spark, table(spark, sf_dir, "fetches_x").drop("page_id"), "fetches", 2)
    rules = _rules(spark, sf_dir)
    known = _known(spark, sf_dir)
    jobs.stream_crawl(fetches, _tasks(spark, sf_dir), rules, known, OPTIONS, out).awaitTermination()
    jobs.settle_refused(_tasks(spark, sf_dir), rules, OPTIONS, out, 0)
    stored = sinks.read_batches(spark, f"{out}/content", schemas.PAYLOAD)
    events = [sinks.read_batches(spark, f"{out}/{name}", schemas.STATUS_EVENTS) for name in ("status", "refused")]
    state = frontier.latest_status(events[0].unionByName(events[1]))
    texts = stored.select(F.col("id").alias("task_id"), "title", F.md5("content").alias("text_md5"))
    return state.join(texts, "task_id", "left")


@query
def stream_admit_links(spark, sf_dir):
    out = new_folder(spark, "stream-links")
    source = _stream_source(spark, _links(spark, sf_dir), "links", 3)
    jobs.stream_admit_links(source, _known(spark, sf_dir), OPTIONS, out).awaitTermination()
    return sinks.read_batches(spark, f"{out}/links", schemas.ADMITTED).select("url", "domain", "status")


@query
def stream_latest_status(spark, sf_dir):
    out = new_folder(spark, "stream-status")
    source = _stream_source(spark, table(spark, sf_dir, "status_x"), "events", 3)
    jobs.stream_latest_status(source, out).awaitTermination()
    return jobs.read_latest_status(spark, out)


@query
def stream_language_filter(spark, sf_dir):
    out = new_folder(spark, "stream-language")
    source = _stream_source(spark, table(spark, sf_dir, "urls_x"), "urls", 2)
    jobs.write_stream(jobs.stream_language_filter(source, OPTIONS), out).awaitTermination()
    return spark.read.schema("page_id bigint, url string, lang string").parquet(f"{out}/rows")
