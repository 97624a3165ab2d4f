"""Tables derived from the driver's tables, in SQL that Spark and DuckDB both read.

The given pages have neither status codes nor robots texts nor links to each other;
these statements add them. Every statement covers the whole table. ``{name}`` stands
for an input table or for another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from webcorpus import schemas

#: Hosts that the links of the derived pages may point to.
ALLOWED = [r".*\.example\.(com|net|org|jp)$"]

# robots texts, lines separated by "|" here
ROBOTS_TEXTS = {
    0: "User-agent: *|Disallow: /en/|Crawl-delay: 2",
    1: "User-agent: otherbot|Disallow: /||User-agent: *|Allow: /fr/|Disallow: /fr|Disallow: /de/",
    2: "# all|User-agent: webcorpusbot|User-agent: x|Crawl-delay: 5|Disallow: /es/%20x|Disallow: /es|Sitemap: /s.xml",
    3: "User-agent: *||Disallow: /",
    4: "User-agent: *|Disallow:|Disallow: /|Crawl-delay: 0",
    5: "User-agent: *|  |Disallow: /*.html|Disallow: /en/7|Disallow: /de/3",
    6: "",
}


def _robots_case() -> str:
    whens = []
    for number, text in ROBOTS_TEXTS.items():
        lines = " || chr(10) || ".join(f"'{line}'" for line in text.split("|"))
        whens.append(f"when {number} then {lines}")
    return "case length(origin) % 8 " + " ".join(whens) + f" else {_text_sql(0)} end"


def _text_sql(number: int) -> str:
    return " || chr(10) || ".join(f"'{line}'" for line in ROBOTS_TEXTS[number].split("|"))


_EXTRA_ANCHORS = "".join(
    f'<a href="{href}">x</a>'
    for href in [
        "../x", "?q=1", "//h.example.com/y/", "mailto:a@b", "/login", "/api/v1", "/doc.PDF",
        "#top", " ", "/s?a=1&amp;b=2", "https://docs.python.org/3/library/#x",
        "https://en.wikipedia.org/wiki/Spark", "https://www.example.jp/page", "/The",
    ]
)

_BASE = "split_part(url, '/', 1) || '//' || split_part(url, '/', 3)"

STATEMENTS: dict[str, str] = {
    "urls_x": """
        select page_id, case page_id % 20
          when 0 then replace(url, '.example.', '.example.sk/')
          when 1 then replace(url, '.example.', '.example.at/')
          when 2 then replace(url, '.example.', '.example.be/')
          when 3 then replace(url, '.example.', '.example.eu:8080/')
          when 4 then replace(url, '.example.', '.EXAMPLE.UK/')
          when 5 then 'https://www.example.jp/' || cast(page_id as string)
          when 6 then 'https://example.us/item/' || cast(page_id as string)
          when 7 then replace(url, '.example.', '.example.io/')
          when 8 then replace(url, '://', '://en.')
          when 9 then replace(url, '://', '://xx.yy.')
          when 10 then 'https://shop.example.com/p?id=' || cast(page_id as string) || '&language=deutsch'
          when 11 then 'https://shop.example.com/p?locale=FR&lang=fr_' || cast(page_id as string)
          when 12 then 'https://en.wikipedia.org/wiki/' || cast(page_id as string)
          when 13 then 'https://notbbc.com/fr/' || cast(page_id as string)
          when 14 then 'https://news.bbc.co.uk/de/' || cast(page_id as string)
          when 15 then 'https://example.com/pt-br/' || cast(page_id as string)
          when 16 then 'not-a-url-' || cast(page_id as string)
          when 17 then 'https://m.example.kr/EN/' || cast(page_id as string)
          else url end as url
        from {pages}""",
    "tasks_x": """
        select p.page_id as id, p.url as url, cast(p.page_id * 37 % 100 as int) as priority,
          split_part(p.url, '/', 3) as domain,
          case p.page_id % 5 when 0 then 'completed' when 1 then 'crawling' else 'pending' end as status,
          cast(p.page_id % 4 as int) as depth,
          cast(l.quality * 40 + 20 + p.page_id % 41 as int) as parent_score
        from {pages} p left join {labels} l on p.page_id = l.doc_id""",
    "robots_raw_x": f"""
        select origin, cast(case length(origin) % 8 when 7 then 404 else 200 end as int) as http_status,
          {_robots_case()} as body
        from (select distinct {_BASE} as origin from {{pages}}) o""",
    "fetches_x": """
        select page_id, url,
          cast(case page_id % 11 when 1 then 404 when 2 then 503 when 6 then null when 7 then null
            else 200 end as int) as http_status,
          case page_id % 11 when 3 then 'application/pdf' when 4 then 'TEXT/HTML; charset=utf-8'
            when 5 then null when 6 then null when 7 then null else 'text/html' end as content_type,
          case page_id % 11 when 6 then null when 7 then null when 8 then '  ' else html end as html,
          case page_id % 11 when 6 then 'request' when 7 then 'other' else null end as error_kind,
          case page_id % 11 when 6 then 'timed out' when 7 then 'bad gzip' else null end as error
        from {anchors_x}""",
    "anchors_x": f"""
        select page_id, url, replace(html, '<nav>', '<nav>{_EXTRA_ANCHORS}') as html from {{pages}}""",
    "scored_x": """
        select a.page_id as page_id, a.url as url, a.html as html, t.parent_score as parent_score,
          t.depth as depth
        from {anchors_x} a join {tasks_x} t on a.page_id = t.id""",
    "graph_x": """
        select page_id, url, cast(60 + page_id % 41 as int) as parent_score,
          replace(html, '<nav>', '<nav><a href="' || coalesce(n1, '/none') || '">n</a><a href="'
            || coalesce(n2, '/none') || '">n</a>') as html
        from (select page_id, url, html,
            lead(url, 1) over (partition by split_part(url, '/', 3) order by page_id) as n1,
            lead(url, 2) over (partition by split_part(url, '/', 3) order by page_id) as n2
          from {pages}) g""",
    "nested_x": """
        select page_id, url, replace(replace(html, '<article>', '<div id="comments"><div>first</div><div><div>second</div></div></div><article>'),
          '<nav>', '<nav class="a"><ul><li><nav>inner<nav>most</nav></nav></li></ul>rest</nav><nav>') as html
        from {pages}""",
    "deep_x": """
        select page_id, url, replace(html, '<article>', '<div id="comments">' || repeat('<div>a<div>b</div>', 120) || repeat('</div>', 120)
          || 'c</div><article>') as html from {pages}""",
    "menus_x": """
        select page_id, 'https://p' || cast(page_id as string) || '.example.com/' as url,
          replace(replace(html, '<nav>', '<div class="menu">'), '</nav>', '</div>') as html
        from {pages}""",
    "moved_x": """
        select f.page_id as page_id, f.url as url, f.content_type as content_type, f.html as html, f.error_kind as error_kind,
          f.error as error, cast(case when f.page_id % 13 in (1, 2, 3, 6, 8, 9, 10, 12) then
            case f.page_id % 2 when 0 then 301 else 308 end else f.http_status end as int) as http_status,
          case f.page_id % 13 when 1 then n.url when 2 then n.url || '#part' when 3 then n.url when 8 then n.url
            when 9 then n.url when 10 then b.url when 12 then 'https://gone.example.com/' || cast(f.page_id as string) else null end as location
        from {bare_x} f left join {bare_x} n on n.page_id = f.page_id + 1 left join {bare_x} b on b.page_id = f.page_id - 1""",
    "bare_x": """
        select page_id, regexp_replace(url, '#.*$', '') as url, http_status, content_type, html, error_kind, error from {fetches_x}""",
    "meta_x": """
        select page_id, url, case page_id % 3
          when 0 then replace(html, '<meta charset="utf-8">', '<meta charset="utf-8"><meta name="author" content="A. Writer &amp; Co"><meta content="2024-03-05T10:00:00Z" property="article:published_time">')
          when 1 then replace(replace(html, ' lang="', ' data-lang="'), '<meta charset="utf-8">', '<meta charset="utf-8"><meta http-equiv="content-language" content="SK-sk">')
          else replace(html, '<article>', '<article><time datetime="2023-11-30">then</time>') end as html
        from {pages}""",
    "meta_y": """
        select page_id, url, case page_id % 4
          when 0 then replace(html, '</title>', '</title><script type="application/ld+json">' || chr(123) || '"@type": "Article", "author": ' || chr(123)
            || '"@type": "Person", "name": "J. Doe"' || chr(125) || ', "datePublished": "15 March 2024"' || chr(125) || '</script>')
          when 1 then replace(html, '<article>', '<article><p>by <a href="/me" rel="author"><b>R. Roe</b></a> on <span itemprop="datePublished" content="2024/3/5">a day</span></p>')
          when 2 then replace(html, '</title>', '</title><meta name="date" content="20231231"><script type=application/ld+json>' || chr(123) || '"author": ["A. One", "B. Two"]' || chr(125) || '</script>')
          else replace(html, '<article>', '<article><span itemprop=author>S&nbsp Tan&#146;s</span> <time datetime="March 7th, 2022">then</time>') end as html
        from {pages}""",
    "status_x": """
        select user_id as task_id,
          case event_type when 'signup' then 'pending' when 'purchase' then 'completed'
            when 'error' then 'failed' else 'crawling' end as status,
          case event_type when 'error' then 'HTTP ' || cast(400 + event_id % 100 as string)
            else null end as error_message,
          ts, event_id as seq
        from {events}""",
}

# what the derived tables are made of
_INPUTS = ("pages", "labels", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as a DataFrame."""
    if name == "pages":
        return spark.read.schema(schemas.PAGES).parquet(f"{sf_dir}/pages.parquet")
    if name in _INPUTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    statement = STATEMENTS[name]
    needed = set(re.findall(r"\{(\w+)\}", statement))
    return spark.sql(statement, **{n: table(spark, sf_dir, n) for n in needed})


def sql_with(statement: str, library: dict[str, str]) -> str:
    """The statement with every table it needs as a common table expression (DuckDB)."""
    done: list[tuple[str, str]] = []

    def expand(text: str) -> str:
        for needed in re.findall(r"\{(\w+)\}", text):
            if needed not in _INPUTS and all(needed != name for name, _ in done):
                source = STATEMENTS.get(needed) or library[needed]
                done.append((needed, expand(source)))
        return re.sub(r"\{(\w+)\}", r"\1", text).replace(" as string)", " as varchar)")

    final = expand(statement)
    if not done:
        return final.strip()
    return "with " + ",\n".join(f"{n} as ({text})" for n, text in done) + "\n" + final.strip()
