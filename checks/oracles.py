"""DuckDB statements for the registered queries.

They are written apart from the operators: robots rules are ready-made rows, patterns
are simpler ones that suffice for the given pages, and de-duplication uses windows.
"""

from __future__ import annotations

from checks.fixtures import sql_with
from webcorpus import config


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _alternatives(values: list[str]) -> str:
    return "|".join(v.replace(".", "[.]") for v in values)


_ALLOW = "'^.*[.]example[.](com|net|org|jp)$'"
_BLOCK = "'(?i)" + "|".join(config.BLOCKED_PATTERNS) + "'"
_EXTENSION = "'[.](" + "|".join(e[1:] for e in config.BLOCKED_EXTENSIONS) + ")$'"
_PRIORITY = (
    "cast(case when parent_score >= 80 then greatest(70, parent_score - 10) "
    "when parent_score >= 60 then greatest(55, parent_score - 15) "
    "else greatest(40, parent_score - 10) end as int)"
)
_HOST = "lower(split_part(split_part(url, '/', 3), ':', 1))"
_ORIGIN = "split_part(url, '/', 1) || '//' || split_part(url, '/', 3)"
_ID = "cast('0x' || substr(md5(url), 1, 15) as bigint)"
_BARE = "rtrim(regexp_replace(url, '#.*$', ''), '/')"


# --- languages: pieces over a `host` and a `url` column --------------------------------

_LABELS = "len(string_split(host, '.'))"
_TLD = f"case when {_LABELS} >= 2 then list_last(string_split(host, '.')) end"
_TLD_LANG = (
    f"case {_TLD} "
    + " ".join(f"when '{t}' then '{langs[0]}'" for t, langs in config.TLD_LANGUAGES.items())
    + " end"
)
_SUBDOMAIN = (
    f"case when {_LABELS} >= 3 and regexp_full_match(split_part(host, '.', 1), '[a-z][a-z]') "
    "then split_part(host, '.', 1) end"
)
_PATH = "'/' || split_part(split_part(split_part(url, '#', 1), '?', 1), '/', 4)"
_PATH_LANG = (
    f"case when url like '%://%/%' and regexp_full_match({_PATH}, '/[a-z][a-z](-[a-z][a-z])?') "
    f"then substr({_PATH}, 2, 2) end"
)
_QUERY = "case when contains(split_part(url, '#', 1), '?') then regexp_replace(split_part(url, '#', 1), '^[^?]*', '') else '' end"
_QUERY_LANG = f"nullif(regexp_extract({_QUERY}, '[?&](lang|language|locale)=([a-z][a-z])', 2), '')"
_ALLOWLISTED = f"regexp_matches(host, '(^|[.])({_alternatives(config.LANGUAGE_ALLOWLIST)})$')"
_NON_EU = f"coalesce({_TLD} in {_in(config.NON_EU_TLDS)}, false)"
_PREDICTED = (
    f"case when {_ALLOWLISTED} then null else coalesce({_TLD_LANG}, {_SUBDOMAIN}, {_PATH_LANG}, "
    f"{_QUERY_LANG}, case when {_NON_EU} then 'SKIP' end) end"
)
_KEPT_LANGUAGE = f"(lang is null or lang in {_in(config.EU_LANGUAGES)})"

_DECODE = (
    "replace(replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), "
    "'&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
)


def _decode(text: str) -> str:
    return _DECODE.replace("{x}", text)


_VISIBLE = "'(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->'"
_MAIN = (
    "'(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<nav>.*?</nav>|<footer>.*?</footer>'"
)
_BLOCK_TAG = (
    "'(?i)</?(html|head|body|article|div|h1|p|br|ul|li|nav|footer)( [^>]*)?>'"
)


def _blocks(html: str) -> str:
    text = f"regexp_replace({html}, '<title>.*?</title>', '')"
    # chr(1) parts blocks: a line break of the source is white space within a block
    text = f"regexp_replace({text}, {_BLOCK_TAG}, chr(1), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    lines = f"string_split({_decode(text)}, chr(1))"
    return (
        f"list_filter(list_transform({lines}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), "
        "lambda x: x <> '')"
    )


def _text_of(blocks: str) -> str:
    return f"array_to_string({blocks}, chr(10))"


def _content_tables(name: str, source: str) -> dict[str, str]:
    """Blocks, site templates and main texts of the pages in `source`."""
    blocks, templates, kept, texts = (
        f"{name}_{kind}" for kind in ("blocks", "templates", "kept", "texts")
    )
    return {
        blocks: f"""
            select page_id, url, {_HOST} as host,
              case when len(main) > 0 then main else shown end as blocks
            from (select page_id, url, {_blocks(f"regexp_replace(html, {_MAIN}, '', 'g')")} as main,
              {_blocks(f"regexp_replace(html, {_VISIBLE}, '', 'g')")} as shown from {{{source}}})""",
        templates: f"""
            select b.host, b.block from (
              select host, block, count(distinct page_id) as n
              from (select host, page_id, unnest(blocks) as block from {{{blocks}}}) group by host, block
            ) b join (select host, count(*) as n from {{{blocks}}} group by host) h on b.host = h.host
            where b.n >= 3 and b.n >= h.n * 0.5""",
        kept: f"""
            select page_id, block, position from (
              select host, page_id, unnest(blocks) as block, generate_subscripts(blocks, 1) as position
              from {{{blocks}}}) b
            where not exists (
              select 1 from {{{templates}}} t where t.host = b.host and t.block = b.block)""",
        texts: f"""
            select p.page_id, p.url, coalesce(k.text, {_text_of('p.blocks')}) as text
            from {{{blocks}}} p left join (
              select page_id, string_agg(block, chr(10) order by position) as text
              from {{{kept}}} group by page_id) k on k.page_id = p.page_id""",
    }


LIBRARY: dict[str, str] = {
    # --- links ---
    "bases": f"""
        select *, regexp_replace(path, '[^/]*$', '') as dir,
          regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') as up
        from (select *, split_part(rest, '?', 1) as path,
            substr(rest, length(split_part(rest, '?', 1)) + 1) as tail
          from (select page_id, url, html, {_ORIGIN} as origin,
              substr(split_part(url, '#', 1), length({_ORIGIN}) + 1) as rest
            from {{anchors_x}}))""",
    "anchors": f"""
        select page_id, url, origin, path, tail, up, unnest(hrefs) as href,
          cast(generate_subscripts(hrefs, 1) - 1 as int) as position
        from (select *, list_transform(regexp_extract_all(regexp_replace(html, {_VISIBLE}, '', 'g'),
            '<a href="([^"]*)"', 1), lambda h: replace(h, '&amp;', '&')) as hrefs from {{bases}})""",
    "resolved": """
        select *, case
          when href like 'mailto:%' or href like 'http%' then href
          when href like '//%' then split_part(url, '/', 1) || href
          when href like '/%' then origin || href
          when href like '?%' then origin || path || href
          when href like '#%' then origin || path || tail || href
          when href like '../%' then origin || up || substr(href, 4)
          else origin || path || tail end as target
        from {anchors}""",
    "normalized": """
        select page_id, url as parent_url, href, position,
          rtrim(regexp_replace(target, '#.*$', ''), '/') as url
        from {resolved}""",
    # positions count the non-blank anchors
    "numbered": """
        select page_id, parent_url, url,
          cast(row_number() over (partition by page_id order by position) - 1 as int) as position
        from {normalized} where trim(href) <> ''""",
    "good": f"""
        select * from {{numbered}}
        where split_part(url, ':', 1) in ('http', 'https')
          and regexp_matches(split_part(url, '/', 3), {_ALLOW})
          and not regexp_matches(url, {_BLOCK})
          and not regexp_matches(lower(split_part(url, '?', 1)), {_EXTENSION})""",
    "page_links": """
        select page_id, parent_url, url,
          cast(row_number() over (partition by page_id order by position) - 1 as int) as position
        from (select *, row_number() over (partition by page_id, url order by position) as nth
          from {good}) where nth = 1""",
    "discovered": f"""
        select l.page_id, l.parent_url, l.url, l.position, cast(s.depth + 1 as int) as depth,
          {_PRIORITY} as priority
        from {{page_links}} l join {{scored_x}} s on l.page_id = s.page_id
        where s.parent_score >= 60 and s.depth < 3""",
    "known": "select distinct url from {page_links} where page_id % 2 = 0",
    "admitted": """
        select url, priority, depth, parent_url from (
          select *, row_number() over (partition by url order by parent_url, position) as nth
          from {discovered}) where nth = 1 and url not in (select url from {known})""",
    # --- frontier expansion ---
    "graph_pages": f"""
        select page_id, parent_score, {_BARE} as url, {_ORIGIN} as origin,
          regexp_extract_all(regexp_replace(html, {_VISIBLE}, '', 'g'), '<a href="([^"]*)"', 1) as hrefs
        from {{graph_x}}""",
    "graph_links": """
        select url as parent_url, parent_score, position, rtrim(regexp_replace(case
            when href like '/%' then origin || href else href end, '#.*$', ''), '/') as url
        from (select url, origin, parent_score, unnest(hrefs) as href,
          generate_subscripts(hrefs, 1) as position from {graph_pages})""",
    "edges": f"""
        select parent_url, url, min(position) as position, min({_PRIORITY}) as priority
        from {{graph_links}}
        where regexp_matches(split_part(url, '/', 3), {_ALLOW})
          and not regexp_matches(url, {_BLOCK})
          and not regexp_matches(lower(split_part(url, '?', 1)), {_EXTENSION})
        group by parent_url, url""",
    "seeds": f"""
        select distinct {_BARE} as url
        from (select arg_min(url, page_id) as url from {{graph_x}} group by {_HOST})""",
    "seen": f"select url from {{seeds}} union select {_BARE} from {{graph_x}} where page_id % 10 = 9",
    "full_pages": f"select {_BARE} as url from {{page_blocks}} where length({_text_of('blocks')}) >= 50",
    "hop1": """
        select e.url, arg_min(e.priority, e.parent_url) as priority, 1 as depth,
          min(e.parent_url) as parent_url
        from {edges} e join {seeds} s on e.parent_url = s.url
        where e.url not in (select url from {seen}) group by e.url""",
    "hop2": """
        select e.url, arg_min(e.priority, e.parent_url) as priority, 2 as depth,
          min(e.parent_url) as parent_url
        from {edges} e join {hop1} s on e.parent_url = s.url
        where e.url not in (select url from {seen}) and e.url not in (select url from {hop1})
        group by e.url""",
    "hop3": """
        select e.url, arg_min(e.priority, e.parent_url) as priority, 3 as depth,
          min(e.parent_url) as parent_url
        from {edges} e join {hop2} s on e.parent_url = s.url
        where e.url not in (select url from {seen}) and e.url not in (select url from {hop1})
          and e.url not in (select url from {hop2}) group by e.url""",
    # --- robots: the texts of the fixture, read by hand ---
    "all_rules": """
        select * from (values
          (0, 0, 0, false, '/en/'),
          (1, 0, 0, false, '/'),
          (1, 1, 0, true, '/fr/'), (1, 1, 1, false, '/fr'), (1, 1, 2, false, '/de/'),
          (2, 0, 0, false, '/es/ x'), (2, 0, 1, false, '/es'),
          (4, 0, 0, true, ''), (4, 0, 1, false, '/'),
          (5, 0, 0, false, '/*.html'), (5, 0, 1, false, '/en/7'), (5, 0, 2, false, '/de/3')
        ) r(kind, entry_no, rule_no, allow, path)""",
    "chosen": """
        select * from (values (0, 0, 2.0), (1, 1, null), (2, 0, 5.0), (4, 0, 0.0), (5, 0, null))
        c(kind, entry_no, crawl_delay)""",
    "kinds": "select origin, length(origin) % 8 as kind from {robots_raw_x}",
    "decided": f"""
        select t.id, any_value(t.url) as url, any_value(t.status) as status,
          any_value(cast(c.crawl_delay as double)) as robots_delay,
          coalesce(arg_min(r.allow, r.rule_no), true) as allowed
        from (select *, {_ORIGIN} as origin,
            coalesce(nullif(substr(url, length({_ORIGIN}) + 1), ''), '/') as local from {{tasks_x}}) t
          left join {{kinds}} k on k.origin = t.origin
          left join {{chosen}} c on c.kind = k.kind
          left join {{all_rules}} r on r.kind = c.kind and r.entry_no = c.entry_no
            and starts_with(t.local, r.path)
        group by t.id""",
    # --- content ---
    **_content_tables("page", "pages"),
    **_content_tables("meta", "meta_x"),
    "titles": f"""
        select page_id, nullif(trim(regexp_replace({_decode("regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")},
          '\\s+', ' ', 'g')), '') as title from {{pages}}""",
    "meta_values": """
        select page_id, case when page_id % 3 = 1 then 'sk' else regexp_extract(html, '<html lang="([a-z]+)"', 1) end as language,
          case when page_id % 3 = 0 then 'A. Writer & Co' end as author,
          case page_id % 3 when 0 then '2024-03-05' when 2 then '2023-11-30' end as date
        from {meta_x}""",
    "contents": f"""
        select t.page_id, t.url, t.text, i.title, m.language, m.author, m.date
        from {{meta_texts}} t join {{titles}} i on i.page_id = t.page_id
          join {{meta_values}} m on m.page_id = t.page_id
        where length(t.text) >= 50""",
    # --- a crawl batch ---
    "batch": f"""
        select d.id, d.url, case when message is null then 'completed' else 'failed' end as status,
          message as error_message, i.title, f.text,
          regexp_extract(p.html, '<html lang="([a-z]+)"', 1) as language
        from (select d.id, d.url, case
              when not d.allowed then 'Disallowed by robots.txt'
              when f.error_kind = 'request' then 'Request error: ' || f.error
              when f.error_kind = 'other' then 'Unexpected error: ' || f.error
              when f.http_status not between 200 and 299 then 'HTTP ' || f.http_status
              when not contains(lower(coalesce(f.content_type, '')), 'text/html')
                then 'Not HTML: ' || coalesce(f.content_type, '')
              when trim(f.html) = '' or length({_text_of('b.blocks')}) < 50
                then 'Content extraction failed'
            end as message
          from {{decided}} d join {{fetches_x}} f on f.url = d.url
            join {{page_blocks}} b on b.page_id = d.id) d
        join (select page_id, {_text_of('blocks')} as text from {{page_blocks}}) f on f.page_id = d.id
        join {{titles}} i on i.page_id = d.id join {{pages}} p on p.page_id = d.id""",
    "batch_links": f"""
        select page_id, parent_url, url, position from (
          select d.page_id, d.parent_url, d.url, row_number() over (partition by d.page_id order by d.position) as position
          from (select *, {_PREDICTED} as lang from (select *, {_HOST} as host from {{discovered}})) d
          where {_KEPT_LANGUAGE}
            and d.page_id in (select id from {{batch}} where status = 'completed'))""",
    "batch_admitted": """
        select url, parent_url from (
          select *, row_number() over (partition by url order by parent_url, position) as nth
          from {batch_links}) where nth = 1 and url not in (select url from {known})""",
    # --- redirects: chains have three steps at most, or are loops ---
    "moves": """
        select url, regexp_replace(location, '#.*$', '') as target from {moved_x}
        where http_status in (301, 302, 303, 307, 308) and location is not null""",
    "walks": """
        select a.url, case when d.url is null then coalesce(c.target, b.target, a.target) end as final_url,
          case when d.url is null then cast(1 + count(b.url) + count(c.url) as bigint) end as hops
        from {moves} a left join {moves} b on b.url = a.target left join {moves} c on c.url = b.target
          left join {moves} d on d.url = c.target
        group by a.url, a.target, b.target, c.target, d.url""",
    "chains": """
        select url, final_url, hops, case when final_url is null then 'Redirect loop' when hops > 2 then 'Too many redirects'
          when final_url not in (select url from {moved_x}) then 'Redirect target not stored' end as error
        from {walks}""",
    "hosted": f"select page_id, url, {_HOST} as host from {{urls_x}}",
    "predicted": f"select page_id, url, {_PREDICTED} as lang from {{hosted}}",
    "states": """
        select task_id, last.status as status, last.error_message as error_message from (
          select task_id, arg_max(struct_pack(status := status, error_message := error_message),
            struct_pack(ts := ts, seq := seq)) as last
          from {status_x} group by task_id)""",
}

_EVENTS = """
    select id as task_id, 'crawling' as status, cast(null as varchar) as error_message, cast(0 as bigint) as seq from {batch}
    union all select id, status, error_message, cast(1 as bigint) from {batch}"""
_OUTCOME = "select id, url, status, error_message from {batch} where "

ORACLES: dict[str, str] = {
    "scan_pages": "select page_id, url, html from {pages}",
    "scan_frontier": "select id, url, priority, domain, status from {tasks_x}",
    "scan_robots": "select origin, case when http_status = 200 then body end as body from {robots_raw_x}",
    "sink_content": "select page_id as id, url, title, text as content, language, author, date from {contents}",
    "sink_links": f"select {_ID} as id, url, priority, split_part(url, '/', 3) as domain, 'pending' as status, depth, priority as parent_score, parent_url from {{admitted}}",
    "sink_status": _EVENTS,
    "url_parts": """
        select page_id, case when contains(url, '://') then lower(split_part(url, ':', 1)) else '' end as scheme,
          split_part(url, '/', 3) as netloc,
          case when contains(url, '://') then split_part(regexp_replace(split_part(url, '#', 1), '^[a-z]+://[^/]*', ''), '?', 1) else url end as path,
          case when contains(split_part(url, '#', 1), '?') then split_part(split_part(url, '#', 1), '?', 2) else '' end as query,
          split_part(url, '#', 2) as fragment
        from {urls_x}""",
    "url_origin": f"select {_ORIGIN} as origin, count(*) as pages from {{pages}} group by 1",
    "url_robots": f"select {_ORIGIN} || '/robots.txt' as robots_url, count(*) as pages from {{pages}} group by 1",
    "url_domain": "select split_part(url, '/', 3) as domain, count(*) as pages from {urls_x} group by 1",
    "url_host": f"select {_HOST} as host, count(*) as pages from {{urls_x}} group by 1",
    "url_resolve": "select page_id, position, href, target as url from {resolved}",
    "url_defrag": "select page_id, regexp_replace(url, '#.*$', '') as url from {pages}",
    "url_strip_slash": "select page_id, regexp_replace(url, '/+$', '') as url from {pages}",
    "url_normalize": "select page_id, position, url from {normalized}",
    "next_tasks": "select id, url, priority, domain, status, depth, parent_score from {tasks_x} where status = 'pending' order by priority desc, id limit 10",
    "status_transitions": _EVENTS,
    "task_latest_status": "select task_id, status, error_message from {states}",
    "admit_links": "select url, priority, depth, parent_url from {admitted}",
    "admit_counts": """
        select a.n as added, cast(d.n - a.n as bigint) as skipped, d.n as total
        from (select count(*) as n from {admitted}) a, (select count(*) as n from {discovered}) d""",
    "link_cap": "select parent_url, position, url from {discovered} where position < 5",
    "default_priority": "select parent_url, url, cast(6 as int) as priority from {discovered}",
    "frontier_expand": """
        select url, priority, depth, parent_url from {hop1} union all
        select url, priority, depth, parent_url from {hop2} union all
        select url, priority, depth, parent_url from {hop3}""",
    "robots_parse": "select k.origin, r.entry_no, r.rule_no, r.allow, r.path from {kinds} k join {all_rules} r on r.kind = k.kind",
    "robots_select": """
        select k.origin, any_value(cast(c.crawl_delay as double)) as crawl_delay,
          string_agg(r.path, ' ' order by r.rule_no) as paths
        from {kinds} k left join {chosen} c on c.kind = k.kind
          left join {all_rules} r on r.kind = c.kind and r.entry_no = c.entry_no
        group by k.origin""",
    "robots_allowed": "select id, url, allowed from {decided}",
    "robots_delay": "select id, robots_delay from {decided}",
    "robots_at_fetch": """
        select id, allowed or not held as allowed, case when held then robots_delay end as robots_delay
        from (select *, id % 30 between 10 and 19 or id % 30 >= 25 as held from {decided})""",
    "effective_delay": "select id, case when robots_delay > 0 then robots_delay else 1.0::double end as delay from {decided}",
    "robots_gate": """
        select id, url, case when not allowed then 'Disallowed by robots.txt' end as error_message,
          case when allowed then status else 'failed' end as status from {decided}""",
    "redirect_chains": "select url, final_url, hops, error from {chains}",
    "crawl_redirected": f"""
        select id, url, case when message is null then 'completed' else 'failed' end as status, message as error_message,
          case when message is null then md5(text) end as text_md5
        from (select d.id, regexp_replace(d.url, '#.*$', '') as url, {_text_of('b.blocks')} as text, case
            when not d.allowed then 'Disallowed by robots.txt'
            when c.error is not null then 'Request error: ' || c.error
            when f.error_kind = 'request' then 'Request error: ' || f.error
            when f.error_kind = 'other' then 'Unexpected error: ' || f.error
            when f.http_status not between 200 and 299 then 'HTTP ' || f.http_status
            when not contains(lower(coalesce(f.content_type, '')), 'text/html') then 'Not HTML: ' || coalesce(f.content_type, '')
            when trim(f.html) = '' or length({_text_of('b.blocks')}) < 50 then 'Content extraction failed' end as message
          from {{decided}} d left join {{chains}} c on c.url = regexp_replace(d.url, '#.*$', '')
            left join {{moved_x}} f on f.url = coalesce(c.final_url, regexp_replace(d.url, '#.*$', ''))
            left join {{page_blocks}} b on b.page_id = f.page_id)""",
    "stored_frontier": "select url from {known} union select url from {admitted}",
    "html_deep_regions": f"select page_id, regexp_replace(html, {_MAIN}, '', 'g') as html from {{pages}}",
    "html_link_density": """
        select page_id, unnest(blocks) as block, cast(generate_subscripts(blocks, 1) - 1 as int) as pos
        from {page_blocks}""",
    "outcome_classify": "select id, url, status, error_message from {batch}",
    "outcome_robots": _OUTCOME + "error_message = 'Disallowed by robots.txt'",
    "outcome_request_error": _OUTCOME + "error_message like 'Request error: %'",
    "outcome_http_error": _OUTCOME + "error_message like 'HTTP %'",
    "outcome_not_html": _OUTCOME + "error_message like 'Not HTML: %'",
    "outcome_no_content": _OUTCOME + "error_message = 'Content extraction failed'",
    "outcome_unexpected": _OUTCOME + "error_message like 'Unexpected error: %'",
    "outcome_completed": _OUTCOME + "status = 'completed'",
    "size_guard": "select page_id, cast(length(html) as int) as chars from {pages} where length(html) <= 3000",
    "html_blank_guard": "select page_id, url from {fetches_x} where trim(html) <> ''",
    "html_visible": f"select page_id, regexp_replace(html, {_VISIBLE}, '', 'g') as html from {{pages}}",
    "html_boilerplate_regions": f"select page_id, regexp_replace(html, {_MAIN}, '', 'g') as html from {{pages}}",
    "html_blocks": """
        select page_id, unnest(blocks) as block, cast(generate_subscripts(blocks, 1) - 1 as int) as pos
        from {page_blocks}""",
    "html_unescape": f"select page_id, {_decode('html')} as html from {{pages}}",
    "html_template_blocks": "select host, md5(block) as block_md5 from {page_templates}",
    "html_main_text": "select page_id, text from {page_texts}",
    "html_title": "select page_id, title from {titles}",
    "html_language": "select page_id, language from {meta_values}",
    "html_author": "select page_id, author from {meta_values}",
    "html_date": "select page_id, date from {meta_values}",
    "html_author_marked": """
        select page_id, case page_id % 4 when 0 then 'J. Doe' when 1 then 'R. Roe' when 2 then 'A. One'
          else 'S Tan’s' end as author from {pages}""",
    "html_date_forms": """
        select page_id, case page_id % 4 when 0 then '2024-03-15' when 1 then '2024-03-05' when 2 then '2023-12-31'
          else '2022-03-07' end as date from {pages}""",
    "content_min_length": f"""
        select page_id, length({_text_of('blocks')}) >= 1000 as long_enough from {{page_blocks}}""",
    "extract_content": "select page_id, url, title, text, language, author, date from {contents}",
    "links_gate_score": "select page_id, parent_score from {scored_x} where parent_score >= 60",
    "links_gate_depth": "select page_id, depth from {scored_x} where depth < 3",
    "links_extract": "select page_id, position, href from {anchors}",
    "links_skip_blank": "select page_id, href from {anchors} where trim(href) <> ''",
    "links_normalize": "select page_id, position, url from {numbered}",
    "links_scheme": "select page_id, position, url from {numbered} where regexp_matches(url, '^https?:')",
    "links_domain_allow": f"select page_id, position, url from {{numbered}} where regexp_matches(split_part(url, '/', 3), {_ALLOW})",
    "links_block_pattern": f"select page_id, position, url from {{numbered}} where not regexp_matches(url, {_BLOCK})",
    "links_block_ext": f"select page_id, position, url from {{numbered}} where not regexp_matches(lower(split_part(url, '?', 1)), {_EXTENSION})",
    "links_should_crawl": "select page_id, position, url from {good}",
    "links_priority": f"select page_id, {_PRIORITY} as priority from (select page_id, coalesce(parent_score, 0) as parent_score from {{scored_x}})",
    "links_depth_parent": "select page_id, url, depth, parent_url from {discovered}",
    "links_dedupe": "select page_id, position, url from {page_links}",
    "links_config": f"""
        select distinct n.page_id, n.url, {_PRIORITY} as priority
        from {{numbered}} n join {{scored_x}} s on s.page_id = n.page_id
        where s.parent_score >= 40 and s.depth < 3 and not contains(n.url, '/wiki/')
          and split_part(n.url, '/', 3) in ('docs.python.org', 'en.wikipedia.org')""",
    "discover_links": "select position, url, priority, depth, parent_url from {discovered}",
    "lang_allowlisted": f"select page_id, {_ALLOWLISTED} as allowlisted from {{hosted}}",
    "lang_tld": f"select page_id, {_TLD} as tld from {{hosted}}",
    "lang_tld_map": f"select page_id, {_TLD_LANG} as lang from {{hosted}}",
    "lang_subdomain": f"select page_id, {_SUBDOMAIN} as lang from {{hosted}}",
    "lang_path": f"select page_id, {_PATH_LANG} as lang from {{hosted}}",
    "lang_query": f"select page_id, {_QUERY_LANG} as lang from {{hosted}}",
    "lang_skip": f"select page_id, {_NON_EU} as non_eu from {{hosted}}",
    "lang_unknown": "select page_id, url from {predicted} where lang is null",
    "predict_language": "select page_id, url, lang from {predicted}",
    "filter_language": f"select page_id, url, lang from {{predicted}} where {_KEPT_LANGUAGE}",
    "crawl_batch": """
        select b.id, b.url, b.status, b.error_message,
          case when b.status = 'completed' then b.title end as title,
          case when b.status = 'completed' then b.language end as language,
          case when b.status = 'completed' then md5(b.text) end as text_md5,
          coalesce(l.links, 0) as links
        from {batch} b left join (select page_id, count(*) as links from {batch_links} group by page_id) l
          on l.page_id = b.id""",
    "crawl_site_content": """
        select d.id, md5(t.text) as text_md5
        from {decided} d join {fetches_x} f on f.url = d.url join {page_texts} t on t.page_id = d.id
        where d.allowed and f.error_kind is null and f.http_status between 200 and 299 and trim(f.html) <> ''
          and contains(lower(coalesce(f.content_type, '')), 'text/html') and length(t.text) >= 50""",
    "crawl_two_rounds": f"""
        select distinct {_ID} as id, url, case when url in (select url from {{full_pages}}) then 'completed' else 'failed' end as status
        from (select e.url from {{edges}} e join {{seeds}} s on e.parent_url = s.url
          where e.parent_url in (select url from {{full_pages}})) r
        where url not in (select url from {{seen}}) and url in (select {_BARE} from {{graph_x}})""",
    "crawl_results": "select id, url, title, text, language from {batch} where status = 'completed' order by id limit 20",
    "report_links": """
        select l.parent_url, count(*) as found, count(a.url) as added, count(*) - count(a.url) as skipped
        from {batch_links} l left join {batch_admitted} a on a.url = l.url and a.parent_url = l.parent_url
        group by l.parent_url""",
    "report_content": "select url, coalesce(title, 'N/A') as title, cast(length(text) as int) as text_length, language from {batch} where status = 'completed'",
    "report_outcomes": "select status, error_message, count(*) as tasks from {batch} group by all",
    "stream_crawl": """
        select id as task_id, status, error_message, case when status = 'completed' then title end as title,
          case when status = 'completed' then md5(text) end as text_md5 from {batch}""",
    "stream_admit_links": "select url, split_part(url, '/', 3) as domain, 'pending' as status from {admitted}",
    "stream_latest_status": "select task_id, status, error_message from {states}",
    "stream_language_filter": f"select page_id, url, lang from {{predicted}} where {_KEPT_LANGUAGE}",
}


def statements() -> dict[str, str]:
    """Complete DuckDB statements by query name."""
    return {name: sql_with(text, LIBRARY) for name, text in ORACLES.items()}
