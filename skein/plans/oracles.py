"""DuckDB SQL for the registered queries, by the same names."""

from __future__ import annotations

from ..functions import text as T
from .derived import ORACLES as _DERIVED_ORACLES
from .queries import EXCLUDE, INCLUDE, KEYWORDS


def _host(u: str = "url") -> str:
    return rf"lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#:]*)', 1))"


def _path(u: str = "url") -> str:
    return rf"coalesce(nullif(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"


def _scheme(u: str = "url") -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z]+):', 1))"


def _norm(u: str = "url", www: bool = True) -> str:
    host = rf"regexp_replace({_host(u)}, '^www\.', '')" if www else _host(u)
    q = rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"
    pairs = f"list_sort(list_transform(list_filter(string_split({q}, '&'), lambda s: s <> ''), lambda s: {{'k': string_split(s, '=')[1], 'v': coalesce(array_to_string(list_slice(string_split(s, '='), 2, 99), '='), '')}}))"
    query = f"array_to_string(list_transform({pairs}, lambda p: p.k || '=' || p.v), '&')"
    return f"({_scheme(u)} || '://' || {host} || CASE WHEN {_path(u)} = '/' THEN '/' ELSE regexp_replace({_path(u)}, '/$', '') END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END)"


def _slug(u: str = "url") -> str:
    return f"regexp_replace(regexp_replace(lower({_host(u)} || {_path(u)}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _plain(x: str) -> str:
    """Entities decoded, white space collapsed."""
    decoded = f"replace(replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"
    return rf"trim(regexp_replace({decoded}, '\s+', ' ', 'g'))"


_LINKS = rf"""l0 AS (SELECT page_id, url AS base, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages),
l1 AS (SELECT page_id, base, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS href FROM l0),
links AS (SELECT page_id, base, pos::BIGINT AS pos, href, {_scheme('base')} || '://' || {_host('base')} || href AS url FROM l1)"""
_GRAPH = f"ends AS MATERIALIZED (SELECT {_norm('base')} AS src, {_norm('url')} AS dst FROM links), graph AS (SELECT src, dst, count(*) AS n FROM ends WHERE src <> dst GROUP BY ALL)"
_ARTICLE = r"""a AS (SELECT page_id, url, html, regexp_extract(html, '<h1>((?s:.*?))</h1>', 1) AS h1, regexp_extract(html, '</h1>((?s:.*?))</article>', 1) AS rest FROM pages),
p AS (SELECT page_id, generate_subscripts(list_slice(string_split(rest, '<p>'), 2, 100000), 1) AS pos, unnest(list_slice(string_split(rest, '<p>'), 2, 100000)) AS raw FROM a),
q AS (SELECT page_id, pos, """ + _plain(r"regexp_replace(regexp_replace(raw, '</p>(?s:.*)$', ''), '<[^>]*>', ' ', 'g')") + r""" AS text FROM p),
r AS (SELECT * FROM q WHERE text <> '')"""
_STRIP = lambda x: rf"regexp_replace({x}, '<[^>]*>', '', 'g')"
_TITLE = _plain(r"regexp_extract(html, '<title>((?s:.*?))</title>', 1)")
_LANG = r"""regexp_extract(html, '<html lang="([^"]*)"', 1)"""
_YAML = lambda x: rf"""CASE WHEN regexp_matches({x}, '[:#''"\n]|^[ {{\[*&!%@`]| $') THEN '"' || replace(replace({x}, '\', '\\'), '"', '\"') || '"' ELSE {x} END"""
_FRONT = rf"""'---' || chr(10) || 'url: ' || url || chr(10) || coalesce('title: ' || {_YAML('title')} || chr(10), '') || 'language: ' || lang || chr(10) || '---' || chr(10)"""



def _entities(rules: tuple[str, ...], text: str = "text", id_: str = "doc_id", frm: str = "documents") -> str:
    def one(r: str) -> str:
        p = T.PATTERNS[r].replace("'", "''")
        return f"SELECT {id_}, '{r}' AS rule, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS match FROM (SELECT {id_}, regexp_extract_all({text}, '{p}', {T.GROUPS.get(r, 0)}) AS m FROM {frm})"

    return " UNION ALL ".join(one(r) for r in rules)


_RULES = ("email", "phone", "ipv4", "card", "semver", "handle")
_WORDS = r"len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+'))"
_DENSITY = lambda k: f"CASE WHEN {_WORDS} > 0 THEN (length(lower(text)) - length(replace(lower(text), '{k}', ''))) / {len(k)}.0 / {_WORDS} ELSE 0 END"
_DERIVED = r"""(SELECT o_orderkey, '# Order ' || o_orderkey || chr(10) || 'Paid $' || floor(o_totalprice)::BIGINT || '.00 on ' || strftime(o_orderdate, '%Y-%m-%d') || ' in #a1b2c3, see [x](https://e.example.com/' || o_orderkey || ') 978-1-23456-789-0' || chr(10) || '## Next' || chr(10) || 'April '
  || strftime(o_orderdate, '%-d') || ', ' || strftime(o_orderdate, '%Y') || ' and ' || strftime(o_orderdate, '%m/%d/%Y') || ' or ' || strftime(o_orderdate, '%Y/%m/%d') || ' by GET /api/v1/orders/' || o_orderkey || ' of github.com/a' || o_orderkey || '/b' || chr(10) || 'mail u' || o_orderkey
  || '@e.example.com, @h' || o_orderkey || ', (555) 123-4567, 10.0.0.' || strftime(o_orderdate, '%-d') || ', v1.2.' || strftime(o_orderdate, '%-d') || ', 4111 1111 1111 1111' AS text FROM orders)"""
_EDGES = """edges AS (
  SELECT 'https://h' || (l_partkey % 3) || '.example.com/p/' || l_partkey AS src, 'https://h' || (l_suppkey % 5) || '.example.com/s/' || l_suppkey AS dst, 'external' AS source FROM lineitem
  UNION SELECT 'https://h' || (l_suppkey % 5) || '.example.com/s/' || l_suppkey, 'https://h' || (l_partkey % 3) || '.example.com/p/' || l_partkey, 'internal' FROM lineitem)"""
_DEEP = lambda depth: f"""WITH RECURSIVE {_EDGES},
t(url, depth) AS (SELECT 'https://h1.example.com/p/1', 0::BIGINT UNION SELECT dst, depth + 1 FROM t JOIN edges ON src = url WHERE depth < {depth}),
d AS (SELECT url, min(depth) AS depth FROM t GROUP BY url)"""  # noqa: E731
_STATUS = "[200, 429, 500, 204, 503, 404, 200, 502][event_id % 8 + 1]"
_ROOT = lambda h: rf"regexp_extract({h}, '([^.]*\.)?[^.]*$', 0)"

ORACLES: dict[str, str] = {
    "url_normalize": f"SELECT page_id, {_norm()} AS norm, {_norm(www=False)} AS with_www FROM pages",
    "url_parts": rf"SELECT page_id, {_scheme()} AS scheme, {_host()} AS host, {_path()} AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, nullif(lower(regexp_extract({_path()}, '\.([^./]+)$', 1)), '') AS extension, {_ROOT(_host())} AS root FROM pages",
    "url_names": f"SELECT page_id, {_slug()} AS slug, regexp_replace(regexp_replace(regexp_replace({_host()} || '_' || {_path()}, '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS filename FROM pages",
    "url_file_paths": f"SELECT page_id, 'out/' || {_slug()} || '.md' AS flat, 'out/' || {_host()} || '/' || array_to_string(list_append(list_filter(string_split({_path()}, '/'), lambda s: s <> ''), 'index.md'), '/') AS mirror FROM pages",
    "url_sanitize": f"SELECT page_id, CASE WHEN page_id % 3 = 2 THEN {_scheme()} ELSE 'https' END || '://' || {_host()} || {_path()} || regexp_extract(url, '^[^?#]*(.*)$', 1) AS clean FROM pages",
    "url_relations": rf"""WITH b AS (SELECT page_id, url, regexp_replace(url, '://(www|m|blog)\.', '://') AS base FROM pages), x AS (SELECT a.page_id, a.url, b.base FROM b a JOIN b ON a.page_id = b.page_id - 1 UNION ALL SELECT page_id, url, base FROM b)
SELECT page_id, base, {_host()} = {_host('base')} AS same, ends_with({_host()}, '.' || {_host('base')}) AS below FROM x""",
    "url_filter": "SELECT page_id, url FROM pages WHERE (" + " OR ".join(f"regexp_matches(url, '{p}')" for p in INCLUDE) + ") AND NOT (" + " OR ".join(f"regexp_matches(url, '{p}')" for p in EXCLUDE) + ")",
    "url_resolve": f"""SELECT page_id, ref, CASE ref WHEN '/a/b?x=1' THEN {_scheme()} || '://' || {_host()} || ref WHEN '?q=2' THEN {_scheme()} || '://' || {_host()} || {_path()} || ref WHEN '//cdn.example.net/lib.js' THEN {_scheme()} || ':' || ref ELSE 'https://other.example.org/' END AS resolved
FROM pages, unnest(['/a/b?x=1', '//cdn.example.net/lib.js', 'https://Other.example.org', '?q=2']) u(ref)""",
    "route_kinds": "SELECT CASE WHEN contains(url, '#') THEN 'hash' ELSE 'history' END AS route, count(*) AS n FROM pages GROUP BY 1",
    "sitemap_probes": f"SELECT DISTINCT {_scheme()} || '://' || {_host()} || p AS probe FROM pages, unnest(['/sitemap.xml', '/sitemap_index.xml', '/sitemap/sitemap.xml', '/sitemaps.xml']) u(p)",
    "content_types": rf"""SELECT page_id, kind, CASE WHEN kind = 'other' THEN 'application/pdf' END AS mime, CASE m WHEN 0 THEN 'html' WHEN 1 THEN 'xml' WHEN 2 THEN 'html' WHEN 3 THEN 'jsonld' ELSE 'html' END AS by_header
FROM (SELECT page_id, page_id % 6 AS m, CASE page_id % 6 WHEN 0 THEN 'html' WHEN 1 THEN CASE WHEN page_id % 4 = 0 THEN 'sitemap' ELSE 'xml' END WHEN 2 THEN 'other' WHEN 3 THEN 'jsonld'
  ELSE CASE WHEN ends_with({_path()}, '.html') THEN 'html' WHEN page_id % 4 = 0 THEN 'sitemap' WHEN page_id % 4 = 1 THEN 'json' ELSE 'html' END END AS kind FROM pages)""",
    "frameworks": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Next.js' WHEN 1 THEN 'React' END AS framework FROM pages",
    "page_metadata": f"SELECT page_id, nullif({_TITLE}, '') AS title, {_LANG} AS language, 0::BIGINT AS keywords FROM pages",
    "page_frontmatter": f"SELECT page_id, {_FRONT} AS front FROM (SELECT *, nullif({_TITLE}, '') AS title, {_LANG} AS lang FROM pages)",
    "node_counts": f"WITH {_ARTICLE} SELECT page_id, 'heading' AS kind, 1::BIGINT AS n FROM a WHERE {_plain('h1')} <> '' UNION ALL SELECT page_id, 'paragraph', count(*) FROM r GROUP BY page_id",
    "heading_nodes": f"WITH {_ARTICLE} SELECT page_id, 1::BIGINT AS level, {_plain('h1')} AS text FROM a WHERE {_plain('h1')} <> ''",
    "paragraph_nodes": f"WITH {_ARTICLE} SELECT page_id, length(text) AS length, md5(text) AS digest FROM r",
    "markdown_render": f"""WITH {_ARTICLE}, m AS (SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS body FROM r GROUP BY page_id),
f AS (SELECT url, nullif({_TITLE}, '') AS title, {_LANG} AS lang, {_plain('h1')} AS h, body FROM a LEFT JOIN m USING (page_id))
SELECT url, coalesce(title, 'Untitled') AS title, regexp_replace({_STRIP(_FRONT + " || chr(10) || CASE WHEN h = '' THEN '' ELSE '# ' || h || chr(10) || chr(10) END || coalesce(body, '')")}, '[ \\t]*\\n+$', '') || chr(10) AS markdown, 200 AS status_code, 'static' AS render_method FROM f""",
    "links_exploded": f"WITH {_LINKS} SELECT page_id, pos, 'page' AS link_type, 'internal' AS category, href, url FROM links",
    "links_by_category": f"WITH {_LINKS} SELECT {_host('base')} AS host, 'internal' AS category, count(*) AS n FROM links GROUP BY 1",
    "links_distinct": f"WITH {_LINKS} SELECT page_id, 'internal' AS category, url, min(pos) AS pos FROM links GROUP BY page_id, url",
    "links_by_page": f"WITH {_LINKS} SELECT page_id, string_agg(url, ' ' ORDER BY pos) AS internal, 0::BIGINT AS external, 0::BIGINT AS subdomains, 0::BIGINT AS resources, 0::BIGINT AS feeds, 0::BIGINT AS sitemaps FROM links GROUP BY page_id",
    "outdegree_topk": f"WITH {_LINKS}, {_GRAPH} SELECT src, count(*) AS degree, sum(n)::BIGINT AS links FROM graph GROUP BY src ORDER BY degree DESC, src LIMIT 10",
    "host_link_matrix": f"WITH {_LINKS} SELECT {_host('base')} AS src_host, {_host('url')} AS dst_host, count(*) AS n FROM links GROUP BY ALL",
    "link_graph_stats": f"WITH {_LINKS}, {_GRAPH} SELECT (SELECT count(*) FROM (SELECT src FROM graph UNION SELECT dst FROM graph)) AS nodes, count(*) AS edges, coalesce(sum(n), 0)::BIGINT AS links FROM graph",
    "srcset_urls": "SELECT page_id, pos::BIGINT AS pos, u FROM (SELECT page_id, generate_subscripts([url, url || '?l=1', '/x.jpg'], 1) - 1 AS pos, unnest([url, url || '?l=1', '/x.jpg']) AS u FROM pages)",
    "refresh_urls": "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL ELSE url END AS target FROM pages",
    "json_nodes": r"""SELECT event_id, 'paragraph' AS kind, key || ': ' || trim(json_extract(props::JSON, '$.' || key)::VARCHAR, '"') AS text FROM (SELECT event_id, props, unnest(json_keys(props::JSON)) AS key FROM events)""",
    "sitemap_entries": f"SELECT {_host()} AS host, url AS loc, (page_id % 10) / 10.0::DOUBLE AS priority FROM pages",
    "rss_items": "SELECT event_type AS title, 'https://e.example.com/' || event_id AS link, 'u' || user_id AS author FROM events",
    "strip_tags": "SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS digest FROM pages",
    "collapse_blank_lines": r"""WITH x AS (SELECT doc_id, CASE WHEN text = '' OR ends_with(replace(text, '.', chr(10)), chr(10)) THEN replace(text, '.', chr(10)) ELSE replace(text, '.', chr(10)) || chr(10) END AS s FROM documents),
y AS (SELECT doc_id, regexp_replace(s, '(?m)^[ \t\r\f\x0B]+$', '', 'g') AS s FROM x)
SELECT doc_id, md5(regexp_replace(regexp_replace(s, '^\n{2,}', chr(10)), '([^\n])\n{3,}', '\1' || chr(10) || chr(10), 'g')) AS digest FROM y""",
    "escape_markdown": r"SELECT doc_id, md5(regexp_replace(text, '([\\*_\[\]()#+\-.!|`])', '\\\1', 'g')) AS digest FROM documents",
    "yaml_escape": f"SELECT conv_id, turn, {_YAML('text')} AS value FROM conversations",
    "tidy_markdown": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '  ' || repeat(chr(10), 4) || '* '), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)^[*+] ', '- ', 'g'), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""",
    "collapse_space": r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents",
    "code_languages": "SELECT page_id, ['python', 'rust', 'c++', NULL, 'js'][page_id % 5 + 1] AS language FROM pages",
    "durations": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN v WHEN 1 THEN v * 1000 WHEN 2 THEN v * 60000 + 5000 WHEN 3 THEN v * 3600000 WHEN 4 THEN v END AS ms FROM (SELECT p_partkey, (p_size % 60)::BIGINT AS v FROM part)",
    "entities": _entities(_RULES),
    "entities_derived": f"SELECT o_orderkey, rule, match FROM ({_entities(tuple(T.PATTERNS), 'text', 'o_orderkey', _DERIVED)})",
    "phones_formatted": rf"SELECT doc_id, regexp_replace(match, '^\+?1?[-. ]?\(?([0-9]{{3}})\)?[-. ]?([0-9]{{3}})[-. ]?([0-9]{{4}})$', '(\1) \2-\3') AS phone FROM ({_entities(('phone',))})",
    "keyword_stats": "SELECT lang, " + ", ".join(f"round({f}({_DENSITY(k)}), 9) AS {f}_{k}" for k in KEYWORDS for f in ("avg", "max")) + " FROM documents GROUP BY lang",
    "relevance_scores": "SELECT doc_id, (" + " + ".join(rf"len(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '(?i)\b{k}\b'))" for k in KEYWORDS) + ")::BIGINT AS score FROM documents",
    "page_scores": "SELECT doc_id, emails, phones, round(3.0 * emails + 2.0 * phones + 2.0 * prices + dates + 0.5 * links + 100.0 * density, 6) AS score FROM (SELECT doc_id, "
    + ", ".join("len(regexp_extract_all(text, '" + T.PATTERNS[r].replace("'", "''") + f"'))::BIGINT AS {n}" for r, n in (("email", "emails"), ("phone", "phones"), ("price", "prices"), ("date", "dates"), ("url", "links")))
    + ", " + " + ".join(_DENSITY(k) for k in KEYWORDS) + " AS density FROM documents)",
    "exact_dedup": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY coalesce(text, ''))",
    "duplicate_digests": "SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
    "word_frequency": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) WHERE word NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ") GROUP BY word ORDER BY n DESC, word LIMIT 50",
    "corpus_report": f"SELECT lang, count(*) AS pages, sum({_WORDS})::BIGINT AS words, round(avg({_WORDS}), 6) AS avg_words FROM documents GROUP BY ROLLUP (lang)",
    "top_pages": f"SELECT doc_id, {_WORDS}::BIGINT AS words FROM documents ORDER BY words DESC, doc_id LIMIT 10",
    "unique_entities": f"SELECT rule, count(DISTINCT match) AS n_distinct, count(*) AS n FROM ({_entities(_RULES)}) GROUP BY rule",
    "frontier_deep": f"{_DEEP(4)} SELECT url, depth FROM d",
    "frontier_full": rf"""WITH RECURSIVE {_EDGES},
t(url, depth) AS (SELECT 'https://h1.example.com/p/1', 0::BIGINT UNION SELECT dst, depth + 1 FROM t JOIN edges ON src = url WHERE depth < 5 AND starts_with(dst, 'https://h1.') AND NOT regexp_matches(url, '/p/[0-9]*7$')),
d AS (SELECT url, min(depth) AS depth FROM t GROUP BY url),
s AS (SELECT d.url, d.depth, bool_or(e.source = 'internal') AS internal FROM d LEFT JOIN (edges e JOIN d f ON e.src = f.url AND NOT regexp_matches(f.url, '/p/[0-9]*7$')) ON e.dst = d.url AND f.depth = d.depth - 1 GROUP BY d.url, d.depth)
SELECT url, depth, CASE WHEN depth = 0 THEN 3 WHEN internal AND depth <= 1 THEN 2 ELSE 1 END::BIGINT AS priority FROM s""",
    "frontier_budget": f"{_DEEP(3)}, n AS (SELECT depth, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d GROUP BY depth) SELECT depth, least(n, 40 - before)::BIGINT AS n FROM n WHERE before < 40",
    "frontier_stats": f"""{_DEEP(2)}, p AS (SELECT DISTINCT src AS url, NOT ends_with(src, '3') AS good FROM edges)
SELECT count(*) AS discovered, count(*) FILTER (good) AS crawled, count(*) FILTER (NOT coalesce(good, false)) AS errors, (SELECT count(*) FROM d JOIN edges ON src = url WHERE depth = 2) AS skipped FROM d LEFT JOIN p USING (url)""",
    "frontier_scope": rf"""WITH RECURSIVE {_EDGES},
t(url, depth) AS (SELECT 'https://h1.example.com/p/1', 0::BIGINT UNION SELECT dst, depth + 1 FROM t JOIN edges ON src = url WHERE depth < 5 AND starts_with(dst, 'https://h1.') AND NOT regexp_matches(url, '/p/[0-9]*7$')),
d AS (SELECT url, min(depth) AS depth FROM t GROUP BY url)
SELECT count(*) AS skipped FROM d JOIN edges ON src = url WHERE NOT regexp_matches(url, '/p/[0-9]*7$') AND (depth = 5 OR NOT starts_with(dst, 'https://h1.'))""",
    "crawl_pages": f"SELECT min(url) AS url, 0::BIGINT AS depth, 3::BIGINT AS priority FROM pages GROUP BY {_norm()}",
    "robots_allowed": rf"""SELECT page_id, url, CASE length({_host()}) % 3
  WHEN 0 THEN NOT (regexp_matches({_path()}, '^/en/.*1') OR regexp_matches({_path()}, '\.html$')) OR (starts_with({_path()}, '/en/11') AND NOT regexp_matches({_path()}, '^/.*\.html$'))
  WHEN 1 THEN NOT starts_with({_path()}, '/de/') OR starts_with({_path()}, '/de/1') ELSE true END AS allowed FROM pages""",
    "crawl_schedule": f"SELECT page_id, ((row_number() OVER (PARTITION BY {_host()} ORDER BY page_id) - 1) * 250)::BIGINT AS start_ms FROM pages",
    "adaptive_delay": f"""SELECT user_id AS host, count(*) AS n, list_reduce(list_prepend(1000::BIGINT, list({_STATUS}::BIGINT ORDER BY event_id)), lambda d, s: CASE WHEN s IN (429, 503) THEN least(greatest(d * 2, 1000), 30000)
  WHEN s IN (500, 502, 504) THEN least(greatest(d + d // 2, 1000), 30000) WHEN s BETWEEN 200 AND 299 THEN greatest(d - d // 10, 1000) ELSE d END) AS delay_ms FROM events GROUP BY user_id""",
    "backoff": "SELECT event_id, least(60000, CASE WHEN event_id % 5 = 0 THEN user_id * 1000 ELSE 1000 * 2 ** (event_id % 8) END)::BIGINT AS ms FROM events",
    "fetch_filter": f"SELECT {_STATUS} AS status, count(*) AS n FROM events WHERE {_STATUS} < 400 GROUP BY 1",
    "event_rates": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "upsert_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "file_names": f"SELECT page_id, lpad((row_number() OVER (ORDER BY page_id) - 1)::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY page_id) - 1)::VARCHAR))::INT, '0') || '_' || substr({_slug()}, 1, 80) AS name FROM pages",
    "sink_contents": f"SELECT path, arg_max(content, url) AS content FROM (SELECT 'out/' || {_slug()} || '.md' AS path, url, '# T' || page_id || chr(10) || chr(10) || 'URL: ' || url || chr(10) || 'Crawled at: now' || chr(10) || chr(10) || 'x' || chr(10) AS content FROM pages) GROUP BY path",
    "single_file": "SELECT md5(string_agg('# T' || chr(10) || chr(10) || 'URL: ' || url || chr(10) || 'Crawled at: now' || chr(10) || chr(10) || 'x' || chr(10), chr(10) || '---' || chr(10) || chr(10) ORDER BY url)) AS digest FROM pages",
}
ORACLES |= _DERIVED_ORACLES
