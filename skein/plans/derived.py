"""Queries over bodies that are made from the tables by expressions, for what the tables' own pages lack, with their SQL beside them.

A template holds {i} where the row's page_id goes. Expected rows are written as templates too, so that SQL computes them from page_id alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content_type as C
from ..functions import text as T
from ..functions import urls as U
from ..operators import corpus, crawl, frontier, html, links, markdown, parse, robots
from ..sources import sinks

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        ORACLES[f.__name__] = sql
        return f

    return add


def fill(template: str, by: str = "page_id") -> Column:
    out: list[Column] = []
    for k, part in enumerate(template.split("{i}")):
        out += [F.col(by).cast("string")] * (k > 0) + [F.lit(part)]
    return F.concat(*out)


def sql_fill(template: str | None, by: str = "page_id") -> str:
    return "NULL" if template is None else "('" + template.replace("'", "''").replace("{i}", f"' || {by} || '") + "')"


def sql_rows(columns: str, rows: list[tuple], numbered: bool = False) -> str:
    """Rows of templates (numbers as they are) for each page, with their place if asked."""
    one = lambda v: str(v) if isinstance(v, (int, float)) else sql_fill(v)
    names = columns.split()
    parts = []
    for k, r in enumerate(rows):
        pos = [f"{k}::BIGINT AS pos"] if numbered else []
        parts.append("SELECT page_id, " + ", ".join(pos + [f"{one(v)} AS {n}" for n, v in zip(names, r)]) + " FROM pages")
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- nodes and Markdown

RICH = (
    '<html lang="en"><head><title>Page {i}</title></head><body><ul><li>a{i}</li><li> </li><li>b <b>c</b></li></ul><ol><li>one</li><li>two {i}</li></ol>'
    "<table><tr><th>key</th><th>v</th></tr><tr><td>k{i}</td><td>x</td></tr><tr><td>z</td><td>long cell</td></tr></table><dl><dt>term</dt><dd>means {i}</dd><dt>t2</dt><dd>d2</dd></dl>"
    '<pre><code class="language-rust">let x = {i};</code></pre><pre>plain {i}</pre><blockquote>said {i}</blockquote><figure><img src="/i{i}.png" alt="alt"><figcaption>cap</figcaption></figure>'
    '<video src="/v{i}.mp4" title="clip"></video><audio><source src="/a.mp3"></audio><iframe src="/e{i}"></iframe><hr>'
    '<div><a href="/x{i}">go</a><strong>B</strong><em>I</em><code>c</code><del>s</del><br><img src="/j.png" alt="j"></div><h4>Small</h4><p>Last one.</p></body></html>'
)
NODES = [  # kind, level, text, href, lang, more
    ("list", None, None, None, None, "a{i}|b c"),
    ("ordered_list", None, None, None, None, "one|two {i}"),
    ("table", None, None, None, None, "key,v;k{i},x;z,long cell"),
    ("definitions", None, None, None, None, "term=means {i}|t2=d2"),
    ("code_block", None, "let x = {i};", None, "rust", ""),
    ("code_block", None, "plain {i}", None, None, ""),
    ("quote", None, "said {i}", None, None, ""),
    ("image", None, "cap", "/i{i}.png", None, ""),
    ("media", None, "clip", "/v{i}.mp4", "video", ""),
    ("media", None, "Audio", "/a.mp3", "audio", ""),
    ("media", None, "Embedded", "/e{i}", "iframe", ""),
    ("rule", None, None, None, None, ""),
    ("link", None, "go", "/x{i}", None, ""),
    ("bold", None, "B", None, None, ""),
    ("italic", None, "I", None, None, ""),
    ("code", None, "c", None, None, ""),
    ("strike", None, "s", None, None, ""),
    ("break", None, None, None, None, ""),
    ("image", None, "j", "/j.png", None, ""),
    ("heading", 4, "Small", None, None, ""),
    ("paragraph", None, "Last one.", None, None, ""),
]


def _more() -> Column:
    """What a node's arrays hold, as one string."""
    rows = F.transform("rows", lambda r: F.array_join(r, ","))
    table = F.array_join(F.concat(F.array(F.array_join("headers", ",")), rows), ";")
    pairs = F.array_join(F.transform("pairs", lambda p: F.concat(p["term"], F.lit("="), p["definition"])), "|")
    return F.when(F.col("kind") == "table", table).when(F.col("kind") == "definitions", pairs).otherwise(F.coalesce(F.array_join("items", "|"), F.lit("")))


@query(sql_rows("kind level text href lang more", [(k, "NULL::BIGINT" if v is None else v, *rest) for k, v, *rest in NODES], True).replace("('NULL::BIGINT')", "NULL::BIGINT"))
def rich_nodes(t):
    x = parse.content_nodes(t("pages").select("page_id", fill(RICH).alias("html")))
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), "kind", F.col("level").cast("long").alias("level"), "text", "href", "lang", _more().alias("more"))


_WIDE = "greatest(length('k' || page_id), 3)::INT"
_RENDERED = (
    sql_fill("---\nurl: ") + " || url || " + sql_fill("\ntitle: Page {i}\nlanguage: en\n---\n\n- a{i}\n- b c\n\n1. one\n2. two {i}\n\n| ") + f" || rpad('key', {_WIDE}, ' ') || ' | v         |' || chr(10) || '|-' || repeat('-', {_WIDE}) || '-|-----------|' || chr(10) || '| ' || rpad('k' || page_id, {_WIDE}, ' ') || ' | x         |' || chr(10) || '| ' || rpad('z', {_WIDE}, ' ') || ' | long cell |' || "
    + sql_fill("\n\n**term:** means {i}\n\n**t2:** d2\n\n```rust\nlet x = {i};\n```\n\n```\nplain {i}\n```\n\n> said {i}\n\n![cap](/i{i}.png)\n\n[Media: clip](/v{i}.mp4)\n\n[Media: Audio](/a.mp3)\n\n[Media: Embedded](/e{i})\n\n---\n\n[go](/x{i})**B***I*`c`~~s~~\n![j](/j.png)\n\n#### Small\n\nLast one.\n\n---\n\n*made here*\n")
)


@query(f"SELECT page_id, {_RENDERED} AS markdown FROM pages")
def rich_markdown(t):
    x = t("pages").select("page_id", "url", parse.parse_page(fill(RICH)).alias("p"))
    return x.select("page_id", markdown.render("url", F.col("p.metadata"), F.col("p.nodes"), footer="made here").alias("markdown"))


META = (
    '<html lang="de"><head><title> A  {i} </title><meta name="description" content="about {i}"><meta property="og:description" content="second"><meta name="author" content="ann"><meta name="keywords" content="k{i}, two,, three ">'
    '<meta property="og:image" content="/og{i}.png"><meta property="article:published_time" content="2024-01-0{i}"><meta property="og:title" content="other"><link rel="canonical" href="https://c.example.com/{i}"></head><body></body></html>'
)


@query(f"SELECT page_id, {sql_fill('A {i}')} AS title, {sql_fill('about {i}')} AS description, 'ann' AS author, {sql_fill('2024-01-0{i}')} AS published_date, 'de' AS language, {sql_fill('https://c.example.com/{i}')} AS canonical_url, {sql_fill('/og{i}.png')} AS og_image, {sql_fill('k{i}|two|three')} AS keywords FROM pages")
def rich_metadata(t):
    x = t("pages").select("page_id", parse.parse_metadata(fill(META)).alias("m")).select("page_id", "m.*")
    return x.withColumn("keywords", F.array_join("keywords", "|"))


NOISE = (
    "<body><nav><p>menu</p></nav><header><p>head</p></header><script>var p;</script><style>p{}</style><noscript><p>none</p></noscript><div class=\"ad-box\"><p>buy</p></div>"
    "<div id=\"disqus_thread\"><p>first!</p></div><p>kept {i}</p><footer><p>foot</p></footer></body>"
)


@query(f"SELECT page_id, {sql_fill('kept {i}')} AS clean, {sql_fill('menu|head|buy|first!|kept {i}|foot')} AS whole FROM pages")
def cleaned_nodes(t):
    texts = lambda clean: F.array_join(F.transform(parse.parse_nodes(fill(NOISE), None, clean), lambda n: n["text"]), "|")
    return t("pages").select("page_id", texts(html.Cleaning()).alias("clean"), texts(html.Cleaning(False, False, False, False)).alias("whole"))


# ---------------------------------------------------------------- links

SITE = "https://h{i}.example.com/d/p"
LINKED = (
    '<html><head><link rel="stylesheet" href="/s.css"><link rel="alternate" type="application/rss+xml" href="/feed{i}"><link rel="sitemap" href="/map.xml"><link rel="alternate" href="/alt"><link rel="preload" href="f.woff2"><script src="/a.js"></script>'
    '<meta property="og:image" content="/og{i}.png"><meta http-equiv="refresh" content="5; url=/next{i}"><meta property="og:url" content="/own"></head><body>'
    '<a href="https://other{i}.example.net/x">o</a><a href="//sub.h{i}.example.com/y">s</a><a href="mailto:a@b.c">m</a><a href="#">t</a><a href="">e</a><a href="javascript:void(0)">j</a><a href="../up?q={i}">u</a>'
    '<map><area href="/area"></map><form action="/f"></form><img src="/i.png" srcset="/i1.png 1x, /i2.png 2x"><iframe src="/e"></iframe><video src="/v.mp4" poster="/v.jpg"></video><audio src="/a.mp3"><source src="/b.mp3"></audio></body></html>'
)
FOUND = [  # place, kind, category, reference, address
    (0, "page", "external", "https://other{i}.example.net/x", "https://other{i}.example.net/x"),
    (1, "page", "subdomains", "//sub.h{i}.example.com/y", "https://sub.h{i}.example.com/y"),
    (6, "page", "internal", "../up?q={i}", "https://h{i}.example.com/up?q={i}"),
    (7, "page", "internal", "/area", "https://h{i}.example.com/area"),
    (8, "page", "internal", "/f", "https://h{i}.example.com/f"),
    (9, "resource", "resources", "/s.css", "https://h{i}.example.com/s.css"),
    (10, "feed", "feeds", "/feed{i}", "https://h{i}.example.com/feed{i}"),
    (11, "sitemap", "sitemaps", "/map.xml", "https://h{i}.example.com/map.xml"),
    (12, "page", "internal", "/alt", "https://h{i}.example.com/alt"),
    (13, "resource", "resources", "f.woff2", "https://h{i}.example.com/d/f.woff2"),
    (14, "resource", "resources", "/a.js", "https://h{i}.example.com/a.js"),
    (15, "resource", "resources", "/i.png", "https://h{i}.example.com/i.png"),
    (16, "resource", "resources", "/i1.png", "https://h{i}.example.com/i1.png"),
    (17, "resource", "resources", "/i2.png", "https://h{i}.example.com/i2.png"),
    (18, "page", "internal", "/e", "https://h{i}.example.com/e"),
    (19, "resource", "resources", "/v.mp4", "https://h{i}.example.com/v.mp4"),
    (20, "resource", "resources", "/v.jpg", "https://h{i}.example.com/v.jpg"),
    (21, "resource", "resources", "/a.mp3", "https://h{i}.example.com/a.mp3"),
    (22, "resource", "resources", "/b.mp3", "https://h{i}.example.com/b.mp3"),
    (23, "resource", "resources", "/og{i}.png", "https://h{i}.example.com/og{i}.png"),
    (24, "page", "internal", "/next{i}", "https://h{i}.example.com/next{i}"),
    (25, "page", "internal", "/own", "https://h{i}.example.com/own"),
]


@query(sql_rows("pos link_type category href url", FOUND).replace(" AS pos", "::BIGINT AS pos"))
def rich_links(t):
    x = links.extract(t("pages").select("page_id", fill(SITE).alias("url"), fill(LINKED).alias("html")))
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), "link_type", "category", "href", "url")


@query("SELECT category, count(*) AS n FROM (" + sql_rows("category", [(r[2],) for r in FOUND]) + ") GROUP BY category")
def links_of_all_categories(t):
    return links.extract(t("pages").select("page_id", fill(SITE).alias("url"), fill(LINKED).alias("html"))).groupBy("category").agg(F.count("*").alias("n"))


REFERENCES = {"../a": "/x/a", "./b?c=1": "/x/y/b?c=1", "c/../d": "/x/y/d", "../../../e/./f": "/e/f", "#part": "/x/y/{i}?k=v#part"}


@query(" UNION ALL ".join(f"SELECT page_id, '{r}' AS ref, {sql_fill('https://h.example.com' + to)} AS resolved FROM pages" for r, to in REFERENCES.items()))
def resolve_dots(t):
    x = t("pages").select("page_id", F.explode(F.array(*[F.lit(r) for r in REFERENCES])).alias("ref"))
    return x.select("page_id", "ref", U.resolve(fill("https://h.example.com/x/y/{i}?k=v"), "ref").alias("resolved"))


@query(f"SELECT page_id, {sql_fill('https://example.com/a b{i}%zz/c%2?k%=1+ %&x=y z')} AS norm FROM pages")
def normalize_escapes(t):
    return t("pages").select("page_id", U.normalize(fill("https://www.example.com/a%20b{i}%zz/c%2/?x=y+z&k%25=1%2b%20%")).alias("norm"))


KINDS_XML = '<?xml version="1.0"?><doc><name>n{i}</name><empty/><note>t &amp; u</note></doc>'
ATOM = (
    '<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed {i}</title><subtitle>sub</subtitle><link href="https://f.example.com/{i}"/><link rel="self" href="/self"/>'
    '<entry><title>E{i}</title><link href="https://f.example.com/e{i}"/><author><name>ann</name></author><updated>2024-02-01</updated><published>2024-01-01</published><summary>short</summary><content>long</content></entry>'
    "<entry><title>Bare</title></entry></feed>"
)
LD = '{"@context":"https://schema.org","@type":"Article","headline":"H{i}","description":"about","author":{"name":"ann"},"datePublished":"2024-03-03","image":{"url":"/i{i}.png"},"url":"https://l.example.com/{i}","tags":["x","y{i}"],"size":{i},"extra":{"deep":true}}'
TABLE = '{"rows":[{"a":{i},"b":"x"},{"b":null,"a":2}],"mixed":[1,"two",{"c":3}],"inner":{"k":"v{i}"},"none":null}'
BROKEN = '{"a": {i'
BODIES = [  # header, body, kind, title, kinds of nodes, texts of nodes, whether it is an error
    ("text/html", RICH.replace("<ul>", "<p>only {i}</p></body></html><!--").replace("</html>", "", 0) + "-->", "html", "Page {i}", "paragraph", "only {i}", False),
    ("application/xml", KINDS_XML, "xml", None, "heading|paragraph|heading|paragraph", "name|n{i}|note|t & u", False),
    ("application/atom+xml", ATOM, "atom", "Feed {i}", "heading|paragraph|rule|heading|link|paragraph|paragraph|paragraph|rule|heading|rule", "Feed {i}|sub|E{i}|E{i}|short|Published: 2024-02-01|Author: ann|Bare", False),
    ("application/ld+json", LD, "jsonld", "H{i}", "heading|paragraph|image|heading|paragraph|paragraph|paragraph|list", "H{i}|about||extra|deep: true|size: {i}|tags:", False),
    ("application/json", TABLE, "json", None, "heading|paragraph|heading|list|paragraph|heading|table", "inner|k: v{i}|mixed|none: null|rows", False),
    ("text/plain", "just text {i}", "text", None, "raw", "just text {i}", False),
    ("application/json", BROKEN, "json", None, "", "", True),
]


@query("SELECT page_id, header, kind, title, kinds, texts, failed FROM (" + sql_rows("header kind title kinds texts failed", [(h, k, t, n, x, int(e)) for h, _, k, t, n, x, e in BODIES]).replace("1 AS failed", "true AS failed").replace("0 AS failed", "false AS failed") + ")")
def bodies_of_all_kinds(t):
    each = F.array(*[F.struct(F.lit(h).alias("header"), fill(b).alias("html")) for h, b, *_ in BODIES])
    x = t("pages").select("page_id", "url", F.explode(each).alias("b")).select("page_id", "url", "b.*")
    x = x.select("page_id", "header", C.detect_by_header("header", F.lit("https://e.example.com/x")).alias("kind"), "html").withColumn("p", parse.parse_page("html", "kind"))
    join = lambda f: F.array_join(F.transform(F.coalesce("p.nodes", F.array()), lambda n: n[f]), "|")
    return x.select("page_id", "header", "kind", "p.metadata.title", join("kind").alias("kinds"), join("text").alias("texts"), F.col("p.error").isNotNull().alias("failed"))


@query(sql_rows("title link author pub_date description", [("E{i}", "https://f.example.com/e{i}", "ann", "2024-02-01", "short"), ("Bare", None, None, None, None)]))
def atom_entries(t):
    x = t("pages").select("page_id", F.explode(parse.parse_atom(fill(ATOM))["items"]).alias("e"))
    return x.select("page_id", "e.title", "e.link", "e.author", "e.pub_date", "e.description")


@query(sql_rows("section", [("### [E{i}](https://f.example.com/e{i})\n\nshort\n\n*By ann | 2024-02-01*\n\n",), ("### Bare\n\n",)]))
def feed_sections(t):
    x = t("pages").select("page_id", F.explode(parse.parse_atom(fill(ATOM))["items"]).alias("e"))
    return x.select("page_id", markdown.feed_item(F.col("e")).alias("section"))


@query("SELECT page_id, 'H' || page_id AS title, 'about' AS description, 'ann' AS author, '2024-03-03' AS published_date, 'https://l.example.com/' || page_id AS canonical_url, '/i' || page_id || '.png' AS og_image, 'x|y' || page_id AS tags FROM pages")
def linked_data(t):
    x = t("pages").select("page_id", parse.parse_page(fill(LD), F.lit("jsonld")).alias("p"))
    m = ["title", "description", "author", "published_date", "canonical_url", "og_image"]
    tags = F.array_join(F.get(F.filter("p.nodes", lambda n: n["kind"] == "list"), F.lit(0))["items"], "|")
    return x.select("page_id", *[f"p.metadata.{c}" for c in m], tags.alias("tags"))


@query("SELECT page_id, 'a,b' AS headers, page_id || ',x;2,null' AS rows, '1|two|{\"c\":3}' AS items FROM pages")
def json_tables(t):
    x = t("pages").select("page_id", parse.parse_nodes(fill(TABLE), F.lit("json")).alias("n"))
    first = lambda k: F.get(F.filter("n", lambda n: n["kind"] == k), F.lit(0))
    rows = F.array_join(F.transform(first("table")["rows"], lambda r: F.array_join(r, ",")), ";")
    return x.select("page_id", F.array_join(first("table")["headers"], ",").alias("headers"), rows.alias("rows"), F.array_join(first("list")["items"], "|").alias("items"))


SITEMAP = "<?xml version='1.0'?><urlset><url><loc>https://m.example.com/{i}</loc></url><url><loc>/rel?a=1&amp;b={i}</loc></url></urlset>"


@query(sql_rows("kind category url", [("feed", "feeds", "https://f.example.com/{i}"), ("feed", "feeds", "https://h.example.com/self"), ("feed", "feeds", "https://f.example.com/e{i}"), ("sitemap", "sitemaps", "https://m.example.com/{i}"), ("sitemap", "sitemaps", "https://h.example.com/rel?a=1&b={i}")]))
def xml_links(t):
    each = F.array(*[F.struct(F.lit(k).alias("kind"), fill(b).alias("html")) for k, b in (("atom", ATOM), ("sitemap", SITEMAP))])
    x = t("pages").select("page_id", F.lit("https://h.example.com/d").alias("url"), F.explode(each).alias("b")).select("page_id", "url", "b.*")
    return links.extract(x, "kind").select("page_id", F.col("link_type").alias("kind"), "category", "url")


INDEX = '<sitemapindex xmlns:x="s"><x:sitemap><x:loc>https://m.example.com/{i}.xml</x:loc><x:lastmod>2024-01-01</x:lastmod></x:sitemap><x:sitemap><x:loc>https://m.example.com/b.xml</x:loc></x:sitemap></sitemapindex>'


@query(f"SELECT page_id, true AS is_index, 0::BIGINT AS entries, {sql_fill('https://m.example.com/{i}.xml|https://m.example.com/b.xml')} AS further FROM pages")
def sitemap_index(t):
    x = t("pages").select("page_id", fill(INDEX).alias("xml")).select("page_id", "xml", parse.parse_sitemap("xml").alias("s"))
    return x.select("page_id", parse.is_sitemap_index("xml").alias("is_index"), F.size("s.entries").cast("long").alias("entries"), F.array_join("s.sub_sitemaps", "|").alias("further"))


ROBOTS = "# c\nUser-agent: A{i}\nUser-agent: b\nDisallow: /x # why\nAllow: /x/y\n\nUser-agent: *\nDisallow:\nCrawl-delay: 1.5\nSitemap: https://r.example.com/{i}.xml\nsitemap: /two.xml\n"


@query("SELECT page_id, 1.5::DOUBLE AS crawl_delay, 'https://r.example.com/' || page_id || '.xml|/two.xml' AS sitemaps, 'a' || page_id || ' disallow /x|a' || page_id || ' allow /x/y|b disallow /x|b allow /x/y|* none ' AS groups FROM pages")
def robots_parts(t):
    x = t("pages").select("page_id", robots.parse(fill(ROBOTS)).alias("r"))
    groups = F.transform("r.groups", lambda g: F.concat_ws(" ", g["agent"], g["kind"], F.coalesce(g["pattern"], F.lit(""))))
    return x.select("page_id", "r.crawl_delay", F.array_join("r.sitemaps", "|").alias("sitemaps"), F.array_join(groups, "|").alias("groups"))


# ---------------------------------------------------------------- the frontier's parts

FAILURES = [  # status, message, kind, whether another attempt may help
    (429, "slow down", "rate_limited", True), (None, "operation timed out", "timeout", True), (None, "dns failure", "dns", True), (None, "bad certificate", "tls", False), (None, "too many redirects", "redirect", False), (None, "connection refused", "connect", True),
    (None, "proxy unreachable", "proxy", True), (None, "browser died", "browser", False), (None, "rendering failed", "render", False), (None, "parse failure", "parse", False), (None, "permission denied", "io", False), (None, "bad option", "config", False),
    (None, "page limit", "max_pages", False), (None, "relative URL without a base", "url", False), (503, "down", "server", True), (404, "gone", "client", False), (None, "else", "other", False),
]


@query("SELECT event_id, m.kind AS kind, m.retry AS retry FROM events JOIN (VALUES " + ", ".join(f"({k}, '{r[2]}', {str(r[3]).lower()})" for k, r in enumerate(FAILURES)) + f") m(k, kind, retry) ON m.k = event_id % {len(FAILURES)}")
def error_kinds(t):
    each = F.array(*[F.struct(F.lit(s).cast("int").alias("status"), F.lit(m).alias("message")) for s, m, *_ in FAILURES])
    x = t("events").select("event_id", F.get(each, (F.col("event_id") % len(FAILURES)).cast("int")).alias("f"))
    return x.select("event_id", frontier.error_kind(F.col("f.status"), F.col("f.message")).alias("e")).select("event_id", "e.kind", "e.retry")


@query("SELECT * FROM (VALUES ('lite', 2, 100, 5), ('full', 5, 1000, 10), ('deep', 50, 50000, 25)) v(mode, max_depth, max_pages, concurrency)")
def mode_presets(t):
    return frontier.presets(t("region").sparkSession)


@query("SELECT * FROM (VALUES ('desktop', 1920, 1080, 1), ('tablet', 768, 1024, 2), ('mobile', 390, 844, 3)) v(device, width, height, scale)")
def device_viewports(t):
    return frontier.viewports(t("region").sparkSession)


@query("SELECT page_id, 0::BIGINT AS none, 250::BIGINT AS fixed, true AS within, true AS same, 4000::BIGINT AS adaptive FROM pages")
def delay_strategies(t):
    r = frontier.delay_ms("random", min_ms=100, max_ms=300, seed=3, key=F.col("url"))
    return t("pages").select("page_id", frontier.delay_ms("none").alias("none"), frontier.delay_ms("fixed", 250).alias("fixed"), r.between(100, 300).alias("within"), (r == frontier.delay_ms("random", min_ms=100, max_ms=300, seed=3, key=F.col("url"))).alias("same"), frontier.delay_ms("adaptive", adaptive=frontier.next_delay(F.lit(2000), F.lit(429), 1000)).alias("adaptive"))


@query("SELECT 'full' AS mode, 'https://a.example.com/' || page_id AS url FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0 UNION ALL SELECT 'deep', CASE WHEN page_id % 2 = 0 THEN 'https://a.example.com/' ELSE 'https://b.example.com/' END || page_id FROM pages WHERE page_id % 3 <> 0")
def should_crawl(t):
    page = F.concat(F.when(F.col("page_id") % 2 == 0, "https://www.a.example.com/").otherwise("https://b.example.com/"), F.col("page_id").cast("string"))
    known = t("pages").filter("page_id % 3 = 0").select(U.normalize(page).alias("url"))
    found = t("pages").select(F.concat(page, F.lit("#x")).alias("url"))
    one = lambda mode, n: frontier.should_crawl(found, known, "a.example.com", mode, n, 1_000_000).select(F.lit(mode).alias("mode"), "url")
    return one("full", 5).unionByName(one("deep", 5)).unionByName(one("deep", 1_000_000)).unionByName(one("lite", 5))


@query("SELECT 200 + 100 * (page_id % 5) AS status, count(*) AS n FROM pages WHERE page_id % 5 < 2 GROUP BY 1")
def fetched_pages(t):
    x = t("pages").withColumn("status", (200 + 100 * (F.col("page_id") % 5)).cast("int"))
    return crawl.fetched(x).groupBy(F.col("status").cast("long").alias("status")).agg(F.count("*").alias("n"))


LEFT_OUT = ["/files/a{i}.pdf", "/pic{i}.webp", "/wp-admin/{i}", "/p{i}?utm_source=x", "/pixel/{i}", "/share?u={i}", "/print/", "/2024/05/0{i}/", "/fr/{i}", "/wp-json/{i}", "/xmlrpc.php?{i}", "/a?b={i}&session_id=1", "/a?jsessionid={i}", "/l?sort={i}", "/l?x=1&order={i}"]
TAKEN = ["/article/{i}", "/files/a{i}.pdf.html", "/frame/{i}", "/2024/05/{i}x"]


@query(" UNION ALL ".join(f"SELECT page_id, {sql_fill('https://h.example.com' + p)} AS url FROM pages" + (" WHERE length(page_id::VARCHAR) > 1" if "/05/0" in p else "") for p in [*TAKEN, "/2024/05/0{i}/"]))
def url_filter_recipes(t):
    x = t("pages").select("page_id", F.explode(F.array(*[fill("https://h.example.com" + p) for p in LEFT_OUT + TAKEN])).alias("url"))
    return x.filter(frontier.matches(F.col("url"), (), T.URL_FILTERS))


# ---------------------------------------------------------------- a crawl that follows links

_PAGE = "concat('https://h', {k} % 3, '.example.com/x/', {k})"
_TREE_ROBOTS = "User-agent: *\nDisallow: /x/1\nAllow: /x/1$\n"
TREE = """WITH RECURSIVE n AS (SELECT page_id AS k FROM pages WHERE page_id > 0),
may AS (SELECT k FROM n WHERE NOT (k % 3 = 2 AND starts_with(k::VARCHAR, '1')) AND NOT k % 10 = 7),
t(k, depth) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT c.k, depth + 1 FROM t JOIN may p ON p.k = t.k JOIN n c ON c.k IN (2 * t.k, 2 * t.k + 1) WHERE depth < 6)
SELECT 'https://h' || (k % 3) || '.example.com/x/' || k AS url, depth, CASE WHEN depth = 0 THEN 3 WHEN k % 3 = (k // 2) % 3 THEN CASE WHEN depth <= 1 THEN 2 ELSE 1 END WHEN k % 3 = 1 THEN 1 ELSE 0 END::BIGINT AS priority
FROM t JOIN may USING (k)"""


@query(TREE)
def crawl_tree(t):
    """Page k links to 2k and 2k + 1; one host's robots file forbids some, a pattern leaves out others."""
    of = lambda k: F.expr(_PAGE.replace("{k}", f"({k})"))
    body = F.concat(F.lit('<html><body><p>x</p><a href="'), of("2 * page_id"), F.lit('">l</a><a href="'), of("2 * page_id + 1"), F.lit('">r</a></body></html>'))
    pages = t("pages").filter("page_id > 0").select(of("page_id").alias("url"), body.alias("html"))
    files = t("region").filter("r_regionkey = 0").select(F.lit("h2.example.com").alias("host"), F.lit(_TREE_ROBOTS).alias("content"))
    seeds = t("region").filter("r_regionkey = 0").select(F.lit("https://h1.example.com/x/1").alias("url"))
    x = crawl.crawl(pages, seeds, frontier.CrawlOptions(mode="deep", max_depth=6, exclude=(r"/x/[0-9]*7$",)), files)
    return x.select("url", F.col("depth").cast("long").alias("depth"), F.col("priority").cast("long").alias("priority"))


# ---------------------------------------------------------------- sinks and statistics


def _results(t) -> DataFrame:
    return t("pages").select("page_id", "url", F.concat(F.lit("T"), F.col("page_id").cast("string")).alias("title"), F.lit("x").alias("markdown"), F.lit("now").alias("crawled_at"))


@query("SELECT md5(string_agg('x', chr(10) || '---' || chr(10) || chr(10))) AS digest FROM pages")
def joined_markdown(t):
    return sinks.single_text(_results(t), with_header=False).select(F.md5("content").alias("digest"))


_NAME = "lpad((row_number() OVER (ORDER BY page_id) - 1)::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY page_id) - 1)::VARCHAR))::INT, '0') || '_' || substr({slug}, 1, 80)"
_SLUG = "regexp_replace(regexp_replace(lower(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) || coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_FILES = f"SELECT url, 'T' || page_id AS title, {_NAME.replace('{slug}', _SLUG)} || '.md' AS file FROM pages"


@query(_FILES)
def export_manifest(t):
    return sinks.manifest(_results(t))


@query(f"SELECT md5('# Crawl Index' || chr(10) || chr(10) || string_agg('- [' || title || '](' || file || ')  ' || chr(10) || '  ' || url, chr(10) ORDER BY file) || chr(10)) AS digest FROM ({_FILES})")
def export_index(t):
    return sinks.index_text(sinks.manifest(_results(t))).select(F.md5("content").alias("digest"))


@query("""SELECT md5('[' || string_agg('{"url":"' || url || '","title":"T' || page_id || '"}', ',' ORDER BY url, page_id) || ']') AS digest FROM pages""")
def json_array(t):
    return sinks.json_array(_results(t), "url", "page_id", fields=("url", "title")).select(F.md5("content").alias("digest"))


@query("SELECT CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' END AS content_type, count(*) AS pages FROM pages GROUP BY 1")
def content_type_histogram(t):
    x = t("pages").select(F.when(F.col("page_id") % 3 == 0, "text/html").when(F.col("page_id") % 3 == 1, "application/json").alias("content_type"))
    return corpus.histogram(x, "content_type").withColumnRenamed("n", "pages")


_DESCRIBE = lambda c, n: f"SELECT '{n}' AS measure, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS least, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, max(x) AS most FROM (SELECT ({c})::DOUBLE AS x FROM documents)"


@query(_DESCRIBE("n_chars", "chars") + " UNION ALL " + _DESCRIBE("len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'))", "words"))
def described_documents(t):
    x = corpus.described(t("documents"), chars=F.col("n_chars"), words=T.word_count("text"))
    return x.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""WITH d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id // 2 END AS doc_id, text, lang FROM documents UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id // 2 END, text, lang FROM documents)
SELECT doc_id, lang, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id NULLS LAST, lang NULLS FIRST) AS r FROM d) WHERE r = 1""")
def exact_dedup_clashing_ids(t):
    d = t("documents").select(F.when(F.col("doc_id") % 3 != 0, F.expr("doc_id div 2")).alias("doc_id"), "text", "lang")
    return corpus.exact_dedup(d.unionByName(d)).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("SELECT url, depth, priority FROM (" + "SELECT 'https://h' || (page_id % 3) || '.example.com/' || page_id AS url, (page_id % 4)::BIGINT AS depth, (page_id % 3)::BIGINT AS priority FROM pages" + ") ORDER BY priority DESC, depth, url LIMIT 25")
def crawl_order(t):
    x = t("pages").select(F.expr("concat('https://h', page_id % 3, '.example.com/', page_id)").alias("url"), (F.col("page_id") % 4).alias("depth"), (F.col("page_id") % 3).alias("priority"))
    return frontier.order(x).limit(25)  # the next 25 tasks
