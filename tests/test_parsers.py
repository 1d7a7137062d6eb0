"""Parsers, Markdown, links, robots: literal cases and what happens at the edges."""

import pytest
from pyspark.sql import functions as F

from skein.functions import urls as U
from skein.operators import crawl, frontier, html, jsondoc, links, markdown, parse, robots, xmldoc
from skein.sources import pages, sinks

PAGE = """<!DOCTYPE html><html lang="en"><head><title> A  page </title><meta name="description" content=""><meta property="og:description" content="About">
<meta name="keywords" content="x, ,y"><link rel="canonical" href="/c"><link rel="alternate" type="application/rss+xml" href="/feed"><meta http-equiv="refresh" content="5; URL='/next'"></head><body>
bare <nav><a href="/n">n</a></nav><div class="ad-box"><p>ad</p></div><div class="ad">lost<p>kept</p></div><h2>Head <i>line</i></h2><p>One<p>Two <b>bold
<p>three</p></b><ul><li>a<ul><li>b</li></ul></li></ul><pre><code class="language-go">x
 y</code></pre><table><tr><th>h</th><th>k</th><tr><td>1<td>22<td>3</table><figure><img src="f.png" alt="z"><figcaption>cap</figcaption></figure>
<dl><dt>t<dd>d</dl><hr><img src=""><a href="">t</a><blockquote>q</blockquote><ol><li>i</li><li>j</li></ol><video><source src="v.mp4"></video><footer>f</footer><script>var p = "</p>";</script></body></html>"""


def test_nodes():
    got = [(n["kind"], n.get("text") or n.get("items") or n.get("rows") or n.get("pairs") or n.get("href")) for n in html.content_nodes(html.parse_tree(PAGE))]
    assert got == [
        ("paragraph", "kept"), ("heading", "Head line"), ("paragraph", "One"), ("paragraph", "Two bold"), ("paragraph", "three"), ("list", ["a b", "b"]), ("code_block", "x y"), ("table", [["1", "22", "3"]]),
        ("image", "cap"), ("definitions", [{"term": "t", "definition": "d"}]), ("rule", None), ("link", "t"), ("quote", "q"), ("ordered_list", ["i", "j"]), ("media", "Video"),
    ]


def test_unclosed_bold_reopens_in_a_container():
    root = html.parse_tree("<body><p><b>x<p>y</p><footer>bare</footer></body>")
    got = [(n["kind"], n["text"]) for n in html.content_nodes(root, html.Cleaning(footers=False))]
    assert got == [("paragraph", "x"), ("paragraph", "y"), ("bold", "bare")]


def test_metadata():
    m = html.metadata(html.parse_tree(PAGE))
    assert (m["title"], m["language"], m["description"], m["keywords"], m["canonical_url"], m["author"]) == ("A page", "en", "About", ["x", "y"], "/c", None)


def test_raw_links():
    got = [(x["kind"], x["value"]) for x in html.raw_links(html.parse_tree(PAGE))]
    assert got == [("page", "/n"), ("page", ""), ("page", "/c"), ("feed", "/feed"), ("resource", "f.png"), ("resource", ""), ("resource", "v.mp4"), ("page", "/next")]


def test_broken_html_never_fails():
    for text in ("", "<", "<p", "</p></b>", "<b><i></b></i>", "<table><td>x</table></table>", "a" * 100_000, "<div>" * 5000, "<a href=x><a href=y>z"):
        html.content_nodes(html.parse_tree(text))
        html.metadata(html.parse_tree(text))


def test_xml_and_feeds():
    rss = "<rss><channel><title>C</title><image><title>I</title></image><item><title><![CDATA[A & B]]></title><link>l</link><pubDate>d</pubDate><dc:creator>w</dc:creator></item><item/></channel></rss>"
    f = xmldoc.rss(rss)
    assert (f["title"], f["items"]) == ("I", [{"title": "A & B", "link": "l", "description": None, "pub_date": "d", "author": "w"}])
    atom = '<feed><title>T</title><subtitle>s</subtitle><link href="x" rel="self"/><link href="y"/><entry><author><name>n</name></author><content>c</content><summary>z</summary><link href="e"/></entry></feed>'
    f = xmldoc.atom(atom)
    assert (f["title"], f["description"], f["link"]) == ("T", "s", "y")
    assert f["items"] == [{"title": None, "link": "e", "description": "c", "pub_date": None, "author": "n"}]
    assert [n["text"] for n in xmldoc.xml_nodes("<a><b>x &amp; y</b>tail<c/></a>")] == ["b", "x & y", "tail"]
    entries, further = xmldoc.sitemap("<urlset><url><loc>a</loc><image:loc>b</image:loc><priority>bad</priority></url><url><lastmod>z</lastmod></url></urlset>")
    assert entries == [{"loc": "b", "lastmod": None, "changefreq": None, "priority": None}] and not further
    assert xmldoc.sitemap("<sitemapindex><sitemap><ns:loc>s</ns:loc></sitemap></sitemapindex>") == ([], ["s"])
    assert xmldoc.xml_links("<urlset><url><loc>a</loc></url><broken></x>") == [{"kind": "sitemap", "value": "a"}]


def test_json():
    meta, nodes = jsondoc.document('{"@type": "Article", "headline": "H", "author": {"name": "N"}, "tags": [1, "a"], "n": null, "o": {"k": true}}')
    assert (meta["title"], meta["author"]) == ("H", "N")
    assert [(n["kind"], n.get("text") or n.get("items")) for n in nodes] == [("heading", "H"), ("heading", "o"), ("paragraph", "k: true"), ("paragraph", "tags:"), ("list", ["1", "a"])]
    _, nodes = jsondoc.document('{"b": [{"y": 1.0, "x": null}, {"x": "q", "y": 2}], "a": null}')
    assert nodes[0]["text"] == "a: null" and nodes[2] == {"kind": "table", "headers": ["x", "y"], "rows": [["null", "1.0"], ["q", "2"]]}


def test_parse_errors_are_rows(spark):
    rows = spark.createDataFrame([(1, "json", "{"), (2, "rss", "<a></b>"), (3, "html", "<p>x"), (4, "text", "raw"), (5, "html", None)], "i int, k string, b string")
    got = {r.i: r.p for r in rows.select("i", parse.parse_page("b", "k").alias("p")).collect()}
    assert got[1].metadata is None and got[1].error and got[2].error and got[5] is None
    assert got[3].nodes[0].text == "x" and got[4].nodes[0].kind == "raw"


def test_markdown(spark):
    df = spark.createDataFrame([("https://s.com/", PAGE)], "url string, html string").select("url", parse.parse_page("html").alias("p"))
    text = df.select(markdown.render("url", F.col("p.metadata"), F.col("p.nodes")).alias("m")).first().m
    assert text.startswith("---\nurl: https://s.com/\ntitle: A page\ndescription: About\nlanguage: en\ncanonical: /c\n---\n\nkept\n\n## Head line\n\nOne\n\n")
    assert "```go\nx y\n```\n\n| h   | k   |\n|-----|-----|\n| 1   | 22  |\n\n![cap](f.png)\n\n**t:** d\n\n---\n\n[t]()> q\n\n1. i\n2. j\n\n[Media: Video](v.mp4)\n" in text
    assert text.endswith("\n") and not text.endswith("\n\n")


def test_links_and_crawl(spark):
    p = spark.createDataFrame(
        [(1, "https://www.s.com/", '<a href="/a"><a href="https://x.s.com/">s</a><a href="https://o.org/">o</a><a href="#"><img src="i.png">'), (2, "https://s.com/a/", '<a href="/b">b</a><p>hi'), (3, "https://s.com/b", "<title>B</title>")],
        "page_id int, url string, html string",
    )
    assert [(r.category, r.url) for r in links.extract(p.filter("page_id = 1")).orderBy("pos").collect()] == [("internal", "https://www.s.com/a"), ("external", "https://x.s.com/"), ("external", "https://o.org/"), ("resources", "https://www.s.com/i.png")]
    got = {r.url: (r.depth, r.title) for r in crawl.crawl(p, ["https://s.com/"], frontier.CrawlOptions(max_depth=2)).collect()}
    assert got == {"https://www.s.com/": (0, "Untitled"), "https://s.com/a/": (1, "Untitled"), "https://s.com/b": (2, "B")}
    got = crawl.crawl(p, ["https://s.com/"], frontier.CrawlOptions(max_depth=2, exclude=("/a$",))).select("url").collect()
    assert [r.url for r in got] == ["https://www.s.com/"]


def test_crawl_from_a_table_of_seeds(spark):
    p = spark.createDataFrame([(f"https://s{i}.com/", f"<html><body><a href='https://s{i}.com/next'>n</a>{i}</body></html>") for i in range(40)] + [("https://s7.com/next", "<p>x</p>")], "url string, html string")
    seeds = p.filter("url not like '%next'").select("url")
    got = {r.url: (r.depth, r.priority) for r in crawl.crawl(p, seeds, frontier.CrawlOptions(mode="deep", max_depth=1, max_pages=1000)).collect()}
    assert got == {f"https://s{i}.com/": (0, 3) for i in range(40)} | {"https://s7.com/next": (1, 2)}
    assert crawl.crawl(p, seeds, frontier.CrawlOptions(max_pages=5)).count() == 40
    for bad in (seeds.limit(0), seeds.unionByName(spark.createDataFrame([(None,)], "url string"))):
        with pytest.raises(ValueError):
            crawl.crawl(p, bad)


def test_rejected_links(spark):
    u = lambda h, k: f"https://{h}.com/{k}"
    links = [("a", 0, "a", 1), ("a", 0, "a", 2), ("a", 0, "b", 1), ("a", 1, "a", 0), ("a", 1, "a", 3), ("a", 2, "a", 3), ("a", 2, "b", 1), ("a", 3, "a", 0), ("a", 3, "a", 4), ("b", 1, "a", 0)]
    edges = spark.createDataFrame([(u(a, i), u(b, j), "internal" if a == b else "external") for a, i, b, j in [*links, links[0]]], "src string, dst string, source string")
    seeds = spark.createDataFrame([(u("a", 0),)], "url string")

    def got(**o):
        options = frontier.CrawlOptions(**o)
        tasks = frontier.traverse(edges, seeds, options)
        row = frontier.stats(tasks, tasks.select("url", F.lit(200).alias("status")), frontier.rejected(edges, seeds, tasks, options)).first()
        return row.discovered, row.crawled, row.errors, row.skipped

    assert got(mode="deep") == (6, 6, 0, 0)
    assert got(mode="deep", max_depth=1) == (4, 4, 0, 5)  # the links of a/1, a/2 and b/1
    assert got(mode="full") == (5, 5, 0, 2)  # those to b/1
    assert got(mode="full", max_depth=2) == (4, 4, 0, 4)  # and those of a/3
    assert got(mode="deep", max_pages=3) == (3, 3, 0, 5)  # to b/1, then all links of a/1 and a/2
    assert got(mode="full", exclude=("/2$",)) == (5, 5, 0, 1)
    assert got(mode="lite") == (1, 1, 0, 0)


def test_bad_options():
    import pytest

    for bad in ({"include": ("[x",)}, {"mode": "wide"}):
        with pytest.raises(ValueError):
            frontier.CrawlOptions(**bad)


def test_robots(spark):
    text = "User-agent: *\nDisallow: /dir/*/private\nDisallow: /*.pdf$ # files\nAllow: /a\nDisallow: /b\n\nUser-agent: Skein\nDisallow:\nSitemap: https://s.com/x\nCrawl-delay: 2.5"
    assert robots.parse_text(text)["sitemaps"] == ["https://s.com/x"] and robots.parse_text(text)["crawl_delay"] == 2.5
    files = spark.createDataFrame([("s.com", text)], "host string, content string")
    paths = {"/dir/x/private": False, "/x.pdf": False, "/x.pdf?y": False, "/x.pdfs": True, "/a": True, "/b/c": False, "/": True}
    p = spark.createDataFrame([(f"https://s.com{x}",) for x in paths] + [("https://other.com/b",)], "url string")
    got = {r.url: r.allowed for r in robots.allowed(p, robots.rules(files), "bot").collect()}
    assert got == {f"https://s.com{k}": v for k, v in paths.items()} | {"https://other.com/b": True}
    assert all(r.allowed for r in robots.allowed(p, robots.rules(files), "skein").collect())
    merged = "User-agent: a\nDisallow:\nUser-agent: b\nDisallow: /x"
    assert {(g["agent"], g["pattern"]) for g in robots.parse_text(merged)["groups"]} == {("a", "/x"), ("b", "/x")}
    assert {(g["agent"], g["pattern"]) for g in robots.parse_text(merged, True)["groups"]} == {("a", None), ("b", "/x")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "site/sub").mkdir(parents=True)
    (tmp_path / "site/index.html").write_text("<p>x")
    (tmp_path / "site/sub/a.html").write_text("<p>y")
    assert {r.url: r.html for r in pages.html_folder(spark, f"{tmp_path}/site", "https://s.com").collect()} == {"https://s.com/": "<p>x", "https://s.com/sub/a.html": "<p>y"}
    r = spark.createDataFrame([("https://s.com/a", "A", "m", "now"), ("https://s.com/b", "B", "n", "now")], "url string, title string, markdown string, crawled_at string")
    sinks.write_files(r, f"{tmp_path}/out", mirror=True)
    assert (tmp_path / "out/s.com/a/index.md").read_text() == "# A\n\nURL: https://s.com/a\nCrawled at: now\n\nm\n"
    sinks.write_single_file(r, f"{tmp_path}/one.md", with_header=False)
    assert (tmp_path / "one.md").read_text() == "m\n---\n\nn"
    assert r.filter(U.host("url") == "s.com").count() == 2
