"""Literal cases of the Column functions."""

import pytest
from pyspark.sql import functions as F

from skein.functions import content_type as C
from skein.functions import text as T
from skein.functions import urls as U


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(col.alias("x")).first()["x"]


def test_normalize(spark):
    cases = [
        ("HTTP://WWW.Site.COM:80/p/?b=2&a=1#f", "http://site.com/p?a=1&b=2"),
        ("https://site.com/%41%42%43", "https://site.com/ABC"),
        ("https://site.com/page?key", "https://site.com/page?key="),
        ("https://site.com", "https://site.com/"),
        ("https://site.com/a/../b/./c/", "https://site.com/b/c"),
        ("https://site.com:8443/a%2Fb?x=1+2&x=%zz", "https://site.com:8443/a/b?x=%zz&x=1 2"),
        ("https://user:pw@site.com/x?", "https://site.com/x"),
        ("no url at all", "no url at all"),
        (None, None),
    ]
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string").select("i", U.normalize("u").alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: n for i, (_, n) in enumerate(cases)}


def test_normalize_is_idempotent(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/pages.parquet").select(U.normalize("url").alias("n"))
    assert x.filter(U.normalize("n") != F.col("n")).isEmpty()


def test_resolve(spark):
    base = "https://site.com/a/b?q=1#f"
    cases = {
        "../x": "https://site.com/x", "/x": "https://site.com/x", "x": "https://site.com/a/x", "//h.org/x": "https://h.org/x", "HTTP://H.org": "http://h.org/", "": None, "  ": None, "?z": "https://site.com/a/b?z",
        "#top": "https://site.com/a/b?q=1#top", "mailto:a@b.c": "mailto:a@b.c", "./": "https://site.com/a/", "a b": "https://site.com/a/a%20b",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", U.resolve(F.lit(base), "r").alias("x")).collect()
    assert {r.r: r.x for r in rows} == cases


def test_names_and_relations(spark):
    assert one(spark, U.slug("u"), u="https://Site.com/Blog/Post") == "site-com-blog-post"
    assert one(spark, U.filename("u"), u="https://site.com/blog/post?x") == "site.com_blog_post"
    assert one(spark, U.extension("u"), u="https://site.com/a.b/c.RSS") == "rss"
    assert one(spark, U.extension("u"), u="https://site.com/a.b/c") is None
    assert one(spark, U.root_domain("u"), u="https://a.b.site.com/") == "site.com"
    assert one(spark, U.is_subdomain("a", "b"), a="https://notsite.com", b="https://site.com") is False
    assert one(spark, U.is_subdomain("a", "b"), a="https://x.site.com", b="https://site.com") is True
    assert one(spark, U.file_path("u", "d", True), u="https://docs.site.com/api//v2") == "d/docs.site.com/api/v2/index.md"
    assert one(spark, U.file_path("u", "d", True), u="https://site.com") == "d/site.com/index.md"


def test_sanitize(spark):
    cases = {" site.com/a\n b ": "https://site.com/ab", "//site.com": "https://site.com/", "http://Site.com": "http://site.com/", "   ": None, "https://a[b": None}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", U.sanitize("r").alias("x")).collect()
    assert {r.r: r.x for r in rows} == cases


def test_skip(spark):
    cases = {"#": True, "": True, " JavaScript:void(0)": True, "mailto:x": True, "#part": False, "/x": False}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", U.should_skip("r").alias("x")).collect()
    assert {r.r: r.x for r in rows} == cases


@pytest.mark.parametrize(
    "header,url,body,kind,mime",
    [
        ("application/xml", "https://s.com/", "<?xml version='1.0'?>\n<urlset>", "sitemap", None), ("application/pdf; x", "https://s.com/", "", "other", "application/pdf"), (None, "https://s.com/f.RSS", "", "rss", None),
        (None, "https://s.com/", " [1]", "json", None), (None, "https://s.com/", "hello", "html", None), (None, "https://s.com/a.xml", "<feed>", "atom", None), ("TEXT/HTML", "https://s.com/a.json", "", "html", None),
    ],
)
def test_content_type(spark, header, url, body, kind, mime):
    assert tuple(one(spark, C.detect("h", "u", "b"), h=header, u=url, b=body)) == (kind, mime)


def test_blank_lines_and_lines(spark):
    assert one(spark, T.collapse_blank_lines("t", 2), t="Hello\n\n\n\n\nWorld\n") == "Hello\n\n\nWorld\n"
    assert one(spark, T.collapse_blank_lines("t", 1), t="\n\n\na\n \t\n\nb") == "\na\n\nb\n"
    assert one(spark, T.trim_lines("t"), t="a  \n b\t\n") == "a\n b"
    assert one(spark, T.strip_tags("t"), t="a<b\nc>d<e") == "ad"
    assert one(spark, T.yaml_escape("t"), t='a: "b" \\') == '"a: \\"b\\" \\\\"'
    assert one(spark, T.yaml_escape("t"), t="plain text") == "plain text"
    assert one(spark, T.escape_markdown("t"), t="a*b_[c]") == "a\\*b\\_\\[c\\]"


def test_small_parsers(spark):
    for text, ms in (("500", 500), ("250ms", 250), ("30s", 30_000), ("1m30s", 90_000), ("2h", 7_200_000), ("x", None), ("", None)):
        assert one(spark, T.duration_ms("t"), t=text) == ms
    for text, to in (("5;URL='https://x/y'", "https://x/y"), ("0; url = x", None), ("5", None), ("5;url=", None), ('1;url="/a"', "/a")):
        assert one(spark, T.refresh_url("t"), t=text) == to
    assert one(spark, T.srcset_urls("t"), t="s.jpg 300w, l.jpg 1024w,") == ["s.jpg", "l.jpg"]
    for text, lang in (("language-python", "python"), ("hljs language-go", "go"), ("c++", "c++"), ("two words", None), ("", None)):
        assert one(spark, T.code_language("t"), t=text) == lang
    assert one(spark, T.formatted_phone("t"), t="555-123-4567") == "(555) 123-4567"
    assert one(spark, T.keyword_density("t", "ab"), t="ab abab x") == pytest.approx(1.0)


def test_functions_in_sql(spark):
    from skein.functions import sql

    assert {"own_url_normalize", "own_word_count"} <= set(sql.register(spark, "own_"))
    x = spark.sql("SELECT own_url_normalize(u) AS n, own_url_is_subdomain(u, 'https://example.com/') AS below, own_word_count('a b  c') AS words FROM (SELECT concat('HTTPS://www.example.com:443/a%2', 'x/?b=', id) AS u FROM range(3))")
    assert [(r.n, r.below, r.words) for r in x.orderBy("n").collect()] == [(f"https://example.com/a%2x?b={i}", True, 3) for i in range(3)]
    assert "Python" not in x._jdf.queryExecution().executedPlan().toString()


def test_reports_and_upsert(spark, tmp_path):
    from skein.sources import sinks

    pages = spark.createDataFrame([("https://a/1", "One", 1), ("https://a/2", "", 2)], "url string, title string, page_id long")
    files = sinks.manifest(pages)
    assert sinks.index_text(files).first().content == "# Crawl Index\n\n- [One](000_a-1.md)  \n  https://a/1\n- [(untitled)](001_a-2.md)  \n  https://a/2\n"
    words = spark.createDataFrame([("x", 3), ("a", 1), ("b", 1)], "word string, n long")
    edges = spark.createDataFrame([("s", f"d{i}") for i in range(3)] + [("r", "d")], "src string, dst string")
    assert sinks.report_text(pages, words, edges, 2, 2).first().content == "# Site Report\n\nPages crawled: 2\n\n## Top Words\n\n| Word | Count |\n|------|-------|\n| x | 3 |\n| a | 1 |\n\n## Link Graph\n\n**r**: d\n**s**: d0, d1 (+1 more)\n"
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = lambda *r: spark.createDataFrame(list(r), "url string, title string, crawled_at long, links array<string>")
    rows(("u1", "old", 1, [])).drop("links").write.jdbc(url, "pages")
    sinks.upsert_jdbc(rows(("u1", "new", 2, []), ("u2", "b", 1, ["x"])), url, "pages")
    sinks.upsert_jdbc(rows(("u1", "late", 1, [])), url, "pages")
    assert sorted(map(tuple, spark.read.jdbc(url, "pages").collect())) == [("u1", "new", 2), ("u2", "b", 1)]


def test_numbers_and_descriptions(spark):
    from skein.operators import corpus

    df = spark.createDataFrame([(i % 97, i) for i in range(1000)], "k long, name long").repartition(7)
    got = corpus.numbered(df.drop("name"), "k", "n").collect()
    assert sorted(r.n for r in got) == list(range(1000)) and [r.k for r in sorted(got, key=lambda r: r.n)] == sorted(r.k for r in got)
    one = corpus.described(df, k=F.col("k"), none=F.lit(None)).collect()
    assert [(r.measure, r.n, r.least, r.most) for r in one] == [("k", 1000, 0.0, 96.0)]
    assert corpus.exact_dedup(spark.createDataFrame([(None, "only me"), (3, "x"), (1, "x"), (1, "x"), (1, "y"), (None, None)], "doc_id long, text string")).count() == 4
