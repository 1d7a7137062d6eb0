"""Addresses that are their own normal form take a short way, which gives what the long way gives."""

from skein.functions import urls


def test_short_way(spark):
    hosts = ["a.com", "www.a.com", "A.com", "a.com:80", "u@a.com", "wwwx.a.com", "..", "é.com", "www.www.a.com"]
    paths = ["", "/", "/p/1", "/p/1/", "//p", "/p//", "/./p", "/a/../b", "/p.html", "/%41", "/a_b-C", "/p?x=1", "/p#t", "/p\n", "/p\\q", "/é", "/-"]
    rows = [(f"{s}://{h}{p}",) for s in ("http", "https", "HTTP", "ftp") for h in hosts for p in paths]
    x = spark.createDataFrame([*rows, (None,), ("",), ("https:///p",), (" https://a.com/p",)], "url string").cache()
    short = [tuple(r) for r in x.select(urls.normalize("url"), urls.normalize("url", False)).collect()]
    kept, urls._NORMAL = urls._NORMAL, r"\zx"
    try:
        assert short == [tuple(r) for r in x.select(urls.normalize("url"), urls.normalize("url", False)).collect()]
    finally:
        urls._NORMAL = kept


def test_rejected_counts_distinct_links(spark):
    from skein.operators import frontier

    edges = spark.createDataFrame([("https://a.com/x", "https://b.com/y", "external")] * 3, "src string, dst string, source string")
    seeds, o = spark.createDataFrame([("https://a.com/x",)], "url string"), frontier.CrawlOptions(max_depth=2)
    tasks = frontier.traverse(edges, seeds, o)
    assert tasks.count() == 1 and frontier.rejected(edges, seeds, tasks, o).first().skipped == 1
    plan = frontier.rejected(edges, seeds, tasks, o)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [src") < plan.index("Join Inner")  # links are made distinct after the join with followed pages
