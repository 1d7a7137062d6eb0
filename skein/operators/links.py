"""Links of pages: resolved, classified and related to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .parse import parse_links

CATEGORIES = ("internal", "external", "subdomains", "resources", "feeds", "sitemaps")


def category(kind: Column, url: Column, base: Column) -> Column:
    """Which of CATEGORIES a link of a kind (page, resource, feed, sitemap) belongs to."""
    hosts = F.struct(urls.host(url).alias("a"), urls.host(base).alias("b"))
    page = urls.let(hosts, lambda h: F.when((h["a"] != "") & (h["a"] == h["b"]), "internal").when((h["b"] != "") & F.endswith(h["a"], F.concat(F.lit("."), h["b"])), "subdomains").otherwise("external"))
    return F.when(kind == "resource", "resources").when(kind == "feed", "feeds").when(kind == "sitemap", "sitemaps").otherwise(page)


def extract(pages: DataFrame, kind: str | None = None) -> DataFrame:
    """(page_id, base, pos, link_type, category, href, url): one row a link, repeats included.

    pages(page_id, url, html). References that lead nowhere or can't be resolved are
    left out. pos is the place among the page's references. kind names a column
    with the content type of the body, html if not given.
    """
    raw = pages.select("page_id", F.col("url").alias("base"), F.posexplode(parse_links("html", kind)).alias("pos", "l"))
    x = raw.select("page_id", "base", "pos", F.col("l.kind").alias("link_type"), urls.trimmed("l.value").alias("href"))
    x = x.filter(~urls.should_skip("href")).withColumn("url", urls.resolve("base", "href")).filter("url is not null")
    return x.withColumn("category", category(F.col("link_type"), F.col("url"), F.col("base"))).select("page_id", "base", "pos", "link_type", "category", "href", "url")


def distinct(links: DataFrame) -> DataFrame:
    """The first of equal links in a page and category."""
    return links.groupBy("page_id", "category", "url").agg(F.min("pos").alias("pos"))


def by_page(links: DataFrame) -> DataFrame:
    """(page_id, internal, external, subdomains, resources, feeds, sitemaps): arrays of the links in order."""
    def one(c: str) -> Column:
        mine = F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("pos", "url"))))
        return F.transform(mine, lambda x: x["url"]).alias(c)

    return links.groupBy("page_id").agg(*[one(c) for c in CATEGORIES])


def graph(links: DataFrame) -> DataFrame:
    """(src, dst, n): edges between normal forms of pages and their page links, without loops."""
    x = links.filter("link_type = 'page'").select(urls.normalize("base").alias("src"), urls.normalize("url").alias("dst"))
    return x.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and the links they stand for."""
    nodes = edges.select(F.col("src").alias("u")).unionByName(edges.select(F.col("dst").alias("u"))).agg(F.countDistinct("u").alias("nodes"))
    return nodes.crossJoin(edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")))


def host_matrix(links: DataFrame) -> DataFrame:
    """(src_host, dst_host, n) over all links."""
    return links.groupBy(urls.host("base").alias("src_host"), urls.host("url").alias("dst_host")).agg(F.count("*").alias("n"))
