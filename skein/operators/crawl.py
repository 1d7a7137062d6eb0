"""The whole crawl over a table of fetched pages, and its building blocks in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content_type, urls
from . import frontier, html, links, markdown, parse, robots
from .frontier import CrawlOptions
from .tables import fresh


def _cleaning(o: CrawlOptions) -> html.Cleaning:
    return html.Cleaning(o.clean_navigation, o.clean_footers, o.clean_ads, o.clean_comments)


def fetched(pages: DataFrame) -> DataFrame:
    """pages(url, html) as fetch results: status 200, text/html and the url itself unless columns say otherwise; failures (status 400 and more) are left out."""
    have = set(pages.columns)
    x = pages.select(
        "url", "html", (F.col("status") if "status" in have else F.lit(200)).cast("int").alias("status"), (F.col("content_type") if "content_type" in have else F.lit("text/html")).alias("content_type"),
        (F.coalesce("final_url", "url") if "final_url" in have else F.col("url")).alias("final_url"), (F.col("fetched_at") if "fetched_at" in have else F.lit(None)).cast("timestamp").alias("crawled_at"),
    )
    return x.filter("status < 400")


def results(pages: DataFrame, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """Each fetched page as (url, title, markdown, metadata, links, crawled_at, status_code, content_type, render_method); pages that can't be parsed are left out."""
    x = fetched(pages).withColumn("kind", content_type.detect_by_header("content_type", "final_url"))
    x = x.withColumn("page", parse.parse_page("html", "kind", _cleaning(options))).filter("page.metadata is not null")
    raw = F.filter(F.transform("page.links", lambda l: F.struct(l["kind"].alias("kind"), urls.trimmed(l["value"]).alias("href"))), lambda l: ~urls.should_skip(l["href"]))
    resolved = F.filter(F.transform(raw, lambda l: F.struct(l["kind"].alias("kind"), urls.resolve(F.col("final_url"), l["href"]).alias("url"))), lambda l: l["url"].isNotNull())
    sorted_links = F.transform(resolved, lambda l: F.struct(links.category(l["kind"], l["url"], F.col("final_url")).alias("category"), l["url"].alias("url")))
    return x.select(
        "url", F.coalesce("page.metadata.title", F.lit("Untitled")).alias("title"), markdown.render("url", F.col("page.metadata"), F.col("page.nodes")).alias("markdown"), F.col("page.metadata").alias("metadata"),
        sorted_links.alias("links"), "crawled_at", F.col("status").alias("status_code"), "content_type", F.lit("static").alias("render_method"),
    )


def crawl(pages: DataFrame, seeds: list[str] | DataFrame, options: CrawlOptions = CrawlOptions(), robots_files: DataFrame | None = None) -> DataFrame:
    """The results of a crawl from seeds over pages(url, html, ...), with depth and priority; in no order, see frontier.order.

    What isn't in pages is a failed fetch and gives no row. Of pages of one normal form the one of the least address counts.
    robots_files(host, content) restrict what is fetched: of a page that they forbid no link is followed.
    seeds are addresses or a table of them, seeds(url), which may be as large as pages; the budget never cuts seeds.
    """
    if not isinstance(seeds, DataFrame):
        if not seeds or any(not s.strip() or "://" not in s for s in seeds):
            raise ValueError(f"bad seeds {seeds!r}")
        seeds = pages.sparkSession.createDataFrame([(s,) for s in seeds], "url string")
    elif bad := seeds.filter(~F.coalesce(F.contains("url", F.lit("://")), F.lit(False))).take(1) or seeds.isEmpty():
        raise ValueError(f"bad seeds {bad!r}")
    may = pages
    if robots_files is not None and options.respect_robots:
        may = robots.allowed(pages.drop("allowed"), robots.rules(robots_files), options.agent).filter("allowed").drop("allowed")
    norm, depth, priority = fresh(pages, "norm", "depth", "priority")
    # of the pages of one normal form the one of the least address is fetched
    may = may.withColumn(norm, urls.normalize("url", options.remove_www))
    least = may.groupBy(norm).agg(F.min("url").alias("url"))
    may = may.join(least.select("url").distinct(), "url", "left_semi").dropDuplicates(["url"])
    got = fetched(may)
    edges = links.extract(got.select(F.lit(0).alias("page_id"), F.col("final_url").alias("url"), "html"))
    edges = edges.filter("link_type = 'page'").select(F.col("base").alias("src"), F.col("url").alias("dst"), F.when(F.col("category") == "internal", "internal").otherwise("external").alias("source"))
    tasks = frontier.traverse(edges, seeds.select("url"), options)
    tasks = tasks.filter(frontier.matches(F.col("url"), options.include, options.exclude))
    tasks = tasks.select(F.col("url").alias(norm), F.col("depth").alias(depth), F.col("priority").alias(priority))
    out = results(may.join(tasks.select(norm), norm, "left_semi"), options).withColumn(norm, urls.normalize("url", options.remove_www))
    return out.join(tasks, norm).withColumnsRenamed({depth: "depth", priority: "priority"}).drop(norm)
