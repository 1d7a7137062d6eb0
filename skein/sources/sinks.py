"""Sinks for crawl results(url, title, markdown, crawled_at, ...)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import corpus
from ..operators.tables import written


def page_content(url: Column, title: Column, crawled_at: Column, markdown: Column) -> Column:
    """A page with its heading, address and time."""
    return F.concat(F.lit("# "), title, F.lit("\n\nURL: "), url, F.lit("\nCrawled at: "), F.coalesce(crawled_at.cast("string"), F.lit("")), F.lit("\n\n"), markdown, F.lit("\n"))


def files(results: DataFrame, folder: str, mirror: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of the Markdown files; of pages that share a path the greatest address counts, and of rows that share that the first by the columns of by, else the least content."""
    content = page_content(F.col("url"), F.col("title"), F.col("crawled_at"), F.col("markdown"))
    x = results.select(urls.file_path("url", folder, mirror).alias("path"), "url", F.struct(*by, content.alias("content__")).alias("first"))
    x = x.groupBy("path", "url").agg(F.min("first")["content__"].alias("content"))
    return x.groupBy("path").agg(F.max_by("content", "url").alias("content"))


def write_files(results: DataFrame, folder: str, mirror: bool = False) -> None:
    """Writes the files from the executors; folder must be one that they share. A file gets its name when it is whole."""

    def write(rows):
        for r in rows:
            os.makedirs(os.path.dirname(r.path), exist_ok=True)
            tmp = f"{r.path}.{os.getpid()}.tmp"
            with open(tmp, "w", encoding="utf-8") as f:
                f.write(r.content)
            os.replace(tmp, r.path)

    files(results, folder, mirror).foreachPartition(write)


SEPARATOR = "\n---\n\n"


def single_text(results: DataFrame, by: str = "url", with_header: bool = True) -> DataFrame:
    """One row: all pages in order, with a rule between them. A report for what one machine can hold; write_single_file streams."""
    body = page_content(F.col("url"), F.col("title"), F.col("crawled_at"), F.col("markdown")) if with_header else F.col("markdown")
    parts = F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), body.alias("t"))))
    return results.agg(F.array_join(F.transform(parts, lambda p: p["t"]), SEPARATOR).alias("content"))


def write_single_file(results: DataFrame, path: str, by: str = "url", with_header: bool = True) -> None:
    """Appends all pages to one file of the driver, a partition at a time."""
    body = page_content(F.col("url"), F.col("title"), F.col("crawled_at"), F.col("markdown")) if with_header else F.col("markdown")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        for r in results.orderBy(by).select(body.alias("t")).toLocalIterator():
            f.write((SEPARATOR if f.tell() else "") + r.t)


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def manifest(results: DataFrame, by: str = "page_id") -> DataFrame:
    """(url, title, file) of each page: under which name a numbered export writes it."""
    return corpus.file_names(results, "url", by).select("url", "title", F.concat("name", F.lit(".md")).alias("file"))


def index_text(files_: DataFrame) -> DataFrame:
    """One row: the index page of an export's manifest(url, title, file). A report for what one machine can hold."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)"))
    lines = F.array_sort(F.collect_list(F.struct("file", F.concat(F.lit("- ["), title, F.lit("]("), F.col("file"), F.lit(")  \n  "), F.col("url")).alias("t"))))
    return files_.agg(F.concat(F.lit("# Crawl Index\n\n"), F.array_join(F.transform(lines, lambda x: x["t"]), "\n"), F.lit("\n")).alias("content"))


def report_text(pages: DataFrame, words: DataFrame, edges: DataFrame, top: int = 15, most: int = 10) -> DataFrame:
    """One row: a site report of the number of pages, the top words of words(word, n) and the targets of edges(src, dst), the first ones by source. For what one machine can hold."""
    n = pages.agg(F.concat(F.lit("# Site Report\n\nPages crawled: "), F.count("*").cast("string"), F.lit("\n\n## Top Words\n\n| Word | Count |\n|------|-------|\n")).alias("a"))
    w = words.orderBy(F.desc("n"), "word").limit(top).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "word"))), lambda x: F.concat(F.lit("| "), x["word"], F.lit(" | "), (-x["o"]).cast("string"), F.lit(" |\n"))), "").alias("b"))
    targets = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("d"))
    line = F.concat(F.lit("**"), F.col("src"), F.lit("**: "), F.array_join(F.slice("d", 1, most), ", "), F.when(F.size("d") > most, F.concat(F.lit(" (+"), (F.size("d") - most).cast("string"), F.lit(" more)"))).otherwise(""))
    g = targets.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", line.alias("t")))), lambda x: x["t"]), "\n").alias("c"))
    return n.crossJoin(w).crossJoin(g).select(F.concat("a", "b", F.lit("\n## Link Graph\n\n"), "c", F.lit("\n")).alias("content"))


def json_array(results: DataFrame, *by: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row: all rows as an array of JSON objects of fields (all columns if not given), in the order of by. A report for what one machine can hold; write_json writes lines."""
    rows = F.array_sort(F.collect_list(F.struct(*by, F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields or results.columns])).alias("t__"))))
    return results.agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["t__"]), ","), F.lit("]")).alias("content"))


def write_csv(results: DataFrame, path: str) -> None:
    """The scalar columns as CSV with a header."""
    flat = [c for c, t in results.dtypes if not t.startswith(("struct", "array", "map"))]
    results.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def upsert_jdbc(results: DataFrame, url: str, table: str, key: str = "url", at: str = "crawled_at", properties: dict[str, str] | None = None) -> None:
    """Puts the scalar columns of results into a table of a database (SQLite, say), where the latest row of a key counts; the driver's classpath needs its JDBC driver."""
    flat = results.select(*[c for c, t in results.dtypes if not t.startswith(("struct", "array", "map"))])
    old = results.sparkSession.read.jdbc(url, table, properties=properties or {})
    merged = written(upsert(old.select(*flat.columns), flat, key, at), "upsert")  # read in full before the table is replaced
    merged.write.option("truncate", True).mode("overwrite").jdbc(url, table, properties=properties or {})


def upsert(old: DataFrame, new: DataFrame, key: str = "url", at: str = "crawled_at") -> DataFrame:
    """old with the rows of new in the place of those of equal key: the latest counts."""
    return corpus.latest(old.unionByName(new), key, at)
