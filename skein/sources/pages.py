"""Sources of fetched pages. All give (url, html), lazily and with pruned columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jsonl(spark: SparkSession, path: str, url: str = "url", html: str = "html") -> DataFrame:
    """Lines of JSON objects; the schema is given, so nothing is read to infer it."""
    return spark.read.schema(f"`{url}` string, `{html}` string").json(path).select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))


def html_folder(spark: SparkSession, path: str, origin: str = "https://localhost") -> DataFrame:
    """Files below a folder as pages: the address is origin and the file's place in the folder, without index.html."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,htm,xml,json,txt}").load(path)
    root = F.lit(path.rstrip("/").split("://")[-1].lstrip("/"))
    at = F.expr("instr(path, '{}')".format(path.rstrip("/").split("://")[-1].replace("'", "''")))
    name = F.substring(F.col("path"), at + F.length(root) + 1, F.length("path"))
    return files.select(F.concat(F.lit(origin), F.regexp_replace(name, r"(^|/)index\.html?$", "/")).alias("url"), F.decode("content", "UTF-8").alias("html"))


def retry_plan(attempts: int, initial_ms: int = 1000, max_ms: int = 60_000):
    """Column: the waits before further attempts."""
    from ..operators.frontier import backoff_ms

    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda a: backoff_ms(a, F.lit(None).cast("string"), initial_ms, max_ms))
