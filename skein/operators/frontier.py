"""Traversal of the link graph: priority, scope, depth, budget, filters, delays and statistics.

The traversal is level-synchronous: each level joins the frontier with the
edges, filters in the JVM, drops what was seen and is written, so that lineage stays short and
a lost executor costs no more than a level. Depths are the least ones, and the order within
a level is total: priority from the highest, then the address.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from .tables import new_path, remove, written_at

#: As max_pages: a traversal that ends only where depth and links end.
UNLIMITED = 2**63 - 1
#: mode -> (depth, pages, fetches at a time)
PRESETS = {"lite": (2, 100, 5), "full": (5, 1000, 10), "deep": (50, 50_000, 25)}
VIEWPORTS = {"desktop": (1920, 1080, 1), "tablet": (768, 1024, 2), "mobile": (390, 844, 3)}
DELAY_CAP_MS = 30_000


def check_pattern(pattern: str) -> None:
    """ValueError if pattern isn't one of Spark's regular expressions; without a session, if it is none of Python's."""
    sc = SparkContext._active_spark_context
    try:
        if sc is None:
            re.compile(pattern)
        else:
            sc._jvm.java.util.regex.Pattern.compile(pattern)
    except (re.error, PySparkException) as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from e


@dataclass(frozen=True)
class CrawlOptions:
    """Depth and pages are those of the mode unless given."""

    mode: str = "full"
    max_depth: int | None = None
    max_pages: int | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    respect_robots: bool = True
    agent: str = "skein"
    remove_www: bool = True
    clean_navigation: bool = True
    clean_footers: bool = True
    clean_ads: bool = True
    clean_comments: bool = True
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if self.mode not in PRESETS:
            raise ValueError(f"no mode {self.mode!r}")
        for p in (*self.include, *self.exclude):
            check_pattern(p)

    @property
    def depth(self) -> int:
        return PRESETS[self.mode][0] if self.max_depth is None else self.max_depth

    @property
    def pages(self) -> int:
        return PRESETS[self.mode][1] if self.max_pages is None else self.max_pages


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PRESETS.items()], "mode string, max_depth int, max_pages int, concurrency int")


def viewports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in VIEWPORTS.items()], "device string, width int, height int, scale int")


def matches(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Kept by the patterns: some include pattern is found in the address, if there are any, and no exclude pattern."""
    some = lambda ps: reduce(lambda a, b: a | b, [url.rlike(p) for p in ps])
    return (some(include) if include else F.lit(True)) & (~some(exclude) if exclude else F.lit(True))


def priority(source: Column, depth: Column, same_host: Column) -> Column:
    """3 for seeds, sitemaps and feeds; internal links 2 up to depth 1 and 1 below; others 1 on the seed's host, else 0."""
    return F.when(source.isin("seed", "sitemap", "feed"), 3).when(source == "internal", F.when(depth <= 1, 2).otherwise(1)).when(same_host, 1).otherwise(0)


def traverse(edges: DataFrame, seeds: DataFrame, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """(url, depth, source, priority): what a crawl over edges(src, dst, source) from seeds(url) discovers, in normal form.

    Mode lite follows nothing, full stays on the seeds' hosts, deep goes
    everywhere. The budget counts discovered pages. The patterns filter pages to follow, seeds
    included: a page that they leave out is discovered, but its links aren't followed.

    The visited set is one table, to which each level adds its files; a level's job reads it once, and a task that is
    repeated adds nothing, as files of a level get their names when all are whole.
    """
    spark = edges.sparkSession
    hosts = seeds.select(urls.host("url").alias("seed_host")).distinct()
    norm = lambda c: urls.normalize(c, options.remove_www)
    # repeated edges stay: each level groups by its pages anyway, and so all edges are written without a shuffle
    graph, graph_path = written_at(edges.select(norm("src").alias("src"), norm("dst").alias("dst"), "source"), "edges")
    first = seeds.select(norm("url").alias("url")).distinct().select("url", F.lit(0).alias("depth"), F.lit("seed").alias("source"), F.lit(3).alias("priority"))
    schema, visited = first.schema, new_path(spark, "visited")

    def add(level: DataFrame, depth: int) -> tuple[DataFrame, int]:
        level.drop("depth").write.parquet(f"{visited}/depth={depth}")
        level = spark.read.schema(schema).option("basePath", visited).parquet(f"{visited}/depth={depth}")
        return level, level.count()

    level, found = add(first, 0)
    for depth in range(1, options.depth + 1):
        if options.mode == "lite" or found >= options.pages:
            break
        follow = level.filter(matches(F.col("url"), options.include, options.exclude)).select(F.col("url").alias("src"))
        x = follow.join(graph, "src").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct((F.col("source") != "internal").alias("o"), "source")).alias("s")).select("url", F.col("s.source").alias("source"))
        seen = spark.read.schema(schema).parquet(visited).select("url")
        x = x.join(seen, "url", "left_anti").withColumn("h", urls.host("url"))
        x = x.join(hosts, x["h"] == hosts["seed_host"], "left").withColumn("same", F.col("seed_host").isNotNull())
        if options.mode == "full":
            x = x.filter("same")
        x = x.select("url", F.lit(depth).alias("depth"), "source", priority(F.col("source"), F.lit(depth), F.col("same")).alias("priority"))
        new, new_path_ = written_at(x, "level")
        n = new.count()
        if found + n > options.pages:
            new, n = new.orderBy(F.desc("priority"), "url").limit(options.pages - found), options.pages - found
        if n:
            level, n = add(new, depth)
        remove(spark, new_path_)
        if not n:
            break
        found += n
    remove(spark, graph_path)
    return spark.read.schema(schema).parquet(visited).select("url", "depth", "source", "priority")


def order(tasks: DataFrame) -> DataFrame:
    """tasks with seq: the order in which a crawl takes them."""
    return tasks.orderBy(F.desc("priority"), "depth", "url")


def rejected(edges: DataFrame, seeds: DataFrame, tasks: DataFrame, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """One row, skipped: the links that traverse(edges, seeds, options), which gave tasks, rejected by depth, budget or scope.

    Each of the distinct links of a followed page counts once, wherever it leads: a link beyond the depth or after the
    budget was full is rejected even if its page was seen before, any other link to a seen page is a repeat
    and isn't. Mode lite rejects nothing, as it looks at no link.
    """
    norm = lambda c: urls.normalize(c, options.remove_www)
    if options.mode == "lite":
        return edges.sparkSession.createDataFrame([(0,)], "skipped long")
    graph = edges.select(norm("src").alias("src"), norm("dst").alias("dst"), "source")
    sizes = sorted((r["depth"], r["count"]) for r in tasks.groupBy("depth").count().collect())  # one row a level
    full = min((d for d, _ in sizes if sum(n for e, n in sizes if e <= d) >= options.pages), default=options.depth)
    follow = tasks.filter(matches(F.col("url"), options.include, options.exclude)).select(F.col("url").alias("src"), "depth")
    known = tasks.select(F.col("url").alias("dst"), F.lit(True).alias("known"))
    hosts = seeds.select(urls.host("url").alias("seed_host")).distinct().withColumn("same", F.lit(True))
    x = follow.join(graph, "src").distinct()  # only links of followed pages are shuffled
    x = x.join(known, "dst", "left").withColumn("h", urls.host("dst"))
    x = x.join(hosts, F.col("h") == F.col("seed_host"), "left")
    late = F.col("depth") >= min(full, options.depth)
    return x.agg(F.count_if(late | F.col("known").isNull() | (F.lit(options.mode == "full") & F.col("same").isNull())).alias("skipped"))


def stats(tasks: DataFrame, pages: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: discovered, crawled, errors and skipped. pages(url, status): what was fetched; status 400 and more is an error, as is a page that is missing.

    skipped(skipped) is the row of rejected; without it no link counts as rejected, and skipped is 0.
    """
    p = pages.select(urls.normalize("url").alias("url"), "status").join(tasks.select("url"), "url", "left_semi").groupBy("url").agg(F.min("status").alias("status"))
    x = tasks.join(p, "url", "left")
    good = F.col("status") < 400
    x = x.agg(F.count("*").alias("discovered"), F.count_if(good).alias("crawled"), F.count_if(~F.coalesce(good, F.lit(False))).alias("errors"), *([F.lit(0).cast("long").alias("skipped")] if skipped is None else []))
    return x if skipped is None else x.crossJoin(skipped.select("skipped"))


def should_crawl(candidates: DataFrame, visited: DataFrame, seed_host: str, mode: str, discovered: int, max_pages: int) -> DataFrame:
    """The candidates(url) that are new, in scope and within the budget; nothing is counted."""
    x = candidates.withColumn("url", urls.normalize("url")).dropDuplicates(["url"]).join(visited.select("url"), "url", "left_anti")
    x = x.filter(F.lit(mode == "deep") | ((F.lit(mode) == "full") & (urls.host("url") == seed_host)))
    return x if discovered < max_pages else x.limit(0)


def schedule(tasks: DataFrame, delay_ms: int, key: str = "url", by: tuple[str, ...] = ("url",)) -> DataFrame:
    """tasks with start_ms: the earliest start that keeps fetches of a host delay_ms apart."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(urls.host(key)).orderBy(*by)
    return tasks.withColumn("start_ms", ((F.row_number().over(w) - 1) * delay_ms).cast("long"))


def backoff_ms(attempt: Column, retry_after: Column, initial_ms: int = 1000, max_ms: int = 60_000) -> Column:
    """The wait before a further attempt: what the server asks for in seconds, else doubling; capped."""
    asked = F.try_multiply(F.expr("1000L"), retry_after.try_cast("long"))
    return F.least(F.lit(max_ms).cast("long"), F.coalesce(asked, (F.lit(float(initial_ms)) * F.pow(F.lit(2.0), attempt)).cast("long")))


def next_delay(delay: Column, status: Column, initial_ms: int) -> Column:
    """The adaptive delay after a response: doubled on 429 and 503, half more on 500, 502 and 504, a tenth less on success."""
    first, cap = F.lit(initial_ms).cast("long"), F.lit(DELAY_CAP_MS).cast("long")
    return (
        F.when(status.isin(429, 503), F.least(F.greatest(delay * 2, first), cap))
        .when(status.isin(500, 502, 504), F.least(F.greatest(delay + F.floor(delay / 2), first), cap))
        .when(status.between(200, 299), F.greatest(delay - F.floor(delay / 10), first))
        .otherwise(delay)
        .cast("long")
    )


def adaptive_delay(responses: DataFrame, initial_ms: int = 1000) -> DataFrame:
    """(host, n, delay_ms) after all responses(host, at, status) of a host in the order of at and status.

    Responses are sorted by host and time, and a task folds them as they come: it holds one host's delay, however many responses
    a host has.
    """
    kind = responses.schema["host"].dataType.simpleString()

    def run(batches):
        host, n, delay, started = None, 0, initial_ms, False
        for b in batches:
            hosts, ns, delays = [], [], []
            for h, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not started or h != host:
                    if started:
                        hosts.append(host), ns.append(n), delays.append(delay)
                    host, n, delay, started = h, 0, initial_ms, True
                n, delay = n + 1, delay if s is None else delay_after(delay, s, initial_ms)
            if hosts:
                yield pa.RecordBatch.from_arrays([pa.array(hosts, b.schema.field(0).type), pa.array(ns, pa.int64()), pa.array(delays, pa.int64())], ["host", "n", "delay_ms"])
            last = b.schema.field(0).type
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([host], last), pa.array([n], pa.int64()), pa.array([delay], pa.int64())], ["host", "n", "delay_ms"])

    x = responses.select("host", "at", F.col("status").cast("int").alias("status")).repartition("host").sortWithinPartitions("host", "at", "status")
    return x.select("host", "status").mapInArrow(run, f"host {kind}, n long, delay_ms long")


def delay_after(delay: int, status: int, initial_ms: int) -> int:
    """As next_delay, for one response."""
    if status in (429, 503):
        return min(max(delay * 2, initial_ms), DELAY_CAP_MS)
    if status in (500, 502, 504):
        return min(max(delay + delay // 2, initial_ms), DELAY_CAP_MS)
    return max(delay - delay // 10, initial_ms) if 200 <= status < 300 else delay


def delay_ms(strategy: str, fixed_ms: int = 0, min_ms: int = 0, max_ms: int = 0, seed: int = 0, key: Column | None = None, adaptive: Column | None = None) -> Column:
    """The wait before a fetch: none, fixed, random (even between min_ms and max_ms, from a hash of seed and key, so that it is the same each time) or adaptive, the column given."""
    if strategy == "none":
        return F.lit(0).cast("long")
    if strategy == "fixed":
        return F.lit(fixed_ms).cast("long")
    if strategy == "adaptive":
        return adaptive
    if strategy != "random":
        raise ValueError(f"no strategy {strategy!r}")
    return (F.lit(min_ms) + F.pmod(F.xxhash64(F.lit(seed), key), F.lit(max(max_ms - min_ms, 0) + 1))).cast("long")


#: Kind of error -> pattern in its message, in the order of the tests; and whether another attempt may help.
ERRORS = [
    ("timeout", r"(?i)timed? ?out", True), ("dns", r"(?i)dns|resolve", True), ("tls", r"(?i)certificate|tls|ssl", False), ("redirect", r"(?i)redirect", False),
    ("connect", r"(?i)connect|refused|reset", True), ("decode", r"(?i)decod|charset|utf", False), ("body", r"(?i)body", True), ("proxy", r"(?i)proxy", True), ("browser", r"(?i)browser|launch", False), ("render", r"(?i)render|script", False),
    ("parse", r"(?i)pars", False), ("io", r"(?i)disk|permission|no such file", False), ("config", r"(?i)config|option", False), ("max_pages", r"(?i)max(imum)? pages|page limit", False), ("url", r"(?i)invalid (url|address|port)|relative url", False),
]
RETRIED = (429, 500, 502, 503, 504)


def error_kind(status: Column, message: Column) -> Column:
    """struct(kind, retry) of a failed fetch."""
    kind, again = F.when(status == 429, "rate_limited"), F.when(status.isin(*RETRIED), True)
    for name, pattern, retry in ERRORS:
        kind, again = kind.when(message.rlike(pattern), name), again.when(message.rlike(pattern) & (F.coalesce(status, F.lit(0)) < 400), retry)
    return F.struct(kind.when(status >= 500, "server").when(status >= 400, "client").otherwise("other").alias("kind"), again.otherwise(False).alias("retry"))
