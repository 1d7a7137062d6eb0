"""Statistics of a corpus: duplicates, words, entities, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls
from .tables import fresh, written_at


def exact_dedup(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row of each text: that of the least id, a null id coming last. Null texts are as empty ones.

    Only ids and digests are shuffled, and those rows whose id and text occur more than once: of them the least by their columns stays.
    """
    digest = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    d, n, first, rank = fresh(docs, "digest", "n", "first", "rank")
    counts = docs.groupBy(digest.alias(d), F.col(id_).alias(first)).agg(F.count("*").alias(n))
    least = counts.groupBy(d).agg(F.min(F.struct(F.col(first).isNull(), F.col(first), F.col(n))).alias(first)).select(F.col(d), F.col(f"{first}.{first}").alias(first), F.col(f"{first}.{n}").alias(n))
    x = docs.withColumn(d, digest)
    x = x.join(least, [x[d] == least[d], F.col(id_).eqNullSafe(F.col(first))]).drop(least[d])
    order = [F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith(("map", "variant"))]
    again = x.filter(F.col(n) > 1).withColumn(rank, F.row_number().over(Window.partitionBy(d).orderBy(*order))).filter(F.col(rank) == 1).drop(rank)
    return x.filter(F.col(n) == 1).unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def digests(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(digest, first_id, n) of each distinct text."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest")).agg(F.min(id_).alias("first_id"), F.count("*").alias("n"))


def word_frequency(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] = T.STOP_WORDS) -> DataFrame:
    """(word, n): ASCII words of three letters and more in lower case, without stop words."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), 0)).alias("word"))
    return words.filter(~F.col("word").isin(*stop_words)).groupBy("word").agg(F.count("*").alias("n"))


def entities(docs: DataFrame, rules: tuple[str, ...] = ("email", "phone", "ipv4", "card", "semver", "handle"), text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(id, rule, pos, match): all matches of the named patterns."""
    m = F.array(*[F.struct(F.lit(r).alias("rule"), T.found(text, r).alias("m")) for r in rules])
    x = docs.select(id_, F.explode(m).alias("e")).select(id_, "e.rule", F.posexplode("e.m").alias("pos", "match"))
    return x


def scores(docs: DataFrame, keywords: tuple[str, ...], text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(id, emails, phones, prices, dates, links, density, score) of each document.

    Words are counted and letters lowered once a text, and a pattern is tried where its fixed part occurs.
    """

    def n(t: Column, rule: str, part: str | None = None) -> Column:
        hits = F.size(T.found(t, rule)).cast("long")
        return hits if part is None else F.when(t.contains(part), hits).otherwise(F.lit(0).cast("long"))

    def all_(t: Column) -> Column:
        return F.struct(
            n(t, "email", "@").alias("emails"), F.when(t.rlike("[0-9]{3}"), n(t, "phone")).otherwise(F.lit(0).cast("long")).alias("phones"), n(t, "price", "$").alias("prices"),
            F.when(t.rlike("[0-9]"), n(t, "date")).otherwise(F.lit(0).cast("long")).alias("dates"), n(t, "url", "http").alias("links"), T.keyword_densities(t, keywords).alias("density"),
        )

    x = docs.select(id_, urls.let(F.coalesce(F.col(text), F.lit("")), all_).alias("s")).select(id_, "s.*")
    return x.withColumn("score", T.page_score(*[F.col(c) for c in ("emails", "phones", "prices", "dates", "links", "density")]))


def report(pages: DataFrame, text: str, group: str) -> DataFrame:
    """(group, pages, words, avg_words): counts by a column, with a row for all (group null)."""
    return pages.rollup(group).agg(F.count("*").alias("pages"), F.sum(T.word_count(text)).alias("words"), F.avg(T.word_count(text)).alias("avg_words"))


def histogram(pages: DataFrame, column: str) -> DataFrame:
    """(column, n): how many pages have each value."""
    return pages.groupBy(column).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key: an upsert as a table."""
    (rank,) = fresh(rows, "rank")
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with a column name: their number, from 0, in the order of by; rows of equal by in any order.

    Rows are cut into ranges of by, counted by range and numbered within each, so that no task takes them all.
    """
    (part,) = fresh(rows, "part")
    x, _ = written_at(rows.repartitionByRange(by).withColumn(part, F.spark_partition_id()), "ranges")
    before = x.groupBy(part).agg(F.count("*").alias(name)).withColumn(name, F.sum(name).over(Window.orderBy(part)) - F.col(name))  # a row a range
    own = F.row_number().over(Window.partitionBy(part).orderBy(by)) - 1
    return x.join(F.broadcast(before), part).withColumn(name, F.col(name) + own).drop(part)


def file_names(pages: DataFrame, url: str = "url", by: str = "page_id") -> DataFrame:
    """pages with name: a running number of three digits and the slug, cut to 80 characters."""
    n = F.col("name").cast("string")
    name = F.concat(F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")), F.lit("_"), F.substring(urls.slug(url), 1, 80))
    return numbered(pages, by, "name").withColumn("name", name)


def described(pages: DataFrame, **columns: Column) -> DataFrame:
    """(measure, n, mean, std, least, p25, median, p75, most) of each of the columns, quartiles interpolated; nulls don't count.

    Quartiles are exact: values are counted first, so that a task holds distinct values and not rows.
    """
    values = F.array(*[F.struct(F.lit(k).alias("measure"), c.cast("double").alias("v")) for k, c in columns.items()])
    x = pages.select(F.explode(values).alias("x")).select("x.*").filter("v is not null").groupBy("measure", "v").agg(F.count("*").alias("k"))
    q = lambda p: F.expr(f"percentile(v, {p}, k)")
    total, weighted = F.sum("k"), F.sum(F.col("v") * F.col("k"))
    squares = F.sum(F.col("v") * F.col("v") * F.col("k"))
    std = F.when(total > 1, F.sqrt(F.greatest(F.lit(0.0), (squares - weighted * weighted / total) / (total - 1))))
    return x.groupBy("measure").agg(total.alias("n"), (weighted / total).alias("mean"), std.alias("std"), F.min("v").alias("least"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max("v").alias("most"))
