"""Sharding by balanced label propagation.

Linked documents move towards the shards of their neighbours, under quotas that
keep every shard within its capacity. Documents are linked by the lines that they share, all
pairs of them, one by each line. The pairs are never built: a line's documents are counted by
shard, and a document adds up the counts of its lines without itself. Each iteration is a few
Spark joins and a written table of labels:

1. Every document sums the weights of its links by the neighbours' shards. If
   some shard has more than its own, it wants to move there. A seeded half of the
   documents takes part in an iteration, as two neighbours that move at the same
   time would only swap places.
2. For each pair of shards the wishes are counted. As many may go as come the other way;
   the room left in a shard is dealt to the other wishes in proportion.
3. The wishes of greatest gain within the quota are carried out.

A shard's size never exceeds ``ceil(documents / shards * (1 + slack))``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHARDS = 32
SLACK = 0.02
ITERATIONS = 8
#: It ends when an iteration moves fewer than this share of the documents.
LEAST_MOVED = 0.001
SEED = 29
MIN_LINE = 30
_SALTS = 64


def line_hashes(docs: DataFrame, min_chars: int = MIN_LINE) -> DataFrame:
    """(d, h): the hashes of a row's distinct lines of at least min_chars characters, beside its doc_id; rows without doc_id are left out."""
    lines = F.array_distinct(F.filter(F.split(docs["text"].cast("string"), "\n"), lambda s: F.length(s) >= min_chars))
    return docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("d"), F.explode(F.transform(lines, lambda s: F.xxhash64(s))).alias("h"))


def shared_lines(docs: DataFrame, min_chars: int = MIN_LINE) -> tuple[DataFrame, str]:
    """The written table (d, h) of all documents of each line that two documents or more share, once each, and its path.

    No window goes over a line's documents, so that a line of very many falls to no one task.
    """
    held, held_path = common.write_table(line_hashes(docs, min_chars).distinct(), "held")
    shared = held.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    lines, path = common.write_table(held.join(shared, "h").select("d", "h"), "lines")
    common.remove(docs.sparkSession, held_path)
    return lines, path


def line_counts(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, to, n): the documents of each line of lines(d, h) by their shard in labels(doc_id, shard); at most lines by shards rows."""
    return lines.join(labels.toDF("d", "to"), "d").groupBy("h", "to").agg(F.count("*").alias("n"))


def line_votes(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, to, w): the weight of a document's links to the documents of each shard, over all pairs that share a line."""
    x = lines.join(line_counts(lines, labels), "h").groupBy(F.col("d").alias("a"), "to").agg(F.sum("n").alias("w"), F.count("*").alias("own"))
    x = x.join(labels.toDF("a", "from"), "a")  # in its own shard a document is among the counted of each of its lines
    return x.select("a", "to", F.when(F.col("to") == F.col("from"), F.col("w") - F.col("own")).otherwise(F.col("w")).alias("w"))


def line_cut(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """One row as cut gives it, over all pairs of documents that share a line of lines(d, h)."""
    pairs = lambda n: F.expr(f"{n} * ({n} - 1) div 2")
    x = line_counts(lines, labels).groupBy("h").agg(F.sum("n").alias("m"), F.sum(pairs("n")).alias("kept"))
    return x.agg(F.sum(pairs("m")).alias("weight"), F.sum(pairs("m") - F.col("kept")).alias("cut"))


def shared_line_links(docs: DataFrame, min_chars: int = MIN_LINE) -> DataFrame:
    """links(a, b, w), a < b, between some of the documents that share lines of at least min_chars characters.

    Shards aren't made from these, see shared_lines. The documents of a line form a chain, so
    that links are never more than lines. The chain is made of chains by a salt, which keeps a line of very many
    documents from falling to one task. w is the number of lines by which two
    documents are linked.
    """
    x = line_hashes(docs, min_chars).withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(_SALTS)))
    x = x.withColumn("p", F.lag("d").over(Window.partitionBy("h", "salt").orderBy("d")))
    heads = x.filter("p is null").withColumn("p", F.lag("d").over(Window.partitionBy("h").orderBy("salt")))
    pairs = x.select("p", "d").unionByName(heads.select("p", "d")).filter("p <> d")
    return pairs.groupBy(F.least("p", "d").alias("a"), F.greatest("p", "d").alias("b")).agg(F.count("*").alias("w"))


def dealt(ids: DataFrame, key: str, shards: int) -> DataFrame:
    """(doc_id, shard) of ids(doc_id, key): equal slices in the order of (key, doc_id), without a global sort."""
    x = ids.withColumn("p", F.shiftright(key, 52))
    parts = x.groupBy("p").agg(F.count("*").alias("m"))
    total = parts.agg(F.sum("m").alias("n"))
    parts = parts.withColumn("before", F.sum("m").over(Window.orderBy("p")) - F.col("m")).crossJoin(F.broadcast(total))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy(key, "doc_id")) - 1
    x = x.join(F.broadcast(parts.drop("m")), "p").withColumn("rank", rank)  # at most 4096 parts
    return x.select("doc_id", F.floor(F.col("rank") * shards / F.col("n")).cast("int").alias("shard"))


def quotas(wishes: DataFrame, sizes: DataFrame, capacity: int) -> DataFrame:
    """(from, to, quota) from wishes(from, to, n) and sizes(shard, size); at most shards squared rows."""
    back = wishes.select(F.col("to").alias("from"), F.col("from").alias("to"), F.col("n").alias("back"))
    x = wishes.join(back, ["from", "to"], "left").join(sizes.withColumnRenamed("shard", "to"), "to", "left")
    x = x.withColumn("swap", F.least("n", F.coalesce("back", F.lit(0)))).withColumn("more", F.col("n") - F.col("swap"))
    room, asked = F.lit(capacity) - F.coalesce("size", F.lit(0)), F.sum("more").over(Window.partitionBy("to"))
    extra = F.when(asked > 0, F.floor(F.least(room, asked) * F.col("more") / asked)).otherwise(0)
    return x.select("from", "to", (F.col("swap") + extra).alias("quota"))


def cut(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the links, and those whose ends lie in different shards, by weight."""
    x = links.join(labels.toDF("a", "sa"), "a").join(labels.toDF("b", "sb"), "b")
    return x.agg(F.sum("w").alias("weight"), F.sum(F.when(F.col("sa") != F.col("sb"), F.col("w")).otherwise(0)).alias("cut"))


def shard(docs: DataFrame, links: DataFrame | None = None, shards: int = SHARDS, slack: float = SLACK, iterations: int = ITERATIONS, least_moved: float = LEAST_MOVED, seed: int = SEED) -> DataFrame:
    """(doc_id, shard) of each distinct doc_id of docs, shard from 0 to shards - 1.

    If no links(a, b, w) are given, all pairs of documents that share lines of MIN_LINE characters
    are linked, w being the number of these lines. Links to documents that docs lacks and of a document to itself don't count. Rows without doc_id are
    in no shard. A null or empty text has no links, nor has a line of which there
    is one copy. Documents without links stay where they were dealt; so do
    all if two shards are equally good. An empty table gives an empty result. Other
    columns aren't read.

    The start is even: documents in the order of a hash of their least neighbour, in equal slices.
    """
    spark = docs.sparkSession
    if links is None:
        lines, links_path = shared_lines(docs)
        first = lines.groupBy("h").agg(F.min("d").alias("m"))
        least = lines.join(first, "h").groupBy(F.col("d").alias("doc_id")).agg(F.min("m").alias("m"))
    else:
        links, links_path = common.write_table(links.filter("a <> b").select("a", "b", F.col("w").cast("long").alias("w")), "links")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        least = both.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("m"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    keyed = ids.join(least, "doc_id", "left").select("doc_id", F.xxhash64(F.lit(seed), F.least("doc_id", F.coalesce("m", "doc_id"))).alias("key"))
    labels, path = common.write_table(dealt(keyed, "key", shards).withColumn("moved", F.lit(False)), "labels")
    n = labels.count()
    capacity = math.ceil(n / shards * (1 + slack))
    for i in range(iterations):
        label = labels.select("doc_id", "shard")
        if links is None:
            votes = line_votes(lines, label)
        else:
            votes = both.join(label.toDF("b", "to"), "b").select("a", "to", "w").repartition("a").groupBy("a", "to").agg(F.sum("w").alias("w"))
        x = votes.join(label.toDF("a", "from"), "a")
        best = x.groupBy("a", "from").agg(F.max(F.struct("w", (-F.col("to")).alias("t"))).alias("best"), F.sum(F.when(F.col("to") == F.col("from"), F.col("w")).otherwise(0)).alias("own"))
        half = F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "a"), F.lit(2)) == 0
        wish = best.select("a", "from", (-F.col("best.t")).alias("to"), (F.col("best.w") - F.col("own")).alias("gain")).filter("gain > 0").filter(half)
        wish, wish_path = common.write_table(wish, "wishes")
        quota = quotas(wish.groupBy("from", "to").agg(F.count("*").alias("n")), label.groupBy("shard").agg(F.count("*").alias("size")), capacity)
        order = Window.partitionBy("from", "to").orderBy(F.desc("gain"), "a")
        going = wish.withColumn("r", F.row_number().over(order)).join(F.broadcast(quota), ["from", "to"]).filter("r <= quota").select(F.col("a").alias("doc_id"), "to")
        new = label.join(going, "doc_id", "left").select("doc_id", F.coalesce("to", "shard").alias("shard"), F.col("to").isNotNull().alias("moved"))
        labels, new_path = common.write_table(new, "labels")
        common.remove(spark, path, wish_path)
        path = new_path
        if labels.filter("moved").count() <= least_moved * n:
            break
    common.remove(spark, links_path)
    return labels.select("doc_id", "shard")
