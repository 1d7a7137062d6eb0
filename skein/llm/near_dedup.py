"""Near-duplicate documents from bottom-k sketches of one hash function.

Each document is the set of its runs of ``width`` lower-cased words. The ``k``
least hashes of the set are its sketch. Candidates come from inverted lists of
retained values, the union of two sketches estimates a pair's Jaccard
similarity, and the pairs that remain are verified on their full sets.

Lists and prefixes. A pair whose estimate reaches ``estimate`` shares at least
``ceil(estimate * s)`` of the ``s`` values of either sketch. So it shares one of
the ``s - ceil(estimate * s) + 1`` rarest, and only those enter the lists: values
of passages that very many documents share stay out, and no pair is lost.

Groups instead of all pairs. Groups are connected components, so of thousands
of copies not each pair is needed. First each document is verified against one
leader of its lists. Then each document of a list of more than SHORT documents that still has several components is
verified against the list's smallest document. That also bounds what it can share with any other document of the
list: what it shares with the smallest, and of its other shingles those that the corpus has elsewhere, as its sketch tells. If the bound
is below the threshold, the document leaves the list; so a passage that many otherwise different
documents share costs one verification a document and not one a pair. What is left is
compared in blocks: sketches stand in the rows, a long list is split into blocks of BLOCK documents, each against each.
The documents of a block are not compared pair by pair: its sketch values are sorted, and equal ones count for the pairs that have them. So strangers
that share a run of common words cost what they share, and only pairs of different components that share enough have their union's sketch made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Up to this many bytes of identifiers are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Documents in a block of a long list.
BLOCK = 512
#: Lists of up to this many documents are compared in blocks at once; it would take longer to verify each document against the smallest.
SHORT = 2048
#: By this much pairs of the blocks may stay below the estimate.
LOOSER = 0.1
#: Rows of lists that a task compares at a time, and shared values that it counts at a time.
ROWS, COUNTED = 4096, 1 << 22
#: Sketch values by which the bound on shared shingles is loosened, as sketches are samples: if 3 in k of a document's shingles were shared elsewhere, 1 sketch in 20 would show none.
MARGIN = 3


def _sketch_batches(width: int, k: int):
    def run(batches):
        for b in batches:
            ids, n, s1, s2, lists = b.column(0), [], [], [], []
            for h in common.shingle_sets(b.column(1), width):
                n.append(len(h))
                s1.append(int(h.sum().view(np.int64)) if len(h) else 0)
                s2.append(int(common.mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if len(h) else 0)
                lists.append(np.unique(h >> np.uint64(1))[:k].astype(np.int64))
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            off = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            sk = pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
            yield pa.RecordBatch.from_arrays([ids, b.column(2), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n, pa.int64()), sk], ["doc_id", "digest", "s1", "s2", "n", "sk"])

    return run


def _overlap_batches(width: int):
    """(a, b, both, na, nb) of each pair of texts: the sizes of their sets and of what they share. Each text of a batch is hashed once."""

    def run(batches):
        for whole in batches:
            for i, j in common.ranges(common.lengths(whole.column("ta")) + common.lengths(whole.column("tb")), 8 << 20):
                b = whole.slice(i, j - i)
                d = pa.concat_arrays([b.column("ta"), b.column("tb")]).dictionary_encode()
                sets = list(common.shingle_sets(d.dictionary, width))
                at = d.indices.to_numpy()
                pairs = [(sets[x], sets[y]) for x, y in zip(at[: len(b)].tolist(), at[len(b) :].tolist())]
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in pairs]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(both, pa.int64()), pa.array([len(x) for x, _ in pairs], pa.int64()), pa.array([len(y) for _, y in pairs], pa.int64())], ["a", "b", "both", "na", "nb"])

    return run


def _shared_counts(group: np.ndarray, off: np.ndarray, flat: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, n): rows i < j of one group and of different components c, and how many values (row r has flat[off[r]:off[r + 1]]) they share, one at least."""
    rows = len(group)
    row = np.repeat(np.arange(rows), np.diff(off))
    key = flat.view(np.uint64) ^ common.mix(group.view(np.uint64))[row]
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    codes, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (codes, counts)
        if not waiting or not len(codes):
            return new, n
        both, at = np.unique(np.concatenate((codes, new)), return_inverse=True)
        return both, np.bincount(at, np.concatenate((counts, n))).astype(np.int64)

    at, d = np.arange(len(key)), 0
    while len(at):  # those whose value the place d after has too
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at + d] == key[at]]
        i, j = row[at], row[at + d]
        other = c[i] != c[j]
        waiting.append(i[other] * rows + j[other])
        held += len(waiting[-1])
        if held > COUNTED:
            codes, counts = merged()
            waiting, held = [], 0
    codes, counts = merged()
    return codes // max(1, rows), codes % max(1, rows), counts


def _sharing(threshold: float, estimate: float):
    """Of rows (g, node, n, c, sk): the pairs a < b of one g that differ in c, are near enough in size and share as many sketch values as the estimate asks at least."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        g, node, n, c = (t[x].to_numpy() for x in ("g", "node", "n", "c"))
        sk = pa.concat_arrays(t["sk"].chunks)
        size = sk.value_lengths().to_numpy().astype(np.int64)
        i, j, both = _shared_counts(g, np.concatenate(([0], np.cumsum(size))), sk.flatten().to_numpy(), c)
        good = (both >= np.ceil(estimate * np.maximum(size[i], size[j]))) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
        a, b = node[i[good]], node[j[good]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def sized(df: DataFrame, rows: int, width: int = 16) -> DataFrame:
    """df, with a broadcast hint if its checked size allows one."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """(node, c) for each node of edges(a, b): c is the least node of its connected component.

    Alternates large-star and small-star steps; each step is a written table.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        out, path = common.write_table(df, "stars")
        paths.append(path)
        return out

    def least(pairs: DataFrame) -> DataFrame:
        m = pairs.groupBy("a").agg(F.min("b").alias("m"))
        return m.select("a", F.least("a", "m").alias("m"))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.expr("try_sum(cast(xxhash64(a, b) as decimal(38,0)))")).first())

    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(m.select("a", F.col("m").alias("b"))).distinct()
        e2 = written(small)
        after = state(e2)
        common.remove(spark, paths.pop(0))
        e, same, before = e2, after == before, after
        if same:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("c")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("c")).distinct())


def _digest(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _keyed(sk: DataFrame) -> tuple[DataFrame, str, bool]:
    """sk with key instead of repeats, its path, and whether a doc_id has several texts.

    key is the doc_id of a document whose doc_id no other text has; texts that share one have
    hashes of doc_id and digest that are no other document's key.
    """
    repeats = sk.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeats.isEmpty():
        return sk.withColumn("key", F.col("doc_id")), "", False
    texts = sk.join(repeats, "doc_id", "left_semi").dropDuplicates(["doc_id", "digest"])
    several = texts.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("several"))
    texts = texts.join(several, "doc_id", "left")
    salt = 0
    while True:
        named = texts.withColumn("key", F.when(F.col("several"), F.xxhash64(F.lit(salt), "doc_id", "digest")).otherwise(F.col("doc_id"))).drop("several")
        out, path = common.write_table(sk.join(repeats, "doc_id", "left_anti").withColumn("key", F.col("doc_id")).unionByName(named), "sketches")
        if out.groupBy("key").count().filter("count > 1").isEmpty():
            return out, path, not several.isEmpty()
        common.remove(sk.sparkSession, path)
        salt += 1


def _grouped(docs: DataFrame, width: int = 3, k: int = 64, threshold: float = 0.5, estimate: float = 0.35) -> tuple[DataFrame, bool]:
    """(doc_id, digest, key, c) of each document with a word, c being the same within a group; and whether a doc_id has several texts. If none has, key is doc_id and c the group's least one."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _digest("text").alias("digest")).filter("doc_id is not null")
    raw = src.mapInArrow(_sketch_batches(width, k), "doc_id long, digest long, s1 long, s2 long, n long, sk array<long>").filter("n > 0")
    sk, sk_path = common.write_table(raw, "sketches")
    sk, keyed_path, several = _keyed(sk)
    if keyed_path:
        common.remove(spark, sk_path)
        sk_path = keyed_path

    reps = sk.groupBy("s1", "s2").agg(F.min("key").alias("node"))
    members, members_path = common.write_table(sk.select("doc_id", "digest", "key", "s1", "s2").join(reps, ["s1", "s2"]).select("doc_id", "digest", "key", "node"), "members")
    nodes = sk.join(members.filter("key = node").select("key"), "key", "left_semi").select(F.col("key").alias("node"), "n", "sk")

    values = nodes.select("node", "n", F.size("sk").alias("s"), F.explode("sk").alias("v"))
    counts = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    by_node = Window.partitionBy("node")
    ranked = values.join(counts, "v").select("*", F.count("*").over(by_node).alias("shared"), F.row_number().over(by_node.orderBy("df", "v")).alias("r"))
    # a set of k hashes or fewer is its own sketch; where all that are near enough in size are so too, estimates are exact
    needed = F.when(F.col("n") <= F.lit(threshold * k), F.lit(threshold)).otherwise(F.lit(estimate))
    prefix = ranked.filter(F.col("s") - F.col("shared") + F.col("r") <= F.col("s") - F.ceil(needed * F.col("s")) + 1)
    lists, lists_path = common.write_table(prefix.select("v", "node", "n", "s", "shared"), "lists")

    fits = F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m")
    leaders = lists.groupBy("v").agg(F.min(F.struct("node", "n")).alias("l")).select("v", F.col("l.node").alias("b"), F.col("l.n").alias("m"))
    stars = lists.withColumnRenamed("node", "a").join(leaders, "v").filter("a <> b").filter(fits).groupBy("a", "b").agg(F.count("*").alias("both"))
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("both", -F.col("b"))).alias("b"))

    sketch = nodes.select("node", "sk")
    u = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    exact = (F.col("n") <= k) & (F.col("m") <= k)  # both sketches are the sets themselves

    def alike(least: float) -> Column:
        return F.when(exact, F.size(F.array_intersect("sa", "sb")) >= F.lit(threshold) * F.size(F.array_union("sa", "sb"))).otherwise(F.size(F.array_intersect(u, F.array_intersect("sa", "sb"))) >= F.ceil(F.lit(least) * F.size(u)))

    def measured(pairs: DataFrame, name: str) -> tuple[DataFrame, str]:
        """The written pairs(a, b) with both, na and nb."""
        likely, likely_path = common.write_table(pairs, name)
        used = likely.select(F.col("a").alias("key")).union(likely.select(F.col("b").alias("key"))).distinct()
        if keyed_path:
            used = used.join(members.select("key", "doc_id", "digest"), "key")
            texts = src.join(sized(used, 2 * likely.count(), 32), ["doc_id", "digest"]).select("key", "text").dropDuplicates(["key"])
        else:
            texts = src.select(F.col("doc_id").alias("key"), "text").join(sized(used, 2 * likely.count()), "key", "left_semi")
        pair_texts = likely.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
        found, path = common.write_table(pair_texts.mapInArrow(_overlap_batches(width), "a long, b long, both long, na long, nb long"), name)
        common.remove(spark, likely_path)
        return found, path

    def edges(found: DataFrame) -> DataFrame:
        return found.filter((F.col("both") > 0) & (F.col("both") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("both")))).select("a", "b")

    sized_sketch = nodes.select("node", "n", "sk")
    likely = best.join(sized_sketch.toDF("a", "n", "sa"), "a").join(sized_sketch.toDF("b", "m", "sb"), "b").filter(alike(estimate)).select("a", "b")
    first, first_path = measured(likely, "leaders")
    first_c, first_c_path = common.write_table(components(edges(first)), "components")

    def several(rows: DataFrame) -> DataFrame:
        """(v, m): the lists with documents of several components, and how many they have."""
        return rows.groupBy("v").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("m")).filter("x < y").select("v", "m")

    def placed(rows: DataFrame, c: DataFrame) -> DataFrame:
        return rows.join(c, "node", "left").withColumn("c", F.coalesce("c", "node"))

    # each document of the long ones of these lists against the smallest of its list
    mixed, mixed_path = common.write_table((x := placed(lists, first_c)).join(several(x), "v").drop("c"), "mixed")
    long = mixed.filter(F.col("m") > SHORT)
    smallest = long.groupBy("v").agg(F.min(F.struct("n", "node")).alias("l")).select("v", F.col("l.node").alias("b"))
    starred = long.join(smallest, "v").withColumnRenamed("node", "a")
    second, second_path = measured(starred.filter("a <> b").select("a", "b").distinct(), "stars")
    so_far, so_far_path = common.write_table(components(edges(first).unionByName(edges(second))), "components")
    common_values = F.size(F.array_intersect("sa", "sb"))
    held = second.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b").select("a", "b", "both", "na", "nb", common_values.alias("with_b"))
    elsewhere = F.col("na") * F.least(F.lit(1.0), (F.col("shared") - F.col("with_b") + F.when(F.col("na") > k, MARGIN).otherwise(0)) / F.col("s"))
    most = F.least(F.col("both") + elsewhere, F.col("na").cast("double"))
    x = starred.join(held, ["a", "b"], "left").filter(F.col("both").isNull() | (most >= F.lit(threshold) * (F.col("na") + F.col("nb") - most)))
    x = x.select("v", F.col("a").alias("node"), "n").unionByName(mixed.filter(F.col("m") <= SHORT).select("v", "node", "n"))
    open_, open_path = common.write_table(placed(x, so_far), "open")

    # what is left in blocks; few pairs are left here, so those that the estimate misses by little are verified too
    loose = max(0.0, estimate - LOOSER)
    blocks = several(open_).select("v", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = blocks.agg(F.sum(F.col("m") * F.greatest(F.col("blocks") - 1, F.lit(1)))).first()[0] or 0
    left = open_.join(blocks, "v").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    left = left.withColumn("other", F.explode(other)).select(F.xxhash64("v", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "node", "n", "c")
    bucket = F.pmod("g", F.lit(rows // ROWS + 1)).alias("bucket")
    sharing = left.join(sketch, "node").select(bucket, "g", "node", "n", "c", "sk").groupBy("bucket").applyInArrow(_sharing(threshold, loose), "a long, b long").distinct()
    rest = sharing.join(sized_sketch.toDF("a", "n", "sa"), "a").join(sized_sketch.toDF("b", "m", "sb"), "b").filter(alike(loose)).select("a", "b")
    third, third_path = measured(rest, "rest")
    final, final_path = common.write_table(components(edges(first).unionByName(edges(second)).unionByName(edges(third))), "groups")
    common.remove(spark, sk_path, lists_path, first_path, second_path, third_path, first_c_path, so_far_path, mixed_path, open_path)

    return members.join(final, "node", "left").select("doc_id", "digest", "key", F.coalesce("c", "node").alias("c")), several


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, group_id) of all documents that have a near or exact copy; group_id is the least doc_id of the group.

    Two documents are near copies if the Jaccard similarity of their sets of
    word runs (``width`` words) is at least ``threshold``; groups are the connected components.
    Pairs whose sketches (of ``k`` hashes) estimate less than ``estimate`` aren't verified, nor are pairs that the bound from their list's smallest document excludes. Equal
    sets are always found. Rows without doc_id and texts without a word (null,
    empty, white space) are in no group. Only rows of equal doc_id and text are repeats of
    one document. Different texts that share a doc_id are documents of their own, so such a doc_id may be in
    several groups. Columns other than doc_id and text aren't read.
    """
    grouped, several = _grouped(docs, **options)
    if several:
        heads = grouped.groupBy("c").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("m")).filter("m > 1")
        return grouped.join(heads, "c").select("doc_id", "group_id").distinct()
    others = grouped.select("doc_id", F.col("c").alias("group_id")).filter("doc_id <> group_id")
    heads = others.select("group_id").distinct().select(F.col("group_id").alias("doc_id"), "group_id")
    return others.unionByName(heads)


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near copies: that of the least doc_id.

    Options as for near_groups. All columns stay. Rows without doc_id and texts
    without a word stay. Of rows that share doc_id and text, one stays; different texts that share
    a doc_id are documents of their own.
    """
    grouped, several = _grouped(docs, **options)
    lost, digest, again_id, rank = common.fresh(docs, "gone", "digest", "again", "r")
    if several:
        first = grouped.groupBy("c").agg(F.min(F.struct("doc_id", "key")).alias("first"))
        gone = grouped.join(first, "c").filter(F.col("key") != F.col("first.key")).select(F.col("doc_id").alias(lost), F.col("digest").alias(digest))
    else:
        gone = grouped.filter("doc_id <> c").select(F.col("doc_id").alias(lost))
    gone, _ = common.write_table(gone, "gone")
    same = docs["doc_id"].cast("long") == F.col(lost)
    kept = docs.join(sized(gone, gone.count()), same & (F.xxhash64(docs["text"].cast("string")) == F.col(digest)) if several else same, "left_anti")
    repeats = docs.filter(docs["doc_id"].isNotNull()).groupBy("doc_id").agg(F.count("*").alias(rank)).filter(F.col(rank) > 1).select(F.col("doc_id").alias(again_id))
    if repeats.isEmpty():
        return kept
    again = kept.join(repeats, F.col("doc_id") == F.col(again_id), "left_semi")
    order = [F.col("doc_id"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text") and not dict(docs.dtypes)[c].startswith(("map", "variant")))]
    one = again.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*order))).filter(F.col(rank) == 1).drop(rank)
    return kept.join(repeats, F.col("doc_id") == F.col(again_id), "left_anti").unionByName(one)
