"""Exact top-k search with a KD-tree per shard.

Vectors are dealt to shards by hash. Each shard becomes a KD-tree: median splits
along the widest side, with the tight bounding box of every node, written to the
shared folder. The shard's queries are cut into blocks that lie close together and
searched in their own tree at once, which gives each a first kth distance.

Then tasks go through the other shards, a slice of them and a chunk of query blocks
each, the nearest box first. Within a shard nodes are visited best first by the
least bound of box to query; a node is skipped for the queries whose kth distance so
far, carried from the own tree and from shard to shard, is below its bound. What a slice finds
beyond the first kth distance is merged by query. Neither vectors nor boxes pass through
the driver, and queries aren't shuffled: tasks read both from the shared folder.

Distances within a leaf come from one matrix product; those that may be among
the k best are computed again exactly, so that ties are ties.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LEAF = 256
SHARD_ROWS = 20_000
#: Queries that lie close together and are searched at a time.
BLOCK = 128
#: Queries of a task, about, and shards that it goes through.
CHUNK_QUERIES = 4096
SLICE_SHARDS = 64
_EPS = 1e-9
_UNIT = 2.0**-53


class Tree:
    """A KD-tree over the rows of x. Nodes are numbered from 0, children follow their parents."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        lo, hi, start, stop, left, right = [], [], [], [], [], []
        todo = [(0, len(x), -1, False)]
        while todo:
            a, b, parent, is_left = todo.pop()
            node = len(lo)
            if parent >= 0:
                (left if is_left else right)[parent] = node
            part = x[order[a:b]]
            lo.append(part.min(axis=0))
            hi.append(part.max(axis=0))
            start.append(a)
            stop.append(b)
            left.append(-1)
            right.append(-1)
            side = hi[-1] - lo[-1]
            if b - a > leaf and side.max() > 0:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, int(side.argmax())], mid)]
                todo += [(a + mid, b, node, False), (a, a + mid, node, True)]
        self.x, self.ids = np.ascontiguousarray(x[order]), ids[order]
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.start, self.stop, self.left, self.right = (np.array(v, dtype=np.int64) for v in (start, stop, left, right))
        self.norm = np.einsum("ij,ij->i", self.x, self.x)

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.left < 0)


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of each query to a box."""
    d = np.maximum(lo - q, 0) + np.maximum(q - hi, 0)
    return np.einsum("ij,ij->i", d, d)


class Best:
    """The k nearest so far of a block of queries, ordered by distance and then id."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.norm = np.einsum("ij,ij->i", q, q)
        self.dist = np.full((len(q), k), np.inf)
        self.id = np.full((len(q), k), np.iinfo(np.int64).max)
        self.limit = np.full(len(q), np.inf)  # what a search elsewhere has shown of the kth distance

    def kth(self) -> np.ndarray:
        return np.minimum(self.dist[:, -1], self.limit)

    def add(self, rows: np.ndarray, x: np.ndarray, norm: np.ndarray, ids: np.ndarray, own: np.ndarray | None) -> None:
        """Takes points for the queries in rows; own: the place of each query among the points of x, if it is one of them."""
        approx = self.norm[rows, None] + norm[None] - 2 * self.q[rows] @ x.T
        limit = self.kth()[rows]
        if len(ids) > self.k:
            limit = np.minimum(limit, np.partition(approx, self.k, axis=1)[:, self.k])  # one more, as it may be the query itself
        rounding = 4 * (x.shape[1] + 4) * _UNIT * (self.norm[rows] + norm.max())  # of two values of approx, at most
        i, j = np.nonzero(approx <= (limit + _EPS * (1 + np.minimum(limit, 1e300)) + rounding)[:, None])
        if own is not None:
            other = j != own[rows[i]]
            i, j = i[other], j[other]
        if not len(i):
            return
        diff = self.q[rows[i]] - x[j]
        exact = np.einsum("ij,ij->i", diff, diff)
        touched, inverse = np.unique(i, return_inverse=True)
        r = rows[touched]
        owner = np.concatenate((np.repeat(np.arange(len(r)), self.k), inverse))
        dist = np.concatenate((self.dist[r].ravel(), exact))
        id_ = np.concatenate((self.id[r].ravel(), ids[j]))
        order = np.lexsort((id_, dist, owner))
        first = np.searchsorted(owner[order], np.arange(len(r)))
        take = order[first[:, None] + np.arange(self.k)]
        self.dist[r], self.id[r] = dist[take], id_[take]


def search(tree: Tree, best: Best, own: int | np.ndarray | None = None) -> int:
    """Best-first traversal for a block of queries; own: their places among the tree's points, or where they start there. Gives the number of leaves visited."""
    if isinstance(own, int):
        own = own + np.arange(len(best.q))
    todo = [(0.0, 0, bounds(best.q, tree.lo[0], tree.hi[0]))]
    visited = 0
    while todo:
        _, node, bound = heapq.heappop(todo)
        rows = np.flatnonzero(bound * (1 - 1e-12) <= best.kth())
        if not len(rows):
            continue
        if tree.left[node] < 0:
            a, b = tree.start[node], tree.stop[node]
            best.add(rows, tree.x[a:b], tree.norm[a:b], tree.ids[a:b], None if own is None else own - a)
            visited += 1
        else:
            for child in (int(tree.left[node]), int(tree.right[node])):
                d = bounds(best.q, tree.lo[child], tree.hi[child])
                heapq.heappush(todo, (float(d.min()), child, d))
    return visited


def _save(uri: str, **arrays: np.ndarray) -> None:
    fs, path = common.open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    tmp = f"{path}.{np.random.default_rng().integers(1 << 60)}"
    with fs.open_output_stream(tmp) as f:
        f.write(buf.getbuffer())
    fs.move(tmp, path)


def _read(uri: str) -> dict[str, np.ndarray]:
    fs, path = common.open_fs(uri)
    with fs.open_input_stream(path) as f:
        z = np.load(io.BytesIO(f.read()))
    return {k: z[k] for k in z.files}


def _load(uri: str) -> Tree:
    tree = Tree.__new__(Tree)
    vars(tree).update(_read(uri))
    return tree


def _search_home(tree: Tree, places: np.ndarray, k: int) -> list[tuple[np.ndarray, Best]]:
    """Blocks of the tree's points at places, as queries, searched in their own tree: the places of a block and its best."""
    out, groups = [], Tree(tree.x[places], places, BLOCK)
    for node in groups.leaves().tolist():
        own = groups.ids[groups.start[node] : groups.stop[node]]
        best = Best(np.ascontiguousarray(tree.x[own]), k)
        search(tree, best, own)
        out.append((own, best))
    return out


def _rows(query: np.ndarray, ids: np.ndarray, best: Best, new: np.ndarray | None = None) -> pa.RecordBatch:
    """(query, vec_id, neighbour_id, distance) of what was found, or of what is new of it; distances are squared."""
    ok = np.isfinite(best.dist) if new is None else new
    n = ok.sum(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(query, n)), pa.array(np.repeat(ids, n)), pa.array(best.id[ok]), pa.array(best.dist[ok])], ["query", "vec_id", "neighbour_id", "distance"])


def nearest(vectors: DataFrame, k: int = 10, queries: Column | None = None, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance) of the k nearest other rows of every query, by Euclidean distance.

    Queries are the rows of vectors(vec_id, embedding) for which queries is true; all, if it isn't given. All rows are searched.
    Ties are in the order of neighbour_id. Where there are fewer than k other
    rows, all of them come. Repeated rows are neighbours of each other, and queries of their own. Rows
    without vec_id, and vectors that are null, empty or hold a null or NaN or
    infinity, neither query nor are found. Only vectors of equal length are compared.
    An empty table gives an empty result; other columns aren't read.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), asks.alias("asks")).filter("vec_id is not null and size(v) > 0")
    src = src.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).withColumn("dim", F.size("v"))
    uri = common.new_path(spark, "trees")
    n_rows, n_asking = src.agg(F.count("*"), F.count_if("asks")).first()
    shards = max(1, -(-n_rows // shard_rows))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, shard = (x.as_py() for x in key)
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        tree = Tree(x, np.arange(len(x)), leaf)
        asking = table["asks"].to_numpy()[tree.ids]
        tree.ids = table["vec_id"].to_numpy()[tree.ids]
        name = f"{uri}/{dim}-{shard}"
        _save(f"{name}.npz", **vars(tree))
        places = np.flatnonzero(asking)
        blocks = _search_home(tree, places, k) if len(places) else []
        join = lambda arrays, empty: np.concatenate(arrays) if arrays else empty
        own = join([o for o, _ in blocks], np.zeros(0, np.int64))
        kth = join([b.kth() for _, b in blocks], np.zeros(0))
        _save(f"{name}.queries.npz", ends=np.cumsum([len(o) for o, _ in blocks]), own=own, ids=tree.ids[own], x=tree.x[own], kth=kth)
        first = pa.Table.from_batches([_rows(o, tree.ids[o], b) for o, b in blocks] or [_rows(own, own, Best(x[:0], k))]).to_struct_array()
        first = first.combine_chunks() if isinstance(first, pa.ChunkedArray) else first
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64()), "path": [name], "asking": pa.array([len(own)], pa.int64()), "lo": pa.array([tree.lo[0].tolist()], pa.list_(pa.float64())), "hi": pa.array([tree.hi[0].tolist()], pa.list_(pa.float64())),
            "found": pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), first),
        })

    keyed = src.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    found_type = "array<struct<query:long,vec_id:long,neighbour_id:long,distance:double>>"
    made, made_path = common.write_table(keyed.groupBy("dim", "shard").applyInArrow(build, f"dim int, shard long, path string, asking long, lo array<double>, hi array<double>, found {found_type}"), "shards")

    # a chunk is some shards' queries, a slice some shards to search
    cores = spark.sparkContext.defaultParallelism
    slices = -(-shards // SLICE_SHARDS)
    together = max(1, min(CHUNK_QUERIES * shards // max(1, n_asking), shards * slices // (2 * cores), 1024))
    chunks = made.filter("asking > 0").groupBy("dim", F.expr(f"shard div {together}").alias("chunk")).agg(F.collect_list("path").alias("paths"))  # together of them
    tasks = chunks.select("dim", "paths", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    tasks = tasks.repartition(max(1, min(10_000, -(-shards // together) * slices)), "paths", "slice")

    def run(batches):
        for b in batches:
            for dim, paths, part in zip(*(c.to_pylist() for c in b.columns)):
                yield from _search_slice(made_path, dim, paths, part, slices, k)

    schema = "home string, query long, vec_id long, neighbour_id long, distance double"
    more = tasks.mapInArrow(run, schema)
    first = made.select(F.col("path").alias("home"), F.explode("found").alias("f")).select("home", "f.*")
    rank = F.row_number().over(Window.partitionBy("home", "query").orderBy("distance", "neighbour_id"))
    best = first.unionByName(more).withColumn("rank", rank).filter(F.col("rank") <= k)
    out, _ = common.write_table(best.select("vec_id", "rank", "neighbour_id", F.round(F.sqrt("distance"), 6).alias("distance")), "nearest")
    common.remove(spark, uri, made_path)
    return out


def _search_slice(made: str, dim: int, paths: list[str], part: int, slices: int, k: int) -> Iterator[pa.RecordBatch]:
    """What the queries of some shards find in the shards of a slice, beyond what they found at home."""
    blocks = []
    for path in paths:
        z = _read(f"{path}.queries.npz")
        for a, e in zip(np.concatenate(([0], z["ends"][:-1])).tolist(), z["ends"].tolist()):
            best = Best(z["x"][a:e], k)
            best.limit = z["kth"][a:e]
            blocks.append((path, z["own"][a:e], z["ids"][a:e], best))
    fs, table = common.open_fs(made)
    near, dataset = [], ds.dataset(table, filesystem=fs, format="parquet")
    for batch in dataset.to_batches(columns=["shard", "path", "lo", "hi"], filter=ds.field("dim") == dim):
        for shard, path, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
            if shard % slices == part:
                lo, hi = np.array(lo), np.array(hi)
                bound = [np.inf if home == path else float(bounds(best.q, lo, hi).min()) for home, _, _, best in blocks]
                near.append((min(bound), path, bound))
    for least, path, bound in sorted(near):
        mine = [best for low, (_, _, _, best) in zip(bound, blocks) if np.isfinite(low) and low * (1 - 1e-12) <= best.kth().max()]
        tree = _load(f"{path}.npz") if mine else None
        for best in mine:
            search(tree, best)
    for home, own, ids, best in blocks:
        found = _rows(own, ids, best, np.isfinite(best.dist))
        yield found.add_column(0, "home", pa.array([home] * len(found), pa.string()))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id, a.r AS ar, b.vec_id AS neighbour_id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY round(distance, 12), neighbour_id) AS rank FROM d)
SELECT vec_id, rank::INT AS rank, neighbour_id, round(distance, 6) AS distance FROM n WHERE rank <= 10
"""
