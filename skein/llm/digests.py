"""Sorted digest arrays: flat files that workers map into memory and probe by a vectorised binary search.

A shard is some files of the shared folder: the sorted 64-bit keys of its strings, the offsets of the strings,
the strings and, if there are any, arrays of values with their offsets. Each hit is confirmed against the stored string,
so that colliding keys never pass for each other. Workers of a machine share the pages that their probes touch;
nothing is broadcast and no worker holds a shard in its own memory.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame

from . import common

#: Strings in a shard, about.
SHARD_ROWS = 4_000_000
SUFFIXES = (".keys", ".offsets", ".strings", ".ends", ".values")
Shard = tuple[str, int, int]


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and bytes of an array of strings without nulls."""
    t = strings.cast(pa.large_binary())
    if not len(t):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(t.buffers()[1], dtype=np.int64, count=len(t) + 1 + t.offset)[t.offset :]
    data = np.frombuffer(t.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], data


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)


def write(rows: DataFrame, name: str, shards: int) -> list[Shard]:
    """Writes the arrays of rows(key, s) or rows(key, s, values), and gives each shard's path and its least and greatest key.

    key is a long that s determines, s a string, values an array of int. Rows must be written already, as they are read twice.
    A shard is written under a name of its attempt and then renamed, so that a repeated task does no harm. One row a shard comes to the driver.
    """
    spark = rows.sparkSession
    uri = common.new_path(spark, name)
    valued = "values" in rows.columns

    def run(batches):
        keys, texts, lists = [], [], []
        for b in batches:
            keys.append(b.column(0).to_numpy())
            texts.append(b.column(1).cast(pa.large_string()))
            if valued:
                lists.append(b.column(2).cast(pa.large_list(pa.int32())))
        if not sum(map(len, keys)):
            return
        k = np.concatenate(keys)
        off, data = raw(pa.concat_arrays(texts))
        files = [(".keys", k), (".offsets", off), (".strings", data)]
        if valued:
            v = pa.concat_arrays(lists)
            ends = v.offsets.to_numpy()
            files += [(".ends", ends - ends[0]), (".values", v.flatten().to_numpy())]
        fs, base = common.open_fs(uri)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        for suffix, a in files:
            tmp = f"{base}/.{ctx.partitionId()}-{ctx.taskAttemptId()}{suffix}"
            with fs.open_output_stream(tmp) as f:
                f.write(pa.py_buffer(np.ascontiguousarray(a)))
            fs.move(tmp, f"{base}/{ctx.partitionId():05d}{suffix}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{uri}/{ctx.partitionId():05d}"]), pa.array([int(k[0])]), pa.array([int(k[-1])])], ["path", "lo", "hi"])

    ordered = rows.select("key", "s", *(["values"] if valued else [])).repartitionByRange(shards, "key").sortWithinPartitions("key", "s")
    out = sorted((r["path"], r["lo"], r["hi"]) for r in ordered.mapInArrow(run, "path string, lo long, hi long").collect())
    if not uri.startswith("file:"):  # Spark hands the files to each executor, which maps its own copies
        for p, _, _ in out:
            for suffix in SUFFIXES[: 5 if valued else 3]:
                spark.sparkContext.addFile(p + suffix)
    return out


@lru_cache(64)
def _shard(path: str) -> dict[str, np.ndarray]:
    local = (lambda s: path[len("file:") :].replace("//", "/", 1) + s) if path.startswith("file:") else (lambda s: SparkFiles.get(os.path.basename(path) + s))
    types = dict(zip(SUFFIXES, (np.int64, np.int64, np.uint8, np.int64, np.int32)))
    return {s[1:]: np.memmap(local(s), dtype=t, mode="r") if os.path.getsize(local(s)) else np.zeros(0, t) for s, t in types.items() if os.path.exists(local(s))}


def _equal(off: np.ndarray, data: np.ndarray, i: np.ndarray, s: dict[str, np.ndarray], p: np.ndarray) -> np.ndarray:
    """Whether the i-th strings are those stored at p."""
    a, b = off[i], s["offsets"][p]
    n = off[i + 1] - a
    same = n == s["offsets"][p + 1] - b
    some = np.flatnonzero(same & (n > 0))
    if len(some):
        n = n[some]
        eq = data[spread(a[some], n)] == s["strings"][spread(b[some], n)]
        same[some] = np.logical_and.reduceat(eq, np.cumsum(n) - n)
    return same


def probe(keys: np.ndarray, strings: pa.Array, shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """The shard (its place in shards) and the place in it where each string, of the given key, is stored; -1 where it isn't."""
    where, place = np.full(len(keys), -1), np.full(len(keys), -1, dtype=np.int64)
    off, data = raw(strings)
    for k, (path, lo, hi) in enumerate(shards):
        i = np.flatnonzero((keys >= lo) & (keys <= hi) & (where < 0))
        if not len(i):
            continue
        s = _shard(path)
        p = np.searchsorted(s["keys"], keys[i])
        while len(i):  # strings of one key lie side by side
            there = np.flatnonzero(p < len(s["keys"]))
            i, p = i[there], p[there]
            there = np.flatnonzero(s["keys"][p] == keys[i])
            i, p = i[there], p[there]
            hit = _equal(off, data, i, s, p)
            where[i[hit]], place[i[hit]] = k, p[hit]
            i, p = i[~hit], p[~hit] + 1
    return where, place


def values(where: np.ndarray, place: np.ndarray, shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """The values of strings found by probe: how many each has (0 where it isn't stored), and all, one string's after the other's."""
    n = np.zeros(len(where), dtype=np.int64)
    for k in np.unique(where[where >= 0]).tolist():
        i = np.flatnonzero(where == k)
        ends = _shard(shards[k][0])["ends"]
        n[i] = ends[place[i] + 1] - ends[place[i]]
    out, start = np.empty(int(n.sum()), dtype=np.int32), np.cumsum(n) - n
    for k in np.unique(where[where >= 0]).tolist():
        i = np.flatnonzero(where == k)
        s = _shard(shards[k][0])
        out[spread(start[i], n[i])] = s["values"][spread(s["ends"][place[i]], n[i])]
    return n, out
