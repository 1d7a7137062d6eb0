"""What the operators of this subpackage share: the shared folder, written tables and hashing of words."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, as a URI.

    It lies below ``spark.checkpoint.dir``. Only where that is unset and the
    session runs in one local process, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _DIRS:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="skein-")
            atexit.register(shutil.rmtree, base[7:], True)
        if "://" not in base and not base.startswith("file:"):
            base = "file://" + os.path.abspath(base)
        if base.startswith("file:/") and not base.startswith("file://"):
            base = "file://" + base[5:]
        _DIRS[sc.applicationId] = f"{base.rstrip('/')}/skein-{sc.applicationId}"
    return _DIRS[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are over: its cleaner learns of them when Python and the driver's JVM collect garbage, which long jobs else do late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder, which cuts its lineage; gives the table and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, none of which df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__{n}"
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow filesystem of a URI, and the path in it; usable in workers."""
    return pafs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- hashing

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_B = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POW = np.ones(4096, dtype=np.uint64)
with np.errstate(over="ignore"):
    for _i in range(1, len(_POW)):
        _POW[_i] = _POW[_i - 1] * np.uint64(_B)


def _power(n: np.ndarray) -> np.ndarray:
    """B to the power n, modulo 2**64."""
    if not len(n) or n.max() < len(_POW):
        return _POW[n]
    out, base, n = np.ones(len(n), dtype=np.uint64), _B, n.astype(np.uint64)
    while n.any():
        out = np.where(n & np.uint64(1), out * np.uint64(base), out)
        base, n = base * base % (1 << 64), n >> np.uint64(1)
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, one after the other, and each text's offset among them.

    A word is a run of bytes that aren't ASCII white space. A null is an empty text.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    off = np.frombuffer(low.buffers()[1], dtype=np.int64, count=len(low) + 1 + low.offset)[low.offset :]
    lo, hi = (int(off[0]), int(off[-1])) if len(low) else (0, 0)
    if hi == lo:
        return np.zeros(0, np.uint64), np.zeros(len(low) + 1, np.int64)
    data = np.frombuffer(low.buffers()[2], dtype=np.uint8, count=hi)[lo:]
    off = off - lo
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[off] = True
    first = first[:-1]
    starts = np.flatnonzero(solid & (first | ~np.concatenate(([False], solid[:-1]))))
    last = np.concatenate((first[1:] | ~solid[1:], [True]))
    ends = np.flatnonzero(solid & last) + 1
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):  # a block of words at a time, so that memory stays small
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK)))
            s, e = starts[i:j], ends[i:j]
            a, b = int(s[0]), int(e[-1])
            length = e - s
            rel = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            pos = rel + np.repeat(s, length)
            v = (data[pos].astype(np.uint64) + np.uint64(1)) * _power(rel)
            out[i:j] = np.add.reduceat(v, np.cumsum(length) - length) + length.astype(np.uint64)
            del a, b
            i = j
    return mix(out), np.searchsorted(starts, off)


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)


def ranges(sizes: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Half-open ranges of rows of about size bytes, of one row at least; sizes has the rows' bytes."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size)))
        yield i, j
        i = j


def slices(texts: pa.Array, size: int = 2 << 20) -> Iterator[pa.Array]:
    """texts in parts of about size bytes, of one text at least."""
    for i, j in ranges(lengths(texts), size):
        yield texts.slice(i, j - i)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words.

    A text of fewer words has one run of all; a text without words has none.
    Only a part of the texts is held as hashes at a time.
    """
    for part in slices(texts):
        yield from _shingle_sets(part, width)


def _shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    words, off = word_hashes(texts)
    n = np.diff(off)
    run = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            run += mix(words[k : len(words) - width + 1 + k] + np.uint64(k + 1)) if len(run) else 0
        run = mix(run * np.uint64(_B) + np.uint64(width))
        for a, m in zip(off[:-1].tolist(), n.tolist()):
            if m >= width:
                yield np.unique(run[a : a + m - width + 1])
            elif m:
                h = np.zeros(1, dtype=np.uint64)
                for k in range(m):
                    h += mix(words[a + k : a + k + 1] + np.uint64(k + 1))
                yield mix(h * np.uint64(_B) + np.uint64(m))
            else:
                yield np.zeros(0, dtype=np.uint64)
