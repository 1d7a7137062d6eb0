"""Token counts of documents in flat token files, by a separator scan.

A flat file holds the ids of many documents, one after the other, each closed by
the end-of-document id; nothing tells where documents begin. Files are cut into
blocks of equal size. A task reads a block as one array and finds the separators
with a vectorised comparison. A document may span any number of blocks: an
exclusive prefix scan over the blocks of a file carries on the number of
separators before a block and the place of the last one, which stitches the
boundaries. Only positions of separators leave a task, never tokens.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, common

#: The end-of-document id of the vocabulary's files.
EOD = 50256
DTYPE = "<u2"
BLOCK_BYTES = 32 << 20
#: Parts of a table whose flat files exist one after the other, as the files of all are larger than the table.
PARTS = 2


def write_files(tokens: DataFrame, eod: int = EOD, dtype: str = DTYPE, uri: str = "", members_uri: str = "") -> tuple[DataFrame, DataFrame]:
    """Writes tokens(doc_id, token_ids) to flat files of the shared folder, one a partition.

    Gives files(path, bytes) and members(path, ordinal, doc_id), which says whose
    document is the ordinal-th of a file. A null array is an empty document. A
    file gets its name when it is whole, so a repeated task does no harm. An id
    that equals eod or doesn't fit the type is an error. uri and members_uri are where
    files and members go, new paths of the shared folder if not given.
    """
    spark = tokens.sparkSession
    uri = uri or common.new_path(spark, "tokens")
    most = np.iinfo(np.dtype(dtype)).max

    def write(batches):
        ctx = TaskContext.get()
        fs, base = common.open_fs(uri)
        fs.create_dir(base, recursive=True)
        name = f"{ctx.partitionId():06d}.bin"
        tmp = f"{base}/.{name}-{ctx.taskAttemptId()}"
        done, path = 0, f"{uri}/{name}"
        with fs.open_output_stream(tmp) as f:
            for b in (whole.slice(i, 500) for whole in batches for i in range(0, len(whole), 500)):
                col = b.column(1)
                n = pc.fill_null(pc.list_value_length(col), 0).to_numpy().astype(np.int64)
                ids = col.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() > most or (ids == eod).any()):
                    raise ValueError(f"ids must be from 0 to {most}, and not {eod}")
                ends = np.cumsum(n)
                f.write(np.insert(ids.astype(dtype), ends, np.array(eod, dtype)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(b)), pa.array(done + np.arange(len(b))), b.column(0)], ["path", "ordinal", "doc_id"])
                done += len(b)
                pa.default_memory_pool().release_unused()
        if done:
            fs.move(tmp, f"{base}/{name}")
        else:
            fs.delete_file(tmp)

    x = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids"))
    members_uri = members_uri or common.new_path(spark, "members")
    x.mapInArrow(write, schema := "path string, ordinal long, doc_id long").write.parquet(members_uri)
    members = spark.read.schema(schema).parquet(members_uri)
    return with_sizes(members.select("path").distinct()), members


def with_sizes(paths: DataFrame) -> DataFrame:
    """(path, bytes) of files(path)."""

    def run(batches):
        for b in batches:
            paths = b.column(0).to_pylist()
            size = []
            for p in paths:
                fs, q = common.open_fs(p)
                size.append(fs.get_file_info(q).size)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(size, pa.int64())], ["path", "bytes"])

    return paths.select("path").mapInArrow(run, "path string, bytes long")


def _scan(eod: int, dtype: str):
    width = np.dtype(dtype).itemsize

    def run(batches):
        for b in batches:
            for path, block, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                fs, q = common.open_fs(path)
                with fs.open_input_file(q) as f:
                    a = np.frombuffer(f.read_at(stop - start, start), dtype=dtype)
                at = np.flatnonzero(a == eod)
                one = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block]), pa.array([start // width]), pa.array([len(a)]), pa.array([len(at)]), pa.array([start // width + int(at[-1])] if len(at) else [None], pa.int64()), one],
                    ["path", "block", "base", "n", "n_seps", "last", "seps"],
                )

    return run


def count_tokens(files: DataFrame, eod: int = EOD, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, start, n_tokens, closed) of each document of files(path, bytes).

    start is the place of its first token in the file and n_tokens its length
    without the separator. A separator right after another closes an empty document.
    Tokens after a file's last separator are a document with closed = false; an
    empty file has none. Repeated rows of files count once. Bytes beyond a whole
    number of ids are ignored.
    """
    spark = files.sparkSession
    width = np.dtype(dtype).itemsize
    step = max(width, block_bytes // width * width)
    whole = files.groupBy("path").agg((F.floor(F.max("bytes") / width) * width).cast("long").alias("bytes")).filter("bytes > 0")
    blocks = whole.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))).alias("block"))
    blocks = blocks.select("path", "block", (F.col("block") * step).alias("start"), F.least((F.col("block") + 1) * step, "bytes").alias("stop"))
    blocks, blocks_path = common.write_table(blocks, "blocks")
    parts = max(spark.sparkContext.defaultParallelism, -(-blocks.count() * step // (4 * BLOCK_BYTES)))
    found, _ = common.write_table(blocks.repartition(parts, "path", "block").mapInArrow(_scan(eod, dtype), "path string, block long, base long, n long, n_seps long, last long, seps array<int>"), "separators")
    common.remove(spark, blocks_path)

    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("path")
    scan = found.select("path", "block", "base", "n", "n_seps", "last")
    scan = scan.select("path", "block", F.coalesce(F.sum("n_seps").over(before), F.lit(0)).alias("ordinal"), F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("carry"),
                       F.max(F.col("base") + F.col("n")).over(of_file).alias("end"), F.max("last").over(of_file).alias("final"), F.sum("n_seps").over(of_file).alias("all"), F.max("block").over(of_file).alias("last_block"))
    x = found.select("path", "block", "base", "seps").join(scan, ["path", "block"])
    x = x.withColumn("seps", F.transform("seps", lambda s: s + F.col("base")))
    x = x.withColumn("starts", F.concat(F.array("carry"), F.transform("seps", lambda s: s + 1)))
    docs = x.select("path", "ordinal", F.posexplode(F.arrays_zip(F.slice("starts", 1, F.size("seps")).alias("s"), F.col("seps").alias("e"))).alias("i", "d"))
    docs = docs.select("path", (F.col("ordinal") + F.col("i")).alias("ordinal"), F.col("d.s").alias("start"), (F.col("d.e") - F.col("d.s")).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = scan.filter("block = last_block").withColumn("start", F.coalesce(F.col("final") + 1, F.lit(0))).filter("end > start")
    return docs.unionByName(rest.select("path", F.col("all").alias("ordinal"), "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))


def document_counts(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens) of each row of docs(doc_id, text), counted in the flat files of its tokens.

    A null or empty text has none. Rows with null or repeated doc_id have rows of
    their own. An empty table gives an empty result; other columns aren't read.
    Rows fall into PARTS by a hash; the files of a part are deleted once its documents are counted.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    shards = bpe.build_dictionary(docs, vocabulary)
    common.release(spark)  # of the words' shuffle
    counted = []
    for part in range(PARTS):
        own = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS)) == part)
        uri, members_uri = common.new_path(spark, "tokens"), common.new_path(spark, "members")
        files, members = write_files(bpe.encode(own, vocabulary, shards=shards), EOD, DTYPE, uri, members_uri)
        counts = members.join(count_tokens(files, EOD, DTYPE, block_bytes), ["path", "ordinal"]).select("doc_id", "n_tokens")
        counted.append(common.write_table(counts, "counts")[0])
        common.remove(spark, uri, members_uri)
        common.release(spark)
    return reduce(DataFrame.unionByName, counted)
