"""Written tables that cut the lineage of iterations."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir; a temporary one where that is unset and all runs in one process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="skein-"))
            atexit.register(shutil.rmtree, _LOCAL[0][7:], True)
        base = _LOCAL[0]
    elif ":" not in base:
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/skein-core-{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table that was written to the shared folder and is read from there, and its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


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
