"""The corpus pipeline: documents to token ids, stage by stage.

What holds for all stages: an empty table gives an empty result, texts of any length are read whole, and columns beside
doc_id, text, lang and source pass through whatever their names, except in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, common, mixing, near_dedup, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the text rules, as strictly as their host's verdict asks, go.

    Null, empty and blank texts have no word and go. A null source is the host "". Rows of equal content stay or go together; null and repeated doc_ids don't matter.
    """
    return quality.drop_rejected(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id.

    Rows without doc_id, and texts without a word, stay. Of rows of equal doc_id and text one stays; different texts that share a doc_id are documents of their own.
    """
    return near_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mixture of domains, languages and sources takes them.

    A null language or source is "unknown". Rows of equal doc_id and leaf have equal keys and are taken together; texts without a word come with the prefix in which their key lies.
    """
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of each row. Null and empty texts have no tokens; rows with null or repeated doc_id have rows of their own."""
    return bpe.encode(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Neither sketches nor ranked merges can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = common.write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            common.remove(spark, last)
        last = path
    return docs
