"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage reads what the one before wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.llm import linedup, mixing, packing, quality, shingles
from curalake.llm.common import free_name, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the fences of their language and source."""
    return quality.quality_filter(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; a document all of whose lines were copies goes too. ``n_chars`` follows the text."""
    removed, total = free_name(docs, "n_removed"), free_name(docs, "n_lines")
    cut = linedup.drop_repeated_runs(docs, removed=removed, total=total).filter(F.expr(f"`{removed}` = 0 OR `{removed}` < `{total}`"))
    length = F.when(F.col(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of similar ones."""
    return shingles.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources, in a global random order."""
    copy, key = free_name(docs, "copy_no"), free_name(docs, "shuffle_key")
    return mixing.mix(docs, copy=copy, key=key).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; every copy of a document is packed."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("lines", drop_repeated_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: Suffix arrays, components and token ids are beyond plain SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
