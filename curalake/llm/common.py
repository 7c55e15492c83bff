"""Helpers of the operators in this folder: written tables, free names, small-table joins, batch sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.session import bounded_batches as bounded_batches
from curalake.session import scratch_path
from curalake.session import settings as settings

#: A table of at most this many rows (a few numbers each) is broadcast; a larger one is joined by salted shuffle.
BROADCAST_ROWS = 50_000
SALTS = 64


#: Spark's own Bloom filter of the join keys drops rows of the large side before they are shuffled. By default it is for
#: scans of over 10 GB and small key tables. Its 2 MB serve some 2 million keys; with more it fades and all rows are shuffled.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g", "spark.sql.optimizer.runtime.bloomFilter.numBits": str(1 << 24),
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "2000000",
}


def rows_of(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys`` (bigint), to be run within ``settings(spark, BLOOM)``. The comparison is true
    of every key; Spark considers a Bloom filter for selective key tables only."""
    return df.join(keys.select(column).filter(F.col(column) >= -(1 << 63)), column, "left_semi")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def null_key(column: Column) -> Column:
    """A string that keeps null apart from every value, for plain equi-joins."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], salt: Column, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join with a table that has one row per key.

    Its rows are counted first: up to ``limit`` it is broadcast, so that hot keys cost no shuffle.
    Beyond that every table row is repeated once per salt and both sides meet by (key, salt), which
    cuts a hot key into ``SALTS`` parts. The result is the same.
    """
    if table.count() <= limit:
        return df.join(F.broadcast(table), list(keys))
    name = free_name(df, "_salt")
    spread = table.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn(name, F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(spread, [*keys, name]).drop(name)

