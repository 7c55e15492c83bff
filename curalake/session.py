"""Session helpers: shared scratch folder, driver-resident configuration tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Configuration lists live in the driver's memory before they become a table,
# so broadcasting them is safe; this is the size that is enforced.
MAX_CONFIG_ROWS = 10_000


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside, and the former ones afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session may go without one; it gets a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="curalake-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A plain ``withColumn`` is substituted into every later expression and pushed
    filter that mentions it; for nested array expressions that multiplies the work.
    The output of a generator is never substituted.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bounded_batches(spark: SparkSession, rows: int = 1_000, size: str = "2m") -> None:
    """Bound what one Arrow batch holds, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row work on an input with few file splits; no shuffle otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so reruns see the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    For loops: a checkpoint keeps the constraints of the plan it came from, and from round to round they multiply.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def config_table(spark: SparkSession, rows: Sequence[Sequence[object]], ddl: str) -> DataFrame:
    """A small broadcast table from a Python list, typed by a DDL string."""
    if not 0 < len(rows) <= MAX_CONFIG_ROWS:
        raise ValueError(f"configuration tables hold 1..{MAX_CONFIG_ROWS} rows, got {len(rows)}")
    names_types = [field.strip().split(None, 1) for field in ddl.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, names_types, strict=True)])
        for row in rows
    ]
    return F.broadcast(spark.sql("SELECT 1 AS one").select(F.inline(F.array(*structs))))


def class_table(spark: SparkSession, class_names: Sequence[str]) -> DataFrame:
    """``(idx, class_name)`` in configured order; the order is data."""
    names = [str(n).strip() for n in class_names]
    if len(names) < 2 or len(set(names)) != len(names) or "" in names:
        raise ValueError("class names must be at least two unique, non-blank values")
    return config_table(spark, list(enumerate(names)), "idx bigint, class_name string")
