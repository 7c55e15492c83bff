"""Training histories: best epoch and early stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def history_epochs(reports: DataFrame, run: str = "run_id") -> DataFrame:
    """History documents (``schemas.HISTORY_DDL``) -> one row per epoch, training next to validation."""
    zipped = F.arrays_zip(F.col("training_metrics").alias("t"), F.col("validation_metrics").alias("v"))
    rows = reports.select(run, F.posexplode(zipped).alias("position", "m"))
    return rows.select(
        run, (F.col("position") + 1).cast("bigint").alias("epoch"), F.col("m")["v"]["stage"].alias("stage"),
        F.col("m")["v"]["loss"].alias("loss"), F.col("m")["t"]["loss"].alias("training_loss"),
        F.col("m")["v"]["learning_rate"].alias("learning_rate"),
    )


def best_epoch(epochs: DataFrame, run: str = "run_id") -> DataFrame:
    """First epoch with the smallest validation loss."""
    return epochs.groupBy(run).agg(
        F.min(F.struct("loss", "epoch")).alias("_best"), F.count(F.lit(1)).alias("epochs_completed")
    ).select(run, F.col("_best.epoch").alias("best_epoch"), F.col("_best.loss").alias("best_validation_loss"), "epochs_completed")


def _carried(rows: DataFrame, keys: Sequence[str], chunk: str, value: str, how, name: str) -> DataFrame:
    """Per chunk: ``how`` of ``value`` over all earlier chunks of the same keys."""
    per_chunk = rows.groupBy(*keys, chunk).agg(how(value).alias("_c"))
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    return per_chunk.select(*keys, chunk, how("_c").over(before).alias(name))


def early_stop_trace(epochs: DataFrame, patience: int, run: str = "run_id", chunk_size: int = 10_000) -> DataFrame:
    """Per epoch: was the global best improved, epochs since, and would training stop here?

    An improvement is a strictly smaller loss than everything before; the counter
    restarts with every stage. Running values are carried over chunks of epochs, so
    no task needs a whole run. ``epoch`` counts 1, 2, 3, .. within a run.
    """
    if patience <= 0:
        raise ValueError("patience must be positive")
    rows = epochs.withColumn("_chunk", F.floor((F.col("epoch") - 1) / F.lit(chunk_size)))
    earlier = _carried(rows, [run], "_chunk", "loss", F.min, "_best_before")
    inside = W.partitionBy(run, "_chunk").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    best = F.least("_best_before", F.min("loss").over(inside))
    marked = rows.join(earlier, [run, "_chunk"]).withColumn("best_before", best).withColumn(
        "improved", F.coalesce(F.col("loss") < F.col("best_before"), F.lit(True))
    ).withColumn("_hit", F.when(F.col("improved"), F.col("epoch")))
    starts = rows.groupBy(run, "stage").agg((F.min("epoch") - 1).alias("_start"))
    hits = _carried(marked, [run, "stage"], "_chunk", "_hit", F.max, "_hit_before")
    upto = W.partitionBy(run, "stage", "_chunk").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    last = F.greatest("_start", "_hit_before", F.max("_hit").over(upto))
    since = (F.col("epoch") - last).cast("bigint")
    return marked.join(starts, [run, "stage"]).join(hits, [run, "stage", "_chunk"]).select(
        run, "epoch", "stage", "loss", "improved", since.alias("epochs_without_improvement"), (since >= patience).alias("stop")
    )
