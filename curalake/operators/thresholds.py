"""Manual-review thresholds: analysis, sweep and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.session import config_table


def _candidates(thresholds: Sequence[float]) -> list[float]:
    values = sorted(set(map(float, thresholds)))
    if not values or values[0] < 0.0 or values[-1] > 1.0:
        raise ValueError("thresholds must be within [0, 1]")
    return values


def threshold_sweep(
    df: DataFrame, class_names: Sequence[str], thresholds: Sequence[float] = tuple(S.DEFAULT_THRESHOLDS),
) -> DataFrame:
    """Coverage, errors and rejections at every candidate threshold.

    A row lies between two neighbouring candidates, so the table is reduced once to
    counts per (slot, class, correct); every threshold is a suffix sum over those few
    counts. The work does not grow with the number of thresholds.
    """
    values = _candidates(thresholds)
    spark = df.sparkSession
    slot = F.lit(0)
    for i, t in enumerate(values):
        slot = F.when(F.col("confidence") >= t, F.lit(i + 1)).otherwise(slot)
    correct = F.col("true_idx") == F.col("pred_idx")
    cells = df.groupBy(slot.cast("bigint").alias("slot"), F.col("true_idx").cast("bigint").alias("true_idx"), correct.alias("correct")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("total")
    )
    steps = config_table(spark, [(i + 1, t) for i, t in enumerate(values)], "step bigint, confidence_threshold double")
    # few x few rows: the cells are K * 2 * (thresholds + 1), whatever the input
    spread = cells.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(values))))).withColumn("step", F.col("step").cast("bigint"))
    accepted = F.col("slot") >= F.col("step")
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    picked = lambda c: F.coalesce(F.sum(F.when(c, n)), zero)
    rejected = [
        picked(~accepted & (F.col("true_idx") == i)).alias(f"rejected_{name}") for i, name in enumerate(class_names)
    ]
    sums = spread.groupBy("step").agg(
        F.sum("n").alias("sample_count"), picked(accepted).alias("accepted_count"), picked(~accepted).alias("rejected_count"),
        picked(accepted & ~F.col("correct")).alias("accepted_error_count"), picked(F.col("correct")).alias("right"),
        F.sum(F.when(F.col("correct"), F.col("total"))).alias("right_total"),
        F.sum(F.when(~F.col("correct"), F.col("total"))).alias("wrong_total"), *rejected,
    )
    return steps.join(sums, "step").select(
        "confidence_threshold", "sample_count", "accepted_count", "rejected_count", "accepted_error_count",
        (F.col("accepted_count") / F.col("sample_count")).alias("coverage"),
        (F.col("rejected_count") / F.col("sample_count")).alias("manual_review_rate"),
        _or_null(F.col("accepted_count") - F.col("accepted_error_count"), F.col("accepted_count")).alias("accepted_accuracy"),
        F.map_from_arrays(
            F.array(*map(F.lit, class_names)), F.array(*[F.col(f"rejected_{c}") for c in class_names])
        ).alias("rejected_by_true_class"),
        _or_null(F.col("right_total"), F.col("right")).alias("mean_confidence_correct"),
        _or_null(F.col("wrong_total"), F.col("sample_count") - F.col("right")).alias("mean_confidence_incorrect"),
    )


def _or_null(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def threshold_analysis(df: DataFrame, class_names: Sequence[str], threshold: float) -> DataFrame:
    """The sweep at a single threshold."""
    return threshold_sweep(df, class_names, [threshold])


def select_threshold(
    df: DataFrame, class_names: Sequence[str], minimum_coverage: float = 0.65,
    thresholds: Sequence[float] = tuple(S.DEFAULT_THRESHOLDS),
) -> DataFrame:
    """Best candidate: enough coverage if any has it, then accepted accuracy, coverage, lower threshold."""
    if not 0.0 < minimum_coverage <= 1.0:
        raise ValueError("minimum_coverage must be in (0, 1]")
    sweep = threshold_sweep(df, class_names, thresholds).withColumn("eligible", F.col("coverage") >= minimum_coverage)
    order = W.partitionBy().orderBy(  # one row per candidate threshold
        F.desc("eligible"), F.desc(F.coalesce("accepted_accuracy", F.lit(-1.0))), F.desc("coverage"), F.asc("confidence_threshold")
    )
    return sweep.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank", "eligible")
