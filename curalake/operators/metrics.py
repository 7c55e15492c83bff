"""Classification metrics from ``(true_idx, pred_idx, confidence)`` tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.operators.quantiles import exact_median
from curalake.operators.violations import gate
from curalake.operators.violations import row_violations
from curalake.session import class_table, config_table


def prediction_violations(df: DataFrame, class_names: Sequence[str], subject: str = "sample_index") -> DataFrame:
    """Labels outside the class range and confidences outside [0, 1]."""
    last = len(class_names) - 1
    outside = lambda c: ~F.coalesce(F.col(c).between(0, last), F.lit(False))
    bounded = F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence")
    return row_violations(df, F.col(subject), {
        "true_label_range": outside("true_idx"), "predicted_label_range": outside("pred_idx"),
        "confidence_range": ~F.coalesce(bounded, F.lit(False)),
    })


def prediction_records(df: DataFrame, class_names: Sequence[str], threshold: float) -> DataFrame:
    """Named prediction rows with review and correctness flags; below the threshold needs review."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    names = F.array(*map(F.lit, class_names))
    return df.withColumns({
        "true_class": F.get(names, F.col("true_idx").cast("int")),
        "predicted_class": F.get(names, F.col("pred_idx").cast("int")),
        "requires_manual_review": F.col("confidence") < threshold,
        "is_correct": F.col("true_idx") == F.col("pred_idx"),
    })


def misclassified(predictions: DataFrame) -> DataFrame:
    return predictions.filter(~F.col("is_correct"))


def confusion_matrix(df: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """``(true_idx, pred_idx, true_class, predicted_class, n)`` for all K x K cells, zeros included.

    A label that is null or outside the classes fails the query.
    """
    classes = class_table(df.sparkSession, class_names)
    last = F.lit(len(class_names) - 1)
    cells = classes.select(
        F.col("idx").alias("true_idx"), F.col("class_name").alias("true_class"),
        F.explode(F.sequence(F.lit(0), last).cast("array<bigint>")).alias("pred_idx"),
    ).withColumn("predicted_class", F.get(F.array(*map(F.lit, class_names)), F.col("pred_idx").cast("int")))
    known = lambda c: F.when(F.col(c).between(0, len(class_names) - 1), F.col(c).cast("bigint")).otherwise(
        F.raise_error(F.lit(f"{c} outside the classes")).cast("bigint")).alias(c)
    counts = df.groupBy(known("true_idx"), known("pred_idx")).agg(F.count(F.lit(1)).alias("c"))
    return cells.join(counts, ["true_idx", "pred_idx"], "left").select(
        "true_idx", "pred_idx", "true_class", "predicted_class", F.coalesce("c", F.lit(0)).alias("n")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def per_class_metrics(df: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support in configured order; undefined ratios are 0.

    The predictions shuffle once, to K x K counts; everything after is tiny.
    """
    cells = confusion_matrix(df, class_names)
    both = cells.select(F.inline(F.array(
        F.struct(F.col("true_idx").alias("idx"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("true_idx") == F.col("pred_idx"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("pred_idx").alias("idx"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )))
    sums = both.groupBy("idx").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    names = F.array(*map(F.lit, class_names))
    return sums.select(
        "idx", F.get(names, F.col("idx").cast("int")).alias("class_name"), precision.alias("precision"), recall.alias("recall"),
        _ratio(2.0 * precision * recall, precision + recall).alias("f1_score"), "support",
    )


def overall_accuracy(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg((F.col("true_idx") == F.col("pred_idx")).cast("double")).alias("accuracy")
    )


def macro_weighted_f1(df: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Macro F1 over all configured classes and F1 weighted by support."""
    return per_class_metrics(df, class_names).agg(
        F.avg("f1_score").alias("macro_f1"), (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("weighted_f1")
    )


GROUPS = ["overall", "correct", "incorrect"]


def confidence_summary(df: DataFrame) -> DataFrame:
    """Count, mean, min, median, max over all, correct and incorrect rows; empty groups have nulls."""
    correct = F.col("true_idx") == F.col("pred_idx")
    tagged = df.select("confidence", F.explode(F.array(F.lit("overall"), F.when(correct, F.lit("correct")).otherwise("incorrect"))).alias("group_name"))
    basic = tagged.groupBy("group_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("min"), F.max("confidence").alias("max")
    )
    medians = exact_median(tagged, ["group_name"], "confidence", few=True)
    groups = config_table(df.sparkSession, [(g,) for g in GROUPS], "group_name string")
    return groups.join(basic, "group_name", "left").join(medians, "group_name", "left").select(
        "group_name", F.coalesce("n", F.lit(0)).alias("n"), "mean", "min", "median", "max"
    )


def confidence_histogram(df: DataFrame, edges: Sequence[float] = tuple(S.HISTOGRAM_EDGES)) -> DataFrame:
    """Counts per bin, left-closed, the last bin closed on both sides; empty bins are kept."""
    bins = config_table(
        df.sparkSession, [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin bigint, low double, high double"
    )
    position = F.lit(None).cast("bigint")
    for i, low in enumerate(edges[:-1]):
        position = F.when(F.col("confidence") >= low, F.lit(i).cast("bigint")).otherwise(position)
    counts = df.filter(F.col("confidence") < edges[-1] + 1e-6).groupBy(position.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("c", F.lit(0)).alias("n"))


def heldout_summary(results: DataFrame) -> DataFrame:
    """Pass rate per expected class and overall (null class), from one rollup."""
    return results.rollup("expected_class").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg(F.col("pass").cast("double")).alias("accuracy")
    )


def version_comparison(before: DataFrame, after: DataFrame, key: str = "filename") -> DataFrame:
    """Accuracy of two result sets on the same items, the gain and the number of changed rows."""
    a = before.select(key, F.col("expected_class"), F.col("predicted_class").alias("old"))
    b = after.select(key, F.col("predicted_class").alias("new"))
    old_ok, new_ok = F.col("old") == F.col("expected_class"), F.col("new") == F.col("expected_class")
    return a.join(b, key).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg(old_ok.cast("double")).alias("old_accuracy"),
        F.avg(new_ok.cast("double")).alias("new_accuracy"),
        (F.avg(new_ok.cast("double")) - F.avg(old_ok.cast("double"))).alias("gain"),
        F.count_if(F.col("old") != F.col("new")).alias("changed"),
        F.count_if(~old_ok & new_ok).alias("fixed"), F.count_if(old_ok & ~new_ok).alias("broken"),
    )


def class_weights(df: DataFrame, class_names: Sequence[str], strict: bool = False) -> DataFrame:
    """``N / (K * n_c)`` per class; a class without rows has a null weight, or is an error with ``strict``."""
    counts = df.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    joined = class_table(df.sparkSession, class_names).join(counts, "class_name", "left")
    total = F.sum("n").over(W.partitionBy())  # K rows
    weights = joined.select(
        "idx", "class_name", F.coalesce("n", F.lit(0)).alias("record_count"),
        (total / (F.lit(len(class_names)) * F.col("n"))).alias("weight"),
    )
    if strict:
        gate(weights.filter("record_count = 0").select("class_name"), "classes without rows have no weight")
    return weights


def size_profile(df: DataFrame, side: str = "short_side", small: int = S.PREFERRED_SHORT_SIDE) -> DataFrame:
    """Count, min, exact median, max and small rows of the short side per class."""
    basic = df.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("record_count"), F.min(side).alias("short_side_min"), F.max(side).alias("short_side_max"),
        F.count_if(F.col(side) < small).alias("below_128_count"),
    )
    medians = exact_median(df, ["class_name"], side)
    return basic.join(medians.withColumnRenamed("median", "short_side_median"), "class_name")
