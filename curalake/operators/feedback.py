"""Feedback validity, recall of the latest label and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake.functions.text import strip
from curalake import schemas as S


def feedback_rules(class_names: Sequence[str]) -> dict[str, Column]:
    """Rule name -> expression that is true when the rule is broken."""
    names = list(class_names)
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) < 1
    confidence, correct = F.col("confidence"), F.col("is_correct")
    corrected, digest = F.col("corrected_class"), F.col("image_sha256")
    return {
        "empty_prediction_id": empty("prediction_id"),
        "empty_image_filename": empty("image_filename"),
        "image_sha256_format": digest.isNotNull() & ~digest.rlike(r"\A[0-9a-f]{64}\z"),
        "confidence_range": ~F.coalesce(confidence.between(0.0, 1.0) & ~F.isnan(confidence), F.lit(False)),
        "is_correct_missing": correct.isNull(),
        "correction_required": (correct == F.lit(False)) & corrected.isNull(),
        "correction_forbidden": (correct == F.lit(True)) & corrected.isNotNull(),
        "comment_too_long": F.length("comment") > 500,
        "predicted_class_unknown": ~F.coalesce(F.col("predicted_class").isin([*names, S.UNKNOWN_CLASS]), F.lit(False)),
        "corrected_class_unknown": corrected.isNotNull() & ~corrected.isin(names),
    }


def with_feedback_errors(df: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Adds ``errors``, the names of the broken rules."""
    checks = [F.when(F.coalesce(broken, F.lit(False)), F.lit(rule)) for rule, broken in feedback_rules(class_names).items()]
    return df.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def feedback_valid(df: DataFrame, class_names: Sequence[str]) -> DataFrame:
    return with_feedback_errors(df, class_names).filter(F.size("errors") == 0).drop("errors")


def feedback_rejected(df: DataFrame, class_names: Sequence[str]) -> DataFrame:
    return with_feedback_errors(df, class_names).filter(F.size("errors") > 0)


def feedback_upgrade(df: DataFrame, columns: Sequence[str] = tuple(S.FEEDBACK_COLUMNS)) -> DataFrame:
    """Legacy logs get the missing columns as empty text; the column order is fixed."""
    return df.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns
    ])


def human_label(class_names: Sequence[str]) -> Column:
    """The label a feedback row confirms or corrects, null when it names no configured class."""
    correct = F.lower(strip(F.coalesce(F.col("is_correct").cast("string"), F.lit("")))) == "true"
    label = F.when(correct, F.col("predicted_class")).otherwise(F.col("corrected_class"))
    return F.when(label.isin(list(class_names)), label)


def latest_feedback(df: DataFrame, class_names: Sequence[str], order: Sequence[str] = ("timestamp", "seq")) -> DataFrame:
    """Latest valid label per exact image; invalid rows are skipped, they do not reset it.

    ``max_by`` combines on the map side, so a hot image is one row per task.
    """
    labelled = df.select("image_sha256", human_label(class_names).alias("label"), *order).filter(
        "label IS NOT NULL AND image_sha256 IS NOT NULL AND image_sha256 <> ''"
    )
    return labelled.groupBy("image_sha256").agg(F.max_by("label", F.struct(*order)).alias("feedback_class"))


def feedback_fingerprint(feedback: DataFrame, predictions: DataFrame, order: Sequence[str] = ("timestamp", "seq")) -> DataFrame:
    """The first feedback of a prediction takes the recorded image hash, later ones their own.

    The first row is found by a combined minimum, not by ranking all feedback of an id.
    """
    recorded = predictions.groupBy("prediction_id").agg(F.min("image_sha256").alias("_recorded"))
    first = feedback.groupBy("prediction_id").agg(F.min(F.struct(*order)).alias("_first"))
    joined = feedback.join(first, "prediction_id", "left").join(recorded, "prediction_id", "left")
    own = F.coalesce("image_sha256", F.lit(""))
    taken = F.when(F.struct(*order) == F.col("_first"), F.coalesce("_recorded", own)).otherwise(own)
    return joined.withColumn("image_sha256", taken).drop("_first", "_recorded")


def correction_rates(df: DataFrame) -> DataFrame:
    """Per day: feedback rows, corrections and their share."""
    return df.groupBy(F.date_trunc("day", "timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("feedback_count"), F.count_if(~F.col("is_correct")).alias("correction_count"),
        F.avg((~F.col("is_correct")).cast("double")).alias("correction_rate"),
    )
