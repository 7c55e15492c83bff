"""Admission, knowledge look-up and the enriched prediction response."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.functions.text import basename, strip
from curalake.operators.violations import first_broken

UNKNOWN_MESSAGE = "Manual review is required."
#: Keys over which the rows under review are spread in the join with the knowledge table.
REVIEW_KEYS = 1_024


def extension_matches(filename: Column, content_type: Column, media: Mapping[str, Sequence[str]] = S.MEDIA_EXTENSIONS) -> Column:
    """Does the lower-cased file extension belong to the content type?

    A name that is only a dot and letters (``.png``) is a hidden file without extension.
    """
    visible = F.regexp_replace(basename(filename), r"\A\.+", "")
    suffix = F.lower(F.regexp_extract(visible, r"(\.[^.]+)\z", 1))
    kind = F.lower(strip(content_type))
    result = F.lit(False)
    for name, extensions in media.items():
        result = F.when(kind == name, suffix.isin(list(extensions))).otherwise(result)
    return F.coalesce(result, F.lit(False))


def upload_admitted(maximum_bytes: int = S.MAXIMUM_UPLOAD_BYTES) -> Column:
    """File name present, type and extension agree, size in (0, maximum]."""
    name = basename(F.coalesce("filename", F.lit("")))
    return (
        (name != "") & (F.coalesce("size_bytes", F.lit(0)) > 0) & (F.col("size_bytes") <= maximum_bytes)
        & extension_matches(name, F.col("content_type"))
    )


def upload_status(maximum_bytes: int = S.MAXIMUM_UPLOAD_BYTES) -> Column:
    """HTTP-style status; the first failing rule decides. The type check does not trim."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    return first_broken({
        "503": ~F.coalesce("model_available", F.lit(False)),
        "415": ~kind.isin(list(S.MEDIA_EXTENSIONS)),
        "413": F.col("size_bytes") > maximum_bytes,
        "400": ~upload_admitted(maximum_bytes) | ~F.coalesce("decodable", F.lit(False)),
    }, "200").cast("int")


def model_prediction(threshold: float, class_names: Sequence[str]) -> dict[str, Column]:
    """Most likely class, the class after the threshold, and the review flag."""
    likely = F.get(F.array(*map(F.lit, class_names)), F.col("pred_idx").cast("int"))
    review = F.col("confidence") < threshold
    return {
        "most_likely_class": likely, "model_class": F.when(review, S.UNKNOWN_CLASS).otherwise(likely), "model_review": review,
    }


def feedback_override(
    predictions: DataFrame, latest: DataFrame, threshold: float, class_names: Sequence[str], unknown_message: str = UNKNOWN_MESSAGE
) -> DataFrame:
    """Predictions with the latest human label of the same exact image.

    A label equal to the model's class confirms it and is not a correction; a
    correction lifts the manual review. ``unknown_message`` comes from the catalog's configuration.
    """
    joined = predictions.withColumns(model_prediction(threshold, class_names)).join(latest, "image_sha256", "left")
    applied = F.coalesce(F.col("feedback_class") != F.col("model_class"), F.lit(False))
    review = F.col("model_review") & ~applied
    message = (
        F.when(applied, F.concat(F.lit("Saved human correction applied; the model's own result was '"), F.col("most_likely_class"), F.lit("'.")))
        .when(F.col("model_review"), unknown_message)
        .otherwise(F.concat(F.lit("Predicted class: "), F.col("most_likely_class")))
    )
    return joined.withColumns({
        "predicted_class": F.coalesce("feedback_class", "model_class"), "feedback_applied": applied,
        "requires_manual_review": review, "message": message,
    }).drop("model_class", "model_review", "feedback_class")


def knowledge_fallback(keys: DataFrame, primary: DataFrame, fallback: DataFrame, key: str = "class_name") -> DataFrame:
    """Primary record if there is one, else the fallback's, with its origin; null origin = in neither."""
    values = [c for c in primary.columns if c != key]
    first = primary.select(key, F.struct(*values).alias("_first"))
    second = fallback.select(key, F.struct(*values).alias("_second"))
    joined = keys.join(first, key, "left").join(second, key, "left")
    origin = F.when(F.col("_first").isNotNull(), S.GRAPH_SOURCE).when(F.col("_second").isNotNull(), S.FALLBACK_SOURCE)
    return joined.withColumns({"knowledge_source": origin, "_taken": F.coalesce("_first", "_second")}).select(
        *keys.columns, "_taken.*", "knowledge_source"
    )


def enriched_predictions(overridden: DataFrame, knowledge: DataFrame) -> DataFrame:
    """The response: what is known of the effective class, withheld while review is open.

    ``knowledge`` has one row per class: ``class_name, display_name, step_count, part_count,
    inventory_last_updated, knowledge_source``. A class that no source knows gives status 500. The date is the
    inventory's and stays under review. Steps and parts are tables keyed by ``predicted_class``, which is no
    class of theirs while review is open.
    """
    review = F.col("requires_manual_review")
    # review rows ask for no class: numbered keys that nothing has keep them from meeting in one task
    place = F.when(review, F.pmod(F.xxhash64("image_sha256", "confidence"), F.lit(REVIEW_KEYS)) + 1).otherwise(F.lit(0).cast("bigint"))
    asked = overridden.withColumns({"class_name": F.col("predicted_class"), "_place": place})
    known = F.col("display_name").isNotNull()
    date = knowledge.agg(F.max("inventory_last_updated")).scalar()
    return asked.join(knowledge.withColumn("_place", F.lit(0).cast("bigint")), ["class_name", "_place"], "left").select(
        *[F.col(c) for c in overridden.columns],
        F.when(review | known, 200).otherwise(500).alias("status"),
        F.coalesce("display_name", F.when(review, S.UNKNOWN_DISPLAY_NAME)).alias("display_name"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("step_count", "part_count")],
        F.coalesce("inventory_last_updated", F.when(review, date)).alias("inventory_last_updated"),
        F.coalesce("knowledge_source", F.when(review, S.FALLBACK_SOURCE)).alias("knowledge_source"),
    )


def table_health(freshness: DataFrame) -> DataFrame:
    """``dependency, up`` rows -> one row: healthy only if everything is up, and the knowledge source in use."""
    graph_up = F.coalesce(F.bool_or(F.when(F.col("dependency") == "graph", F.col("up"))), F.lit(False))
    return freshness.agg(
        F.when(F.bool_and("up"), "healthy").otherwise("degraded").alias("status"),
        F.count_if(~F.col("up")).alias("down_count"),
        F.when(graph_up, S.GRAPH_SOURCE).otherwise(S.FALLBACK_SOURCE).alias("knowledge_source"),
    )
