"""Manifest rules, unions, counts and class coverage."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.functions.hashing import is_hex
from curalake.functions.text import basename, folded, is_blank, parent_directory, safe_name, strip
from curalake.operators.violations import GateError, missing_columns, row_violations
from curalake.session import class_table, config_table


def missing_columns_error(df: DataFrame, required: Sequence[str]) -> None:
    """Schema check before a job: raises with the missing column names."""
    missing = missing_columns(df, list(required))
    if missing:
        raise GateError(f"missing columns: {missing}")


def union_splits(frames: Mapping[str, DataFrame], tag: str = "audit_split") -> DataFrame:
    """Concatenate split tables, each tagged with its name."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def normalize_required(df: DataFrame, columns: Sequence[str] = tuple(S.REQUIRED_COLUMNS)) -> DataFrame:
    """Required columns as trimmed text, null as empty."""
    return df.withColumns({c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns})


def duplicate_keys(df: DataFrame, columns: Sequence[str], ignore_blank: bool = True) -> DataFrame:
    """``(key_column, key_value, row_count)`` of every value that occurs more than once.

    One unpivot and one partially aggregated shuffle for all key columns.
    """
    keys = F.array(*[
        F.struct(F.lit(c).alias("key_column"), strip(F.col(c).cast("string")).alias("key_value")) for c in columns
    ])
    pairs = df.select(F.inline(keys)).filter(F.col("key_value").isNotNull())
    if ignore_blank:
        pairs = pairs.filter(F.col("key_value") != "")
    return (
        pairs.groupBy("key_column", "key_value").agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")
    )


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """Rules a source manifest must meet before it is split."""
    missing = missing_columns(manifest, S.REQUIRED_COLUMNS)
    if missing:
        return config_table(
            manifest.sparkSession, [("missing_column", c) for c in missing], "rule string, subject string"
        )
    rows = normalize_required(manifest)
    rules: dict[str, Column] = {f"blank_{c}": F.col(c) == "" for c in S.REQUIRED_COLUMNS}
    rules["checksum_format"] = ~is_hex(F.col("checksum"), 64)
    if "dataset_split" in manifest.columns:
        rules["assigned_split"] = ~is_blank(F.col("dataset_split"))
    keys = [c for c in ("file_path", "image_id", "checksum", "source_group") if c in manifest.columns]
    repeated = duplicate_keys(rows, keys).select(
        F.concat(F.lit("duplicate_"), F.col("key_column")).alias("rule"), F.col("key_value").alias("subject")
    )
    return row_violations(rows, F.col("image_id"), rules).unionByName(repeated)


def traceability_rules() -> dict[str, Column]:
    rules = {f"blank_{c}": is_blank(F.col(c)) for c in S.TRACEABILITY_COLUMNS}
    rules["checksum_format"] = ~is_hex(F.col("checksum"), 64)
    rules["perceptual_hash_format"] = ~is_hex(F.col("perceptual_hash"), 16)
    return rules


def traceability_violations(manifest: DataFrame) -> DataFrame:
    """``(rule, violation_count)`` of the traceable-manifest rules."""
    missing = missing_columns(manifest, S.TRACEABILITY_COLUMNS)
    if missing:
        return config_table(
            manifest.sparkSession, [(f"missing_column_{c}", 1) for c in missing], "rule string, violation_count bigint"
        )
    found = row_violations(manifest, F.col("image_id"), traceability_rules())
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violation_count"))


def accepted_records(records: DataFrame) -> DataFrame:
    return records.filter(folded(F.col("review_status")) == "accepted")


def accepted_violations(records: DataFrame, class_names: Sequence[str] = tuple(S.CLASS_NAMES)) -> DataFrame:
    """Accepted rows: known classes, all classes covered, no blanks, one row per source group."""
    accepted = accepted_records(records)
    rules: dict[str, Column] = {
        f"blank_{c}": is_blank(F.col(c)) for c in S.RECORD_COLUMNS if c != "review_notes" and c in records.columns
    }
    rules["unsupported_class"] = ~F.col("class_name").isin(list(class_names))
    uncovered = (
        class_table(records.sparkSession, class_names)
        .join(accepted.select("class_name").distinct(), "class_name", "left_anti")
        .select(F.lit("uncovered_class").alias("rule"), F.col("class_name").alias("subject"))
    )
    repeated = duplicate_keys(accepted, ["source_group"]).select(
        F.lit("duplicate_source_group").alias("rule"), F.col("key_value").alias("subject")
    )
    return row_violations(accepted, F.col("file_path"), rules).unionByName(uncovered).unionByName(repeated)


def class_set_difference(df: DataFrame, class_names: Sequence[str], column: str = "class_name") -> DataFrame:
    """Classes on one side only: ``missing`` from the data or ``unexpected`` in it."""
    observed = df.select(strip(F.col(column)).alias("class_name")).filter("class_name IS NOT NULL").distinct()
    expected = class_table(df.sparkSession, class_names).select("class_name")
    missing = expected.join(observed, "class_name", "left_anti").withColumn("side", F.lit("missing"))
    extra = observed.join(expected, "class_name", "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra)


def class_coverage(df: DataFrame, class_names: Sequence[str], column: str = "class_name") -> DataFrame:
    """Full outer comparison of configured and observed classes with counts."""
    expected = class_table(df.sparkSession, class_names).select("class_name", F.lit(True).alias("expected"))
    observed = (
        df.select(strip(F.col(column)).alias("class_name")).filter("class_name IS NOT NULL")
        .groupBy("class_name").agg(F.count(F.lit(1)).alias("record_count"))
    )
    return observed.join(expected, "class_name", "full").select(
        "class_name",
        F.coalesce("expected", F.lit(False)).alias("expected"),
        F.col("record_count").isNotNull().alias("observed"),
        F.coalesce("record_count", F.lit(0)).alias("record_count"),
    )


def folder_class_coverage(df: DataFrame, class_names: Sequence[str], path: str = "file_path") -> DataFrame:
    """The label of a file is its parent directory."""
    return class_coverage(df.select(parent_directory(F.col(path)).alias("class_name")), class_names)


def wrong_split_values(df: DataFrame, expected: str, actual: str = "dataset_split") -> DataFrame:
    """Rows whose recorded split differs from the table they were found in."""
    return df.filter(~F.col(actual).eqNullSafe(F.col(expected)))


def class_counts(df: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Count per configured class, zeros included."""
    counts = df.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    return (
        class_table(df.sparkSession, class_names).join(counts, "class_name", "left")
        .select("idx", "class_name", F.coalesce("n", F.lit(0)).alias("record_count"))
    )


def valid_ratios(ratios: Sequence[float]) -> bool:
    """Positive, finite and summing to one."""
    usable = all(isinstance(r, (int, float)) and math.isfinite(r) and r > 0 for r in ratios)
    return usable and math.isclose(sum(ratios), 1.0, rel_tol=0.0, abs_tol=1e-9)


def split_compatibility(df: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """Per class: is the count at least 10 and is every share a whole number?"""
    if not valid_ratios(ratios):
        raise ValueError("split ratios must be positive and sum to 1.0")
    n = F.col("record_count")
    whole = reduce(
        lambda a, b: a & b, [F.abs(n * F.lit(r) - F.round(n * F.lit(r))) <= 1e-9 for r in map(float, ratios)]
    )
    return df.groupBy("class_name").agg(F.count(F.lit(1)).alias("record_count")).select(
        "class_name", "record_count", (n >= 10).alias("large_enough"), whole.alias("divisible"),
        ((n >= 10) & whole).alias("compatible"),
    )


def strict_split_counts(df: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Measured and expected counts for every class and split; a class absent from a split fails."""
    spark = df.sparkSession
    shares = config_table(spark, [("train", 0.8), ("validation", 0.1), ("test", 0.1)], "dataset_split string, share double")
    grid = class_table(spark, class_names).select("class_name", F.explode(F.array(*map(F.lit, S.SPLITS))).alias("dataset_split"))
    counts = df.groupBy("class_name", "dataset_split").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("class_name").agg(F.sum("n").alias("total"))
    joined = (
        grid.join(shares, "dataset_split").join(counts, ["class_name", "dataset_split"], "left")
        .join(totals, "class_name", "left")
    )
    measured = F.coalesce(F.col("n"), F.lit(0))
    expected = (F.coalesce(F.col("total"), F.lit(0)) * F.col("share")).cast("bigint")
    return joined.select(
        "class_name", "dataset_split", measured.alias("record_count"), expected.alias("expected_count"),
        ((measured == expected) & F.col("n").isNotNull()).alias("ok"),
    )


def class_split_crosstab(df: DataFrame, class_names: Sequence[str] | None = None, split: str = "dataset_split") -> DataFrame:
    """Rows per class and split with zeros; with ``class_names`` every configured class has a row."""
    counts = df.groupBy("class_name").pivot(split, S.SPLITS).agg(F.count(F.lit(1)))
    if class_names is not None:
        counts = class_table(df.sparkSession, class_names).select("class_name").join(counts, "class_name", "full")
    return counts.na.fill(0, S.SPLITS)


def source_label_counts(df: DataFrame, label: str = "source_object_label") -> DataFrame:
    return df.groupBy("class_name", label).agg(F.count(F.lit(1)).alias("record_count"))


def normal_certification(df: DataFrame, label: str = "source_object_label", normal: str = "normal") -> DataFrame:
    """How many undamaged rows carry an explicit no-damage label; without the column, none does."""
    is_normal = F.col("class_name") == normal
    named = F.lower(F.coalesce(F.col(label).cast("string"), F.lit(""))).isin(S.NO_DAMAGE_LABELS) if label in df.columns else F.lit(False)
    return df.agg(
        F.count_if(is_normal & named).alias("certified"), F.count_if(is_normal & ~named).alias("uncertified")
    )


def with_destination(df: DataFrame) -> DataFrame:
    """``split/class/safe-name`` of every row."""
    return df.withColumn(
        "destination",
        F.concat_ws("/", "dataset_split", "class_name", safe_name(F.col("image_id"), F.col("file_path"))),
    )


def content_mismatches(manifest: DataFrame, content: DataFrame, key: str = "file_path") -> DataFrame:
    """Manifest rows whose bytes are missing, undecodable or different from what was recorded.

    ``content`` has ``key, actual_checksum`` and optionally ``decodable`` and ``actual_hash``.
    """
    extra = {}
    if "decodable" not in content.columns:
        extra["decodable"] = F.lit(True)
    if "actual_hash" not in content.columns:
        extra["actual_hash"] = F.lit(None).cast("string")
    facts = content.withColumns({**extra, "found": F.lit(True)}).select(key, "actual_checksum", "decodable", "actual_hash", "found")
    recorded_sum = folded(F.col("checksum"))
    recorded_hash = folded(F.col("perceptual_hash")) if "perceptual_hash" in manifest.columns else F.lit("")
    error = (
        F.when(F.col("found").isNull(), "missing")
        .when(~F.col("decodable"), "undecodable")
        .when((recorded_sum != "") & (recorded_sum != F.lower("actual_checksum")), "checksum_mismatch")
        .when((recorded_hash != "") & F.col("actual_hash").isNotNull() & (recorded_hash != F.lower("actual_hash")), "hash_mismatch")
    )
    return (
        manifest.join(facts, key, "left").select("image_id", key, error.alias("error")).filter("error IS NOT NULL")
    )


def heldout_manifest_violations(manifest: DataFrame, per_class: int = 10, class_names: Sequence[str] = tuple(S.CLASS_NAMES)) -> DataFrame:
    """Held-out rules: exact classes, a fixed number per class, both freeze flags set."""
    rows = row_violations(manifest, F.col("filename"), {
        "not_excluded": folded(F.col("excluded_from_training_validation")) != "yes",
        "not_frozen_before_inference": folded(F.col("selected_before_inference")) != "yes",
    })
    counted = class_coverage(manifest, class_names, "expected_class")
    per = counted.select(
        F.when(~F.col("expected"), "unexpected_class").when(F.col("record_count") != per_class, "class_count").alias("rule"),
        F.col("class_name").alias("subject"),
    ).filter("rule IS NOT NULL")
    return rows.unionByName(per)


def acquisition_yield(new_rows: DataFrame, requested: int) -> DataFrame:
    """Is the number of new rows at least ``max(10, int(0.8 * requested))``?"""
    needed = max(10, int(requested * 0.8))
    return new_rows.agg(F.count(F.lit(1)).alias("new_rows")).select(
        "new_rows", F.lit(needed).cast("bigint").alias("needed_rows"), (F.col("new_rows") >= needed).alias("ok")
    )
