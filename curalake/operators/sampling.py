"""Exact stratified splits and seeded samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.operators.manifest import class_counts, split_compatibility, valid_ratios
from curalake.operators.ranking import seeded_rank
from curalake.operators.violations import GateError, gate
from curalake.session import config_table


def stratified_split(
    df: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42, identity: str = "image_id",
    trim: bool = False, digits: int = 3,
) -> DataFrame:
    """Exact per-class 80/10/10 membership, the same for every run with one seed.

    Counts must be compatible (see ``split_compatibility``); ``trim`` instead
    leaves out the last ``count % 10`` rows of each class in seeded order.
    """
    if not valid_ratios(ratios):
        raise ValueError("split ratios must be positive and sum to 1.0")
    ranked = seeded_rank(df.drop("dataset_split"), "class_name", identity, seed, digits=digits, name="_rank")
    usable = F.col("group_total")
    if trim:
        usable = usable - usable % 10
        ranked = ranked.filter(F.col("_rank") <= usable)
    train = F.round(usable * F.lit(float(ratios[0]))).cast("bigint")
    validation = F.round(usable * F.lit(float(ratios[1]))).cast("bigint")
    split = (
        F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + validation, "validation").otherwise("test")
    )
    return ranked.withColumn("dataset_split", split).drop("_rank", "group_total")


def strict_split(df: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42, identity: str = "image_id") -> DataFrame:
    """``stratified_split`` behind its gate."""
    gate(split_compatibility(df, ratios).filter("NOT compatible"), "class counts are not compatible with the split ratios")
    return stratified_split(df, ratios, seed, identity)


def balanced_target(df: DataFrame, cap: int, class_names: Sequence[str], requested: int = 0) -> DataFrame:
    """One row: the common sample size, ``min(cap, smallest class)`` floored to a multiple of 10."""
    smallest = class_counts(df, class_names).agg(F.min("record_count").alias("smallest"))
    floor = F.least(F.lit(cap), F.col("smallest"))
    target = F.lit(requested) if requested > 0 else floor - floor % 10
    return smallest.select("smallest", target.cast("bigint").alias("target"))


def balanced_sample(
    df: DataFrame, cap: int, class_names: Sequence[str] = tuple(S.CLASS_NAMES), seed: int = 42,
    identity: str = "source_group", requested: int = 0,
) -> DataFrame:
    """The same number of rows from every class; raises when a class is too small."""
    row = balanced_target(df, cap, class_names, requested).first()
    if row["smallest"] < 10 or row["target"] < 10 or row["target"] % 10 or row["smallest"] < row["target"]:
        raise GateError(f"smallest class has {row['smallest']} rows, requested {row['target']}")
    known = df.filter(F.col("class_name").isin(list(class_names)))
    return seeded_rank(
        known, "class_name", identity, seed, name="_rank", keep=F.lit(int(row["target"]))
    ).drop("_rank", "group_total")


def tiered_sample(
    df: DataFrame, requested: Mapping[str, int], seed: int = 42, identity: str = "source_group",
    short_side: str = "short_side", preferred: int = S.PREFERRED_SHORT_SIDE,
) -> DataFrame:
    """Per class the requested number, sharp rows first, pseudo-random inside each tier."""
    wanted = config_table(df.sparkSession, list(requested.items()), "class_name string, wanted bigint")
    limit = F.lit(0).cast("bigint")
    for name, n in requested.items():
        limit = F.when(F.col("class_name") == name, n).otherwise(limit)
    ranked = seeded_rank(
        df.join(wanted.select("class_name"), "class_name", "left_semi"), "class_name", identity, seed,
        tier=(F.col(short_side) < preferred).cast("int"), name="_rank", keep=limit,
    )
    return ranked.drop("_rank", "group_total")


def sample_shortfall(df: DataFrame, requested: Mapping[str, int]) -> DataFrame:
    """Classes with fewer rows than requested."""
    wanted = config_table(df.sparkSession, list(requested.items()), "class_name string, wanted bigint")
    counts = df.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "class_name", "left").select(
        "class_name", "wanted", F.coalesce("n", F.lit(0)).alias("available")
    ).filter("available < wanted")


def review_sample(df: DataFrame, per_class: int = 6, seed: int = 42, identity: str = "image_id") -> DataFrame:
    """A fixed number per class; chunks of the seeded order beyond it are dropped before anything is sorted."""
    ranked = seeded_rank(df, "class_name", identity, seed, name="_rank", keep=F.lit(per_class))
    return ranked.drop("_rank", "group_total")
