"""Exact leakage, overlap and exclusion by identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.functions.text import strip

IDENTITY_COLUMNS = ("checksum", "image_id", "file_path", "source_group")


def cross_split_duplicates(df: DataFrame, splits: Sequence[str], split: str = "dataset_split") -> DataFrame:
    """Identities seen in more than one split, as ``column:value`` with the number of splits.

    The splits of an identity are one bit each, so a hot identity is reduced to a
    single number on the map side; there is no self join and no collected group.
    """
    bits = F.lit(None).cast("bigint")
    for position, name in enumerate(splits):
        bits = F.when(F.col(split) == name, F.lit(1 << position).cast("bigint")).otherwise(bits)
    present = [c for c in IDENTITY_COLUMNS if c in df.columns]
    keys = []
    for c in present:
        value = strip(F.col(c).cast("string"))
        keys.append(F.struct(F.lit(c).alias("c"), (F.lower(value) if c == "file_path" else value).alias("v")))
    return (
        df.select(bits.alias("bits"), F.inline(F.array(*keys)))
        .filter("v IS NOT NULL AND v <> '' AND bits IS NOT NULL")
        .groupBy("c", "v").agg(F.bit_or("bits").alias("bits"))
        .select(F.concat("c", F.lit(":"), "v").alias("identity"), F.bit_count("bits").cast("bigint").alias("split_count"))
        .filter("split_count > 1")
    )


def heldout_leakage(heldout: DataFrame, development: DataFrame, subject: str = "filename") -> DataFrame:
    """Held-out rows that share a source group or checksum with development data."""
    found = None
    for column in ("source_group", "checksum"):
        if column not in heldout.columns or column not in development.columns:
            continue
        keys = development.select(column).distinct()
        part = heldout.join(keys, column, "left_semi").select(
            F.lit(f"shared_{column}").alias("rule"), F.col(subject).alias("subject"), F.col(column).alias("value")
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("neither source_group nor checksum is in both tables")
    return found


def shared_values(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """Set intersection of one column."""
    return first.select(column).intersect(second.select(column))


def exclude_groups(df: DataFrame, exclusions: Sequence[DataFrame], column: str = "source_group") -> DataFrame:
    """Drop rows whose group is in any of the exclusion tables."""
    used = None
    for table in exclusions:
        part = table.select(F.col(column).cast("string").alias(column))
        used = part if used is None else used.union(part)
    return df if used is None else df.join(used.distinct(), column, "left_anti")


def pick_listed(df: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Rows named in a list; names that are not found come back with ``found = false``."""
    wanted = listed.select(column).distinct()
    picked = df.join(wanted, column).withColumn("found", F.lit(True))
    missing = wanted.join(df.select(column), column, "left_anti").withColumn("found", F.lit(False))
    return picked.unionByName(missing, allowMissingColumns=True)
