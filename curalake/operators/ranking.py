"""Ranks inside huge groups without a one-task window.

``Window.partitionBy(class)`` over four classes is four tasks whatever the
cluster. Both functions below split a class into ordered chunks, count the
chunks, turn the counts into offsets and number rows inside the chunks only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalake.functions.hashing import seeded_key
from curalake.session import materialize


def seeded_rank(
    df: DataFrame, group: str, identity: str, seed: int, tier: Column | None = None,
    digits: int = 3, name: str = "rank", keep: Column | None = None,
) -> DataFrame:
    """1-based rank in ``group`` by ``(tier, md5(seed:identity), identity)``.

    md5 is uniform, so its first ``digits`` hex digits cut every group into
    ``16**digits`` equal chunks that are already in order. The input is read twice
    (counts, then ranks), so pass it without costly columns and join those later. Adds ``name`` and
    ``group_total``. ``keep`` is an optional bound over ``group_total``: chunks
    that start beyond it are dropped before anything is sorted.
    """
    chunk = ["_tier", "_chunk"]
    keyed = df.withColumns({
        "_tier": F.lit(0) if tier is None else tier.cast("int"),
        "_key": seeded_key(seed, F.col(identity).cast("string")),
    }).withColumn("_chunk", F.substring("_key", 1, digits))
    sizes = keyed.groupBy(group, *chunk).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy(*chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(group), *chunk,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(group)).alias("group_total"),
    )
    if keep is not None:
        offsets = offsets.filter(F.col("_offset") < keep)
    inside = W.partitionBy(group, *chunk).orderBy("_key", identity)
    ranked = keyed.join(offsets, [group, *chunk]).withColumn(
        name, (F.col("_offset") + F.row_number().over(inside)).cast("bigint")
    )
    if keep is not None:
        ranked = ranked.filter(F.col(name) <= keep)
    return ranked.drop("_tier", "_key", "_chunk", "_offset")


def ordered_rank(df: DataFrame, group: str, order: Sequence[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based rank in ``group`` by arbitrary, unique order columns.

    A range partitioning by ``(group, order)`` is checkpointed, so the row
    positions survive the loss of executors; the offsets have one row per
    partition and group.
    """
    cut = df.repartitionByRange(partitions, group, *order) if partitions else df.repartitionByRange(group, *order)
    placed = materialize(
        cut.sortWithinPartitions(group, *order).withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned(F.col("_place"), 33)
    chunks = (
        placed.groupBy(F.col(group), part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    )
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = chunks.select(
        F.col(group), "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(group)).alias("group_total"),
    )
    return (
        placed.withColumn("_part", part).join(offsets, [group, "_part"])
        .withColumn(name, F.col("_offset") + F.col("_place") - F.col("_first") + 1)
        .drop("_part", "_place", "_first", "_offset")
    )
