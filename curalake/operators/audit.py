"""The audit summary of a split dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.operators.clusters import cluster_totals, near_dup_clusters
from curalake.operators.hamming import near_dup_totals
from curalake.operators.manifest import normal_certification
from curalake.session import materialize


def audit_summary(rows: DataFrame, edges: DataFrame, distance: int = 6, pairs: bool = False) -> DataFrame:
    """One row: record count, non-default orientations, certification and near-duplicate clusters, with ``pairs`` also the
    number of record pairs, which grows with the square of a group of copies.

    The parts are one-row aggregates; their union is folded into one row by ``max``. The edges are made once, so that no part
    carries their plan.
    """
    edges = materialize(edges.select("hash_a", "hash_b", "pair_count", "cross_split_pairs", "cross_class_pairs"))
    parts = [
        rows.agg(F.count(F.lit(1)).alias("record_count"), F.count_if(F.col("orientation") != 1).alias("non_default_orientation")),
        normal_certification(rows), cluster_totals(rows, near_dup_clusters(rows, edges)), *([near_dup_totals(edges)] if pairs else []),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(F.lit(distance).cast("bigint").alias("near_duplicate_threshold"), *[F.max(c).alias(c) for c in stacked.columns])
