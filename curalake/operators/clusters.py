"""Clusters of linked nodes by star contraction: linear output where pairs would be quadratic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake.functions.hashing import hash64, hex64
from curalake.functions.text import folded
from curalake.session import stored


def _turn(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("turn"), F.col(node).alias("up"))


def clusters(edges: DataFrame) -> DataFrame:
    """``node, cluster`` (the least node reachable) of every node of edges ``a, b`` (bigint).

    Each round every node hangs on the neighbour (or itself) that comes first in a pseudo-random order, and what hangs on
    one node becomes one: a star is contracted at once, and of a path a constant share of the nodes goes, so the rounds grow
    with the logarithm of the longest path. The order changes with the round. Edges and hooks of a round are written and read again.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hooks: list[DataFrame] = []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.least(F.min(_turn("b", len(hooks))), _turn("a", len(hooks))).alias("up"))
        hook = stored(first.select(F.col("a").alias("node"), "up.up"), "hook")
        hooks.append(hook)
        left, right = (hook.select(F.col("node").alias(i), F.col("up").alias(f"u{i}")) for i in "ab")
        now = now.join(left, "a").join(right, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        now = stored(now.filter("a <> b").distinct(), "edges")
    placed = nodes.select("node", F.col("node").alias("root"))
    for hook in hooks:
        placed = placed.join(hook.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    placed = stored(placed, "placed")
    least = placed.groupBy("root").agg(F.min("node").alias("cluster"))
    return placed.join(least, "root").select("node", "cluster")


def near_dup_clusters(df: DataFrame, edges: DataFrame) -> DataFrame:
    """``image_id, perceptual_hash, cluster_hash, cluster_size`` of every record that has a near-duplicate.

    ``edges`` are the hash pairs of ``near_dup_edges``. A cluster's representative is its least hash; one row per record, so
    the result is linear where the pairs of a large group of copies are not.
    """
    # the hash pairs are made once; they are read for the nodes and for every round
    placed = clusters(stored(edges.select(hash64(F.col("hash_a")).alias("a"), hash64(F.col("hash_b")).alias("b")), "links"))
    named = placed.withColumn("hash", hex64(F.col("node")))
    least = named.groupBy("cluster").agg(F.min("hash").alias("cluster_hash"))  # text order is not that of signed longs
    members = named.join(least, "cluster").select(F.col("hash").alias("perceptual_hash"), "cluster_hash")
    rows = df.select("image_id", folded(F.col("perceptual_hash")).alias("perceptual_hash")).join(members, "perceptual_hash")
    sizes = rows.groupBy("cluster_hash").agg(F.count(F.lit(1)).alias("cluster_size"))
    return rows.join(sizes, "cluster_hash").select("image_id", "perceptual_hash", "cluster_hash", "cluster_size")


def cluster_totals(df: DataFrame, members: DataFrame, split: str = "dataset_split", class_name: str = "class_name") -> DataFrame:
    """One row: clusters, records in them, the largest, and how many span several splits or classes."""
    labelled = members.join(df.select("image_id", split, class_name), "image_id")
    spans = labelled.groupBy("cluster_hash").agg(
        F.count(F.lit(1)).alias("n"), (F.min(split) != F.max(split)).alias("splits"), (F.min(class_name) != F.max(class_name)).alias("classes"),
    )
    return spans.agg(
        F.count(F.lit(1)).alias("near_duplicate_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("clustered_records"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_cluster"), F.count_if("splits").alias("cross_split_clusters"),
        F.count_if("classes").alias("cross_class_clusters"),
    )
