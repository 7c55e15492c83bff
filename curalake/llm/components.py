"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalake.llm.common import written

#: Edges that a task writes in a round after the first.
TASK_EDGES = 1 << 18


def _least(edges: DataFrame) -> DataFrame:
    """The distinct edges ``a, b`` with ``m``, the least neighbour of ``a``, by one shuffle."""
    return edges.repartition("a").distinct().withColumn("m", F.min("b").over(W.partitionBy("a")))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A row per edge, some repeated: the least neighbour hangs below no other, all others hang below it."""
    down = _least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    return down.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def _written(stars: DataFrame, most: int | None = None) -> tuple[DataFrame, tuple]:
    """The stars of a round, and a digest of them from the pass that writes them. ``most``: a bound on their number."""
    if most is not None:
        stars = stars.coalesce(most // TASK_EDGES + 1)
    seen = Observation()
    digest = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")]
    out = written(stars.observe(seen, *digest), "stars")
    return out, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node of edges ``a, b`` (bigint). The number of rounds is
    logarithmic in the longest path; edges that are stars already take two. Two rounds with the same rows are the end, and
    the rows of stars do not repeat."""
    now, state = _written(_small(edges.filter("a <> b")))
    mark = None
    while state != mark:
        mark = state
        now, state = _written(_small(_large(now)), state[0])  # a round has no more rows than the one before
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
