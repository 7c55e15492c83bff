"""Nearest neighbours by cosine: a vantage-point tree per shard of unit vectors, searched for blocks of queries.

On unit vectors the Euclidean distance orders as the cosine does and obeys the triangle inequality. A child is visited
if ``|d(query, vantage point) - distances inside it|`` can be below ``factor`` times the query's current k-th
distance; factor one is exact, smaller factors prune more. Shards and query blocks have a bounded size, so a task
holds one shard and one block, and each (shard, block) returns k rows per query. Equal vectors enter the index once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalake.llm.common import written

K = 5
FACTOR = 0.9
SHARD_ROWS = 8_192
BLOCK_ROWS = 2_048
LEAF = 48
HIT_DDL = "dim int, query_id bigint, twin bigint"
#: Room for rounding in comparisons of distances, so that ties at the k-th place are not lost.
SLACK = 1e-9


class Tree:
    """Vantage-point tree over unit vectors, with the range of distances on either side of each vantage point."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = points
        self.leaf = leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):  # noqa: ANN202
        if len(rows) <= self.leaf:
            return rows
        # the row farthest from the first one: deterministic, and near the rim
        seen = distances(self.points[rows], self.points[rows[0]][None, :])[:, 0]
        at = rows[int(np.argmax(seen))]
        d = distances(self.points[rows], self.points[at][None, :])[:, 0]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        spans = (d[near[0]], d[near[-1]], d[far[0]], d[far[-1]])
        return at, spans, self._build(rows[near]), self._build(rows[far])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances (inf: none) of the k nearest of each query, nearest first, ties to smaller rows."""
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1, dtype=np.int64)
        self._visit(self.root, queries, np.arange(len(queries)), best, found, factor)
        return found, best

    def _visit(self, node, queries, active, best, found, factor) -> None:  # noqa: ANN001
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            k = best.shape[1]
            d = np.concatenate([best[active], distances(queries[active], self.points[node])], axis=1)
            rows = np.concatenate([found[active], np.broadcast_to(node, (len(active), len(node)))], axis=1)
            order = np.lexsort((rows, d))[:, :k]
            best[active] = np.take_along_axis(d, order, axis=1)
            found[active] = np.take_along_axis(rows, order, axis=1)
            return
        at, (near_low, near_high, far_low, far_high), near, far = node
        d = distances(queries[active], self.points[at][None, :])[:, 0]
        inward = d < (near_high + far_low) / 2
        sides = ((near, near_low, near_high), (far, far_low, far_high))
        for first, chosen in ((0, inward), (1, ~inward)):
            for step, (child, low, high) in enumerate((sides[first], sides[1 - first])):
                mine = active[chosen]
                reach = factor * best[mine, -1] + SLACK
                open_ = (d[chosen] - reach <= high) & (d[chosen] + reach >= low) if step else np.ones(len(mine), dtype=bool)
                self._visit(child, queries, mine[open_], best, found, factor)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def usable_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array<double>): vectors that are not null or zero and hold finite components only."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_column).cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return rows.filter(finite).filter(F.exists("v", lambda x: x != 0.0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of up to k nearest ``vectors`` of each query, its own id left out.

    Both sides have ``vec_id, v``. Score: cosine of the given vectors in double precision; ties go to the smaller
    vec_id. Only vectors of the query's length are its candidates. Of equal vectors the k + 1 smallest ids enter (no other
    can be among the k nearest). A repeated vec_id counts once per distinct vector.
    """
    # the group limit is applied before the shuffle, so equal vectors never meet in one task
    same = W.partitionBy("v").orderBy("vec_id")
    few = vectors.dropDuplicates(["vec_id", "v"]).withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    few = written(few.withColumn("dim", F.size("v")), "vectors")
    # the smallest id of a vector stands for it
    heads = few.filter("place = 1").select("dim", "vec_id", "v")
    counts = heads.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    asked = written(queries.select("vec_id", "v", F.size("v").alias("dim")).dropDuplicates(["vec_id", "v"]), "queries")
    asks = asked.groupBy("dim").agg(F.count(F.lit(1)).alias("m"))
    grid = counts.join(asks, "dim").select(
        "dim", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("m") / block_rows).cast("int").alias("blocks")
    )
    sharded = heads.join(grid, "dim").select(
        "dim", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v"
    )
    blocked = asked.join(grid, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("vec_id", "dim"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v"
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"dim": [], "query_id": [], "twin": []}).astype({"dim": "int32", "query_id": "int64", "twin": "int64"})
        left = left.sort_values("vec_id")
        points, asked_for = (unit(np.stack(side["v"].to_numpy())) for side in (left, right))
        rows, found = Tree(points).search(asked_for, k + 1, factor)
        hit = np.isfinite(found)
        ids = left["vec_id"].to_numpy()
        who = np.broadcast_to(right["vec_id"].to_numpy()[:, None], rows.shape)
        return pd.DataFrame({"dim": np.full(int(hit.sum()), points.shape[1], dtype=np.int32), "query_id": who[hit], "twin": ids[rows[hit]]})

    hits = sharded.groupBy("dim", "shard", "block").cogroup(blocked.groupBy("dim", "shard", "block")).applyInPandas(search, HIT_DDL)
    hits = written(hits, "hits")
    twins = few.select(F.col("vec_id").alias("id"), "v", "place").join(
        heads.select(F.col("vec_id").alias("twin"), "v"), "v").select("twin", F.col("id").alias("vec_id"), F.col("v").alias("w"))
    dot = F.aggregate(F.arrays_zip("v", "w"), F.lit(0.0), lambda s, x: s + x["v"] * x["w"])
    scored = hits.select("query_id", "twin").distinct().join(asked.select(F.col("vec_id").alias("query_id"), "v"), "query_id").join(twins, "twin").filter("vec_id <> query_id")
    scored = scored.filter(F.size("v") == F.size("w")).select("query_id", "vec_id", (dot / (_norm(F.col("v")) * _norm(F.col("w")))).alias("score"))
    ranked = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaling by the largest component first keeps huge and tiny vectors apart from overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of exact (query_id, vec_id) pairs that were found."""
    n = exact.count()
    return found.join(exact.select("query_id", "vec_id"), ["query_id", "vec_id"]).count() / n if n else math.nan
