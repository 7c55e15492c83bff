"""Hard negatives by threshold joins over an inverted index of dimensions, after L2AP.

Vectors become integers, x = floor(256 * c); a score is an integer inner product. An anchor's positives are its first
rows of the same label; its hard negatives lie in a window below each positive's score. Both are threshold joins whose
threshold is lowered until enough rows are found.

A task holds one shard of rows and one block of anchors. Dimensions go by falling mass in groups, the index's lists. At
a threshold t a row is left out of all lists from the first group at which its remaining norm times the largest
remaining norm of an anchor is below t: what it omits cannot reach t alone, and a row omitted everywhere is never
looked at. Lists are read in order and partial scores accumulate; after each list an (anchor, row) dies when its
partial score plus the product of the remaining norms is below t. The survivors alone get their exact score. Then
anchors whose windows are full stop, the others go on at a lower threshold, down to the window's lower end, or without
one for positives. The bounds are those of Cauchy and Schwarz, so the result is exact.

Shards and blocks have a bounded size whatever a label's share of the rows; each returns a few rows per anchor. Rows of
one label form the shards for positives, so that an anchor meets its own label only; a large label has many shards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalake.llm.common import attach, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score, in hundredths of the positive's.
LOWEST, HIGHEST = 50, 95
SHARD_ROWS, BLOCK_ROWS = 8_192, 512
#: Dimensions per list, and the thresholds of the rounds as shares of the way from the upper to the lower end.
GROUP = 8
ROUNDS = (0.25, 0.5, 1.0)
#: Room for rounding of partial scores, as a share of the product of the norms.
ROUNDING = 1e-12


def usable_rows(df: DataFrame, id_column: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``vec_id, label, x`` (array<bigint>): rows with an id, a label and a non-empty vector of finite components.

    A vector whose squared length does not fit a long counts as not finite (its scores might not fit either). A vec_id
    stands for one row: of several, the one with the smallest label, then the smallest vector.
    """
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**31 / SCALE))
    rows = df.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), v.alias("v"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0").filter(finite)
    rows = rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * float(SCALE)).cast("bigint")).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    best = rows.filter(square < 2.0**62).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    return best.select("vec_id", "r.label", "r.x")


class Shard:
    """Rows of one shard and the anchors of one block, both by dimensions of falling mass, with remaining norms per list."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray) -> None:
        order = np.argsort(-np.square(rows.astype(np.float64)).sum(axis=0), kind="stable")
        self.rows, self.anchors = rows[:, order], anchors[:, order]
        self.starts = list(range(0, rows.shape[1], GROUP))
        self.row_rest, self.anchor_rest = (self._rest(m) for m in (self.rows, self.anchors))
        #: sums of products stay exact in doubles below this size
        self.exact = float(self.row_rest[0].max(initial=0)) * float(self.anchor_rest[0].max(initial=0)) < 2.0**52
        self.small, self.asks = self.rows.astype(np.float64), self.anchors.astype(np.float64)

    def _rest(self, m: np.ndarray) -> np.ndarray:
        """Norm of what remains from each list on, rounded up; the last entry is zero."""
        squares = np.square(m.astype(np.float64))
        sums = [squares[:, s:].sum(axis=1) for s in self.starts]
        return np.sqrt(np.array([*sums, np.zeros(len(m))])) * (1 + 1e-9)

    def above(self, who: np.ndarray, t: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (index in ``who``, row, exact score) with a score of ``t`` (per anchor) or more, without the ``barred`` pairs."""
        reach, least = self.anchor_rest[:, who], float(t.min())
        # the list from which a row is omitted: the first at which its remaining norm cannot reach the least threshold
        omitted = np.full(len(self.rows), len(self.starts))
        if least > 0:
            omitted = (self.row_rest * reach.max(axis=1)[:, None] < least).argmax(axis=0)
        alive = ~barred[who] & (omitted > 0)[None, :]
        partial = np.zeros(alive.shape)
        for g, start in enumerate(self.starts):
            listed = np.flatnonzero((omitted > g) & alive.any(axis=0))
            if not len(listed):
                break
            upto = start + GROUP
            partial[:, listed] += self.asks[who, start:upto] @ self.small[listed, start:upto].T
            # the last bound of a row that is omitted further on is that of all its omitted dimensions
            room = reach[g + 1][:, None] * self.row_rest[g + 1][listed] + reach[0][:, None] * (ROUNDING * self.row_rest[0][listed])
            alive[:, listed] &= partial[:, listed] + room >= t[:, None]
        a, r = np.nonzero(alive)
        score = self._scores(who[a], r)
        good = score >= t[a]
        return a[good], r[good], score[good]

    def _scores(self, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Exact scores of pairs: squared lengths fit a long, so the scores do."""
        out = np.empty(len(a), dtype=np.int64)
        left, right = (self.asks, self.small) if self.exact else (self.anchors, self.rows)
        for at in range(0, len(a), 65_536):
            own = slice(at, at + 65_536)
            out[own] = np.einsum("ij,ij->i", left[a[own]], right[r[own]])
        return out


def first_rows(shard: Shard, ids: np.ndarray, barred: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of each anchor's first ``k`` rows that are not barred: highest scores, ties to smaller ids."""
    waiting = np.arange(len(shard.anchors))
    most = shard.anchor_rest[0] * shard.row_rest[0].max(initial=0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # in shares of the largest score that norms allow; at last without a threshold
    for share in (0.5, 0.25, 0.0, -np.inf):
        if not len(waiting):
            break
        t = most[waiting] * share if share > -np.inf else np.full(len(waiting), -np.inf)
        a, r, score = shard.above(waiting, t, barred)
        full = (np.bincount(a, minlength=len(waiting)) >= k) | (share == -np.inf)
        keep = full[a]
        found.append((waiting[a[keep]], r[keep], score[keep]))
        waiting = waiting[~full]
    a, r, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))
    return _first(a, r, score, ids, k)


def _first(group: np.ndarray, r: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids[r], -score, group))
    group, r, score = group[order], r[order], score[order]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(group)) - np.repeat(starts, np.diff(starts, append=len(group)))
    keep = place < k
    return group[keep], r[keep], score[keep]


def window_rows(shard: Shard, ids: np.ndarray, barred: np.ndarray, owner: np.ndarray, goal: np.ndarray, k: int, lowest: int, highest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row, score) of the first ``k`` rows in each window: window w belongs to anchor ``owner[w]`` and holds the
    scores s with lowest * goal[w] <= 100 * s <= highest * goal[w]."""
    goals = [int(g) for g in goal]  # python integers: no overflow
    low = np.array([-(-lowest * g // 100) for g in goals], dtype=np.int64)
    high = np.array([highest * g // 100 for g in goals], dtype=np.int64)
    waiting = np.flatnonzero(low <= high)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for share in ROUNDS:
        if not len(waiting):
            break
        at = np.maximum(low[waiting], high[waiting] - ((high[waiting] - low[waiting]) * share).astype(np.int64)) if share < 1 else low[waiting]
        who, back = np.unique(owner[waiting], return_inverse=True)
        t = np.full(len(who), np.iinfo(np.int64).max, dtype=np.int64)
        np.minimum.at(t, back, at)
        a, r, score = shard.above(who, t.astype(np.float64) if shard.exact else t, barred)
        order = np.lexsort((ids[r], -score, a))
        a, r, score = a[order], r[order], score[order]
        borders = np.searchsorted(a, np.arange(len(who) + 1))
        full = np.zeros(len(waiting), dtype=bool)
        for i, w in enumerate(waiting):
            own = slice(borders[back[i]], borders[back[i] + 1])
            first = int(np.searchsorted(-score[own], -high[w], side="left"))
            last = int(np.searchsorted(-score[own], -at[i], side="right"))
            full[i] = last - first >= k or share == 1
            if full[i]:
                hit = np.arange(own.start + first, own.start + min(last, first + k))
                found.append((np.full(len(hit), w), r[hit], score[hit]))
        waiting = waiting[~full]
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))


def _stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in frame["x"]])


def _met(rows: DataFrame, anchors: DataFrame, keys: list[str], search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], ddl: str) -> DataFrame:
    """Rows and anchors of one (keys.., shard, block) meet in one task, which searches them."""
    names = [f.split()[0] for f in ddl.split(", ")]
    types = {f.split()[0]: {"bigint": "int64"}[f.split()[1]] for f in ddl.split(", ")}

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names}).astype(types)
        return search(left, right)[names]

    at = [*keys, "shard", "block"]
    return rows.groupBy(*at).cogroup(anchors.groupBy(*at)).applyInPandas(run, ddl)


def _dealt(df: DataFrame, own: Column, other: Column, name: str, others: str) -> DataFrame:
    """Each row goes to one of ``own`` parts by its id, and to every one of the ``other`` side's parts."""
    return df.select("*", F.pmod(F.xxhash64("vec_id", "label"), own).cast("int").alias(name), F.explode(F.sequence(F.lit(0), other.cast("int") - 1)).alias(others))


def positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``anchor_id, positive_id, positive_score``: each anchor's first ``k`` other rows of its label and length.

    Both sides are tables of their own with ``vec_id, label, x``. Highest scores come first, ties by the smaller vec_id.
    """
    keys = ["label", "dim"]
    rows, anchors = (df.withColumn("dim", F.size("x")) for df in (rows, anchors))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    asks = anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    grid = written(sizes.join(asks, keys), "negative-grid")
    left = _dealt(attach(rows, grid, keys, F.col("vec_id")), F.col("shards"), F.col("blocks"), "shard", "block")
    right = _dealt(attach(anchors, grid, keys, F.col("vec_id")), F.col("blocks"), F.col("shards"), "block", "shard")

    def search(members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        ids, asks = members["vec_id"].to_numpy(), asking["vec_id"].to_numpy()
        shard = Shard(_stacked(members), _stacked(asking))
        a, r, score = first_rows(shard, ids, asks[:, None] == ids[None, :], k)
        return pd.DataFrame({"anchor_id": asks[a], "positive_id": ids[r], "positive_score": score})

    columns = ["dim", "label", "shard", "block", "vec_id", "x"]
    hits = _met(left.select(*columns), right.select(*columns), keys, search, "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, k: int = NEGATIVES, positive: int = POSITIVES, lowest: int = LOWEST, highest: int = HIGHEST,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its first
    ``positive`` positives, the first ``k`` rows of another label whose score is within ``lowest`` and ``highest`` hundredths
    of the positive's.

    Both sides have ``vec_id, label, x`` as ``usable_rows`` gives them. Only vectors of the anchor's length take part. A
    window below a negative score is empty; below zero it holds scores of zero. A pair without negatives has no row.
    """
    rows, anchors = written(rows, "negative-rows"), written(anchors, "negative-asked")
    pairs = written(positives(rows, anchors, positive, shard_rows, block_rows), "negative-positives")
    windows = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_score", "positive_id"))).alias("w"))  # k of them at most
    asking = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("dim", F.size("x"))
    asking = written(asking, "negative-anchors")
    # labels are mixed here, so that no label makes a shard large: one number of shards and of blocks per vector length
    members = rows.withColumn("dim", F.size("x"))
    sizes = members.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    asks = asking.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    grid = written(sizes.join(asks, "dim"), "negative-grid")
    left = _dealt(attach(members, grid, ["dim"], F.col("vec_id")), F.col("shards"), F.col("blocks"), "shard", "block")
    right = _dealt(attach(asking, grid, ["dim"], F.col("vec_id")), F.col("blocks"), F.col("shards"), "block", "shard")

    def search(members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        ids, asks = members["vec_id"].to_numpy(), asking["vec_id"].to_numpy()
        shard = Shard(_stacked(members), _stacked(asking))
        same = asking["label"].to_numpy()[:, None] == members["label"].to_numpy()[None, :]
        spread = [(i, w["positive_id"], w["positive_score"]) for i, of in enumerate(asking["w"]) for w in of]
        owner, positive_id, goal = (np.array([s[j] for s in spread], dtype=np.int64) for j in range(3))
        w, r, score = window_rows(shard, ids, same, owner, goal, k, lowest, highest)
        return pd.DataFrame({"anchor_id": asks[owner[w]], "positive_id": positive_id[w], "positive_score": goal[w], "negative_id": ids[r], "negative_score": score})

    hits = _met(
        left.select("dim", "shard", "block", "vec_id", "label", "x"), right.select("dim", "shard", "block", "vec_id", "label", "x", "w"), ["dim"], search,
        "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
