"""Exact Hamming-distance joins on 64-bit hashes.

Identical hashes are collapsed first, so a hash shared by a third of all rows is
one node. Distinct hashes are joined by banding: cut the 64 bits into
``distance + spare`` bands; two hashes within ``distance`` agree on at least
``spare`` bands, so every choice of ``spare`` bands is one equi-join key. A pair
that agrees on several keys is kept only under its first key, which makes a
``distinct`` over the pairs unnecessary.

Rows of a bucket come together by one shuffle and are compared as arrays of
hashes, a few nanoseconds a comparison; no join writes a row per comparison.
Buckets above ``hot`` rows are banded again over the bits outside their key (a
pair of such a bucket differs only there), and what is still larger than
``hot`` and ``BLOCK`` rows is cut into blocks, so that a task holds two blocks at
most. Nothing is capped: the result is the same with every setting.

The pair table is kept factored: nodes ``(hash, split, class, count, first id)``
and edges between hashes. It is complete, stays linear where copies abound, and
gives exact pair counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake.functions.hashing import hamming, hash64, hex64, is_hex
from curalake.functions.text import folded
from curalake.operators.violations import GateError
from curalake.session import materialize

ALL_BITS = list(range(64))
BLOCK = 4096  # rows of a block at least; a cell of two blocks is 64 KB of hashes
SMALL = 32  # cells of up to this many rows are compared together, row by shifted row
MATRIX = 1 << 16  # distances computed at a time
CELL_ROWS = 1 << 17  # rows a task looks at together
BATCH_PAIRS = 1 << 16  # pairs of an output batch, about
TASK_ROWS = 1 << 20  # keyed rows per task, about
BROADCAST_ROWS = 50_000  # tables of hot buckets that are broadcast, after they were counted


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def band_keys(bits: Sequence[int], distance: int, spare: int) -> list[list[int]]:
    """Every choice of ``spare`` out of ``distance + spare`` bands, as lists of bit positions."""
    count = min(distance + spare, len(bits))
    bands = [bits[i * len(bits) // count:(i + 1) * len(bits) // count] for i in range(count)]
    return [sorted(b for band in chosen for b in band) for chosen in combinations(bands, count - distance)]


def default_spare(distance: int, nodes: int) -> int:
    """Longer keys for larger tables: aim at buckets of a few hundred rows."""
    spare = 1
    while spare < 4 and distance > 0 and nodes > 256 * 2 ** (64 * spare / (distance + spare)):
        spare += 1
    return max(spare, 2) if distance <= 8 else spare


def _mask(bits: Sequence[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _earlier(bits: Sequence[int], distance: int, spare: int) -> list[list[int]]:
    """For every key of ``band_keys`` the masks of the bands before its last one that it leaves out.

    Two hashes that agree on a key meet there first if they differ on each of these.
    """
    count = min(distance + spare, len(bits))
    bands = [_mask(bits[i * len(bits) // count:(i + 1) * len(bits) // count]) for i in range(count)]
    return [[bands[b] for b in range(chosen[-1]) if b not in chosen] for chosen in combinations(range(count), count - distance)]


def _longs(values: Sequence[int]) -> Column:
    """A constant BIGINT array from one text literal, folded to a single value by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _hot(rows: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """``keys, n`` of the buckets of more than ``limit`` rows, or None if there is none; a small table is broadcast once counted."""
    found = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit))
    total = found.count()
    return None if total == 0 else F.broadcast(found) if total <= BROADCAST_ROWS else found


def near_hash_pairs(
    nodes: DataFrame, distance: int, cross: bool = False, pivot: int = 0, spare: int | None = None, hot: int = 4096,
) -> DataFrame:
    """``(h_a, h_b, distance)`` of distinct hashes with ``h_a < h_b``.

    ``nodes`` has one row ``(h bigint, splits bigint)`` per distinct hash; ``splits``
    is a bit set. The table is read several times, so callers materialize it once
    (distinct hashes only, not the records). With ``cross`` a pair needs two different splits; ``pivot`` is the
    bit of the largest split, whose inner pairs are then not even enumerated.
    """
    if not 0 <= distance <= 63:
        raise ValueError("distance must be between 0 and 63; at 64 every pair matches")
    if distance == 0:
        return nodes.select(F.col("h").alias("h_a"), F.col("h").alias("h_b"), F.lit(0).cast("bigint").alias("distance")).limit(0)
    total = nodes.count()
    spare = spare or default_spare(distance, total)
    outer = band_keys(ALL_BITS, distance, spare)
    tests = {(c, -1): masks for c, masks in enumerate(_earlier(ALL_BITS, distance, spare))}
    keyed = nodes.select("h", "splits", F.posexplode(F.transform(_longs([_mask(k) for k in outer]), lambda m: F.col("h").bitwiseAND(m))).alias("c", "k"))
    whole = {"s": F.lit(-1), "t": F.lit(0).cast("bigint"), "blocks": F.lit(1).cast("bigint")}
    large = _hot(keyed, ["c", "k"], hot) if total > hot else None
    if large is None:
        return _bucket_pairs(keyed.withColumns(whole), distance, cross, pivot, tests, total * len(outer))
    inner_masks = []
    for c, key in enumerate(outer):
        rest = [b for b in ALL_BITS if b not in set(key)]
        again = len(rest) > distance
        inner_masks.append([_mask(k) for k in band_keys(rest, distance, 1)] if again else [0])
        tests |= {(c, s): tests[c, -1] + masks for s, masks in enumerate(_earlier(rest, distance, 1) if again else [[]])}
    cold = keyed.join(large.select("c", "k"), ["c", "k"], "left_anti").withColumns(whole)
    masks = F.transform(F.split(F.lit(";".join(",".join(map(str, m)) for m in inner_masks)), ";"), lambda t: F.split(t, ",").cast("array<bigint>"))
    refined = keyed.join(large, ["c", "k"]).select(
        "h", "splits", "c", "k", "n", F.posexplode(F.transform(F.get(masks, F.col("c")), lambda m: F.col("h").bitwiseAND(m))).alias("s", "t"),
    )
    block = max(hot, BLOCK)
    over = _hot(refined.filter(F.col("n") > block), ["c", "k", "s", "t"], block)
    size = F.ceil(F.coalesce("m", F.lit(1)) / F.lit(block)).cast("bigint")
    refined = refined.drop("n").withColumn("m", F.lit(1)) if over is None else refined.drop("n").join(over.withColumnRenamed("n", "m"), ["c", "k", "s", "t"], "left")
    return _bucket_pairs(cold.unionByName(refined.withColumn("blocks", size).drop("m")), distance, cross, pivot, tests, total * len(outer))


def _bucket_pairs(
    buckets: DataFrame, distance: int, cross: bool, pivot: int, tests: Mapping[tuple[int, int], Sequence[int]], rows: int,
) -> DataFrame:
    """Compare the rows of each bucket, in arrays of hashes, and keep each qualifying pair under its first key.

    A bucket of ``blocks`` blocks is a grid: the cell (i, j) with i <= j compares block i with block j, so no cell holds
    more than two blocks. Rows of a cell come one after another in their task, which holds no more than a cell and a batch.
    """
    own, other = F.pmod(F.xxhash64("h"), F.col("blocks")), F.col("other")
    cells = buckets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "c", "s", "k", "t", F.least("own", other).alias("i"), F.greatest("own", other).alias("j"), (F.col("own") > other).alias("side"),
        (F.col("splits") == (pivot or -1)).alias("pure"), "h", "splits",
    )
    keys = ["c", "k", "s", "t", "i", "j"]
    parts = max(buckets.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    ordered = cells.repartition(parts, *keys).sortWithinPartitions(*keys, "side", "pure")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for columns in _whole_cells(batches, keys):
            h, splits = columns["h"].view(np.uint64), columns["splits"]
            for p, q in _candidates(columns, h, distance, bool(cross and pivot)):
                if cross:
                    apart = (splits[p] != splits[q]) | ((splits[p] & (splits[p] - 1)) != 0)
                    p, q = p[apart], q[apart]
                found.append(_first_met(h, p, q, columns["c"], columns["s"], tests))
                if sum(len(a) for a, _ in found) >= BATCH_PAIRS:
                    yield _as_batch(found)
                    found = []
        if found:
            yield _as_batch(found)

    return ordered.mapInArrow(run, "h_a bigint, h_b bigint, distance bigint")


def _whole_cells(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of many rows at a time, cut between cells, with ``start`` and ``end`` of the cell of every row."""
    held: list[dict[str, np.ndarray]] = []
    count = 0

    def cut(last: bool) -> Iterator[dict[str, np.ndarray]]:
        nonlocal held, count
        rows = {n: np.concatenate([x[n] for x in held]) for n in held[0]}
        change = np.zeros(count, dtype=bool)
        change[0] = True
        for key in keys:
            change[1:] |= rows[key][1:] != rows[key][:-1]
        starts = np.flatnonzero(change)
        until = count if last else starts[-1]
        held, count = ([], 0) if last else ([{n: x[until:] for n, x in rows.items()}], count - until)
        if until:
            starts = starts[starts < until]
            sizes = np.diff(np.append(starts, until))
            yield {n: x[:until] for n, x in rows.items()} | {"start": np.repeat(starts, sizes), "end": np.repeat(starts + sizes, sizes)}

    due = CELL_ROWS
    for batch in batches:
        held.append({n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names})
        count += batch.num_rows
        if count >= due:
            yield from cut(False)
            due = CELL_ROWS + 2 * count
    if count:
        yield from cut(True)


def _candidates(columns: Mapping[str, np.ndarray], h: np.ndarray, distance: int, pivoted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the near pairs of every cell; with ``pivoted`` not those of two rows of the pivot alone."""
    start, end, side, pure = (columns[n] for n in ("start", "end", "side", "pure"))
    small = (end - start <= SMALL) & (columns["i"] == columns["j"]) & ~(pure & pivoted)
    p = np.flatnonzero(small)
    for shift in range(1, SMALL):  # all small cells at once: each row with the one ``shift`` rows on
        p = p[p + shift < end[p]]
        if not len(p):
            break
        near = p[np.bitwise_count(h[p] ^ h[p + shift]) <= distance]
        if len(near):
            yield near, near + shift
    first = np.flatnonzero(((end - start > SMALL) | (columns["i"] != columns["j"])) & (start == np.arange(len(h))))
    for a, b in zip(first, end[first], strict=True):
        if columns["i"][a] == columns["j"][a]:
            plain = a + int(np.count_nonzero(~pure[a:b])) if pivoted else b
            ranges = [(a, plain, a, b)]
        else:
            middle = a + int(np.count_nonzero(~side[a:b]))
            if pivoted:
                left = a + int(np.count_nonzero(~pure[a:middle]))
                right = middle + int(np.count_nonzero(~pure[middle:b]))
                ranges = [(a, left, middle, b), (left, middle, middle, right)]
            else:
                ranges = [(a, middle, middle, b)]
        for left, left_end, right, right_end in ranges:
            step = max(1, MATRIX // max(1, right_end - right))
            for row in range(left, left_end, step):
                until, column = min(row + step, left_end), max(right, row + 1)
                p, q = np.nonzero(np.bitwise_count(h[row:until, None] ^ h[None, column:right_end]) <= distance)
                p, q = p + row, q + column
                yield p[p < q], q[p < q]


def _first_met(
    h: np.ndarray, p: np.ndarray, q: np.ndarray, c: np.ndarray, s: np.ndarray, tests: Mapping[tuple[int, int], Sequence[int]],
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs whose first common key is that of the cell they met in."""
    x, keep = h[p] ^ h[q], np.ones(len(p), dtype=bool)
    key = c[p].astype(np.int64) * 4096 + s[p]
    for code in np.unique(key):
        mine = np.flatnonzero(key == code)
        for mask in tests[int(code + 1) // 4096, int((code + 1) % 4096) - 1]:
            mine = mine[keep[mine]]
            keep[mine] = (x[mine] & np.uint64(mask & (1 << 64) - 1)) != 0
    return h[p[keep]], h[q[keep]]


def _as_batch(found: Sequence[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([pair[i] for pair in found]) for i in (0, 1))
    distance, a, b = np.bitwise_count(a ^ b).astype(np.int64), a.view(np.int64), b.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(distance)], ["h_a", "h_b", "distance"])


def invalid_hashes(df: DataFrame, column: str = "perceptual_hash") -> DataFrame:
    """Rows whose hash is blank or is not 16 hex digits."""
    text = folded(F.col(column))
    return df.select(
        "image_id", F.col(column).alias("perceptual_hash"),
        F.when(text == "", "blank_hash").when(~is_hex(text, 16), "invalid_hash").alias("rule"),
    ).filter("rule IS NOT NULL")


def hash_nodes(df: DataFrame, splits: Sequence[str], split: str = "dataset_split", class_name: str = "class_name") -> DataFrame:
    """``(h, split_idx, class, n, first_id)``: one row per distinct hash, split and class."""
    position = F.lit(None).cast("int")
    for i, name in enumerate(splits):
        position = F.when(F.col(split) == name, F.lit(i)).otherwise(position)
    usable = df.filter(is_hex(folded(F.col("perceptual_hash")), 16))
    return (
        usable.select(
            hash64(F.col("perceptual_hash")).alias("h"), position.alias("split_idx"),
            F.col(class_name).alias("class"), F.col("image_id").alias("image_id"),
        )
        .groupBy("h", "split_idx", "class").agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("first_id"))
    )


def _split_bits(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("h").agg(F.bit_or(F.expr("shiftleft(1L, coalesce(split_idx, 62))")).alias("splits"))


def _per_hash(nodes: DataFrame) -> DataFrame:
    """Total and labels of every hash; the array has one entry per split and class, not per record."""
    entry = F.struct(F.col("split_idx").alias("split"), F.col("class").alias("class"), F.col("n").alias("n"))
    return nodes.groupBy("h").agg(F.sum("n").alias("n"), F.collect_list(entry).alias("labels"))


def _same(first: Column, second: Column, label: str) -> Column:
    """Number of record pairs of two groups that agree on ``label``."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(first, zero, lambda total, a: total + a["n"] * F.aggregate(
        F.filter(second, lambda b: b[label].eqNullSafe(a[label])), zero, lambda part, b: part + b["n"]
    ))


def near_dup_edges(
    df: DataFrame, distance: int = 6, splits: Sequence[str] = ("train", "validation", "test"),
    split: str = "dataset_split", class_name: str = "class_name", spare: int | None = None, hot: int = 4096,
) -> DataFrame:
    """All near-duplicate pairs, as hash pairs with exact record-pair counts.

    ``hash_a = hash_b`` stands for the pairs inside one group of identical hashes.
    """
    nodes = hash_nodes(df, splits, split, class_name)
    hashes = materialize(_per_hash(nodes))
    # "every pair" needs no split bits
    pairs = near_hash_pairs(hashes.select("h", F.lit(0).cast("bigint").alias("splits")), distance, spare=spare, hot=hot)
    a = hashes.select(F.col("h").alias("h_a"), F.col("n").alias("n_a"), F.col("labels").alias("la"))
    b = hashes.select(F.col("h").alias("h_b"), F.col("n").alias("n_b"), F.col("labels").alias("lb"))
    every = F.col("n_a") * F.col("n_b")
    apart = pairs.join(a, "h_a").join(b, "h_b").select(
        "h_a", "h_b", "distance", "n_a", "n_b", every.alias("pair_count"),
        (every - _same(F.col("la"), F.col("lb"), "split")).alias("cross_split_pairs"),
        (every - _same(F.col("la"), F.col("lb"), "class")).alias("cross_class_pairs"),
    )
    square = F.col("n") * F.col("n")
    copies = hashes.filter("n > 1").select(
        F.col("h").alias("h_a"), F.col("h").alias("h_b"), F.lit(0).cast("bigint").alias("distance"),
        F.col("n").alias("n_a"), F.col("n").alias("n_b"),
        ((square - F.col("n")) / 2).cast("bigint").alias("pair_count"),
        ((square - _same(F.col("labels"), F.col("labels"), "split")) / 2).cast("bigint").alias("cross_split_pairs"),
        ((square - _same(F.col("labels"), F.col("labels"), "class")) / 2).cast("bigint").alias("cross_class_pairs"),
    )
    found = apart.unionByName(copies).withColumns({"hash_a": hex64(F.col("h_a")), "hash_b": hex64(F.col("h_b"))})
    swap = F.col("hash_a") > F.col("hash_b")  # BIGINT order is signed, text order is not
    return found.select(
        F.least("hash_a", "hash_b").alias("hash_a"), F.greatest("hash_a", "hash_b").alias("hash_b"), "distance",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        "pair_count", "cross_split_pairs", "cross_class_pairs",
    )


def near_dup_totals(edges: DataFrame) -> DataFrame:
    """One row of exact pair totals."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return edges.agg(
        total("pair_count").alias("near_duplicate_pairs"), total("cross_split_pairs").alias("cross_split_pairs"),
        total("cross_class_pairs").alias("cross_class_pairs"),
    )


def near_dup_cross_split(
    df: DataFrame, splits: Sequence[str], distance: int = 6, split: str = "dataset_split", pivot: str | None = None,
    spare: int | None = None, hot: int = 4096,
) -> DataFrame:
    """Near-duplicates that cross a split, earlier split first.

    One row per pair of ``(split, hash)`` groups: the first id of each group, the
    group sizes and the number of record pairs they stand for. Without exact
    copies inside a split every row is exactly one pair. The members of a group
    are in :func:`near_dup_members`.
    """
    nodes = hash_nodes(df, splits, split, split)
    groups = nodes.groupBy("h", "split_idx").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id")).filter("split_idx IS NOT NULL")
    groups = materialize(groups)
    bit = 1 << list(splits).index(pivot) if pivot else 0
    pairs = near_hash_pairs(_split_bits(groups), distance, cross=True, pivot=bit, spare=spare, hot=hot)
    both = pairs.select("distance", F.inline(F.array(
        F.struct(F.col("h_a"), F.col("h_b")), F.struct(F.col("h_b").alias("h_a"), F.col("h_a").alias("h_b")),
    )))
    copies = _split_bits(groups).filter(F.bit_count("splits") > 1).select(
        F.col("h").alias("h_a"), F.col("h").alias("h_b"), F.lit(0).cast("bigint").alias("distance")
    )
    a = groups.select(F.col("h").alias("h_a"), F.col("split_idx").alias("ia"), F.col("n").alias("first_count"), F.col("first_id").alias("first_image_id"))
    b = groups.select(F.col("h").alias("h_b"), F.col("split_idx").alias("ib"), F.col("n").alias("second_count"), F.col("first_id").alias("second_image_id"))
    names = F.array(*map(F.lit, splits))
    found = both.unionByName(copies).join(a, "h_a").join(b, "h_b").filter("ia < ib").withColumns({
        "first_split": F.get(names, F.col("ia")), "second_split": F.get(names, F.col("ib")),
    })
    line = F.concat(
        "first_split", F.lit(":"), "first_image_id", F.lit("<->"), "second_split", F.lit(":"), "second_image_id",
        F.lit(" (dHash distance "), F.col("distance").cast("string"), F.lit(")"),
    )
    return found.select(
        "first_split", "first_image_id", hex64(F.col("h_a")).alias("first_hash"), "first_count",
        "second_split", "second_image_id", hex64(F.col("h_b")).alias("second_hash"), "second_count",
        "distance", (F.col("first_count") * F.col("second_count")).alias("pair_count"), line.alias("line"),
    )


def near_dup_between(
    first: DataFrame, second: DataFrame, names: Sequence[str] = ("heldout", "development"), distance: int = 6,
    spare: int | None = None, hot: int = 4096,
) -> DataFrame:
    """Near-duplicates between two tables; the second may be much larger than the first."""
    columns = ["image_id", "perceptual_hash"]
    both = first.select(*columns).withColumn("side", F.lit(names[0])).unionByName(
        second.select(*columns).withColumn("side", F.lit(names[1]))
    )
    return near_dup_cross_split(both, names, distance, split="side", pivot=names[1], spare=spare, hot=hot)


def near_dup_members(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Every record that has a near-duplicate, with the exact number of its partners."""
    inside = F.col("hash_a") == F.col("hash_b")
    ends = F.array(
        F.struct(F.col("hash_a").alias("perceptual_hash"), F.when(inside, F.col("n_b") - 1).otherwise(F.col("n_b")).alias("m")),
        F.struct(F.when(~inside, F.col("hash_b")).alias("perceptual_hash"), F.col("n_a").alias("m")),
    )
    halves = edges.select("distance", F.inline(ends)).filter("perceptual_hash IS NOT NULL")
    degree = halves.groupBy("perceptual_hash").agg(F.sum("m").alias("partner_count"), F.min("distance").alias("nearest_distance"))
    return df.select("image_id", folded(F.col("perceptual_hash")).alias("perceptual_hash")).join(degree, "perceptual_hash")


def expand_pairs(df: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """Record pairs ``(image_a, image_b, distance)`` for review lists.

    The exact number of pairs is known beforehand; beyond ``budget`` this refuses
    instead of writing a shortened list, and the factored form is the answer.
    """
    total = near_dup_totals(edges).first()["near_duplicate_pairs"]
    if total > budget:
        raise GateError(f"{total} record pairs exceed the budget of {budget}; use the edges and members tables")
    ids = df.select(folded(F.col("perceptual_hash")).alias("hash"), "image_id")
    a = ids.select(F.col("hash").alias("hash_a"), F.col("image_id").alias("image_a"))
    b = ids.select(F.col("hash").alias("hash_b"), F.col("image_id").alias("image_b"))
    pairs = edges.select("hash_a", "hash_b", "distance").join(a, "hash_a").join(b, "hash_b")
    pairs = pairs.filter((F.col("hash_a") != F.col("hash_b")) | (F.col("image_a") < F.col("image_b")))
    return pairs.select(F.least("image_a", "image_b").alias("image_a"), F.greatest("image_a", "image_b").alias("image_b"), "distance")


