"""Near duplicates by MinHash with tensored banding, verified on whole shingle sets.

A table key of r minhashes needs r hashes per table. Here a key is a pair (u, v) of half keys from two collections of m
half keys each: every half key of the first with every one of the second makes m * m tables from only r * m hashes (24
half keys of two minhashes give 144 tables of four, for which plain banding would compute 576). Two sets of similarity
s share a half key with probability s ** (r / 2), and a table if they share a half key in both collections, so they miss
all tables with 2 * (1 - s ** (r / 2)) ** m at most: 1e-5 at 0.8, 1e-8 at 0.9.

Equal sets are one class first, so exact copies cost nothing. A document emits the same number of keys whatever group it
is in; a key's share of all emitted rows is below 1 / m ** 2. What shares a key is compared and verified on whole sets
in ``pairs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import bounded_batches, written
from curalake.llm.pairs import Threshold, components_of, linked_classes, members_of, parity_bits
from curalake.llm.shingles import mixed, shingle_sets

WORDS = 4
THRESHOLD = Threshold(80)
#: Minhashes per half key, half keys per collection.
WIDE, COUNT = 2, 12
#: Sets with fewer shingles link with equal sets only: 3 of 4 is below the threshold.
LEAST = 4

_rng = np.random.default_rng(13)
_SUM = _rng.integers(1, 1 << 63, size=2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 1 << 63, size=(2 * COUNT, WIDE), dtype=np.uint64)
_FACTORS = _rng.integers(1, 1 << 63, size=(2 * COUNT, WIDE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def half_keys(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Half keys of sets that lie one after another in ``tokens``: an int64 row per set, first the one collection, then the other.

    A minhash is the least value of a set under a permutation, x -> (x ^ mask) * odd factor. The place of a half key is
    part of its hash, so half keys of different places never meet.
    """
    out = np.empty((len(starts), 2 * COUNT), dtype=np.uint64)
    for i in range(2 * COUNT):
        own = np.full(len(starts), i + 1, dtype=np.uint64)
        for k in range(WIDE):
            own = mixed(own + np.minimum.reduceat((tokens ^ _MASKS[i, k]) * _FACTORS[i, k], starts))
        out[:, i] = own
    return out.view(np.int64)


def _grouped(sets: list[np.ndarray], most: int = 1 << 17) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Non-empty sets in groups of about ``most`` shingles: their numbers, all shingles, and where each begins."""
    own: list[int] = []
    held = 0
    for i, s in enumerate(sets):
        if len(s):
            own.append(i)
            held += len(s)
        if own and (held >= most or i == len(sets) - 1):
            sizes = [len(sets[k]) for k in own]
            yield own, np.concatenate([sets[k] for k in own]), np.cumsum([0, *sizes[:-1]])
            own, held = [], 0


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, fp1, fp2, half, sketch``: size and 128-bit fingerprint of the set, its half keys and parity sketch."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n bigint, fp1 bigint, fp2 bigint, half array<bigint>, sketch array<bigint>")
    def computed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = shingle_sets(texts.tolist(), WORDS)
            n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            sums = np.zeros((len(sets), 2), dtype=np.int64)
            half: list[np.ndarray | None] = [None] * len(sets)
            sketch = [parity_bits(s) if len(s) >= LEAST else None for s in sets]
            for own, tokens, starts in _grouped(sets):
                for k in range(2):
                    sums[own, k] = np.add.reduceat(mixed(tokens * _SUM[k]), starts).view(np.int64)
                for i, keys in zip(own, half_keys(tokens, starts), strict=True):
                    half[i] = keys if n[i] >= LEAST else None
            yield pd.DataFrame({"n": n, "fp1": sums[:, 0], "fp2": sums[:, 1], "half": half, "sketch": sketch})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.select("doc_id", computed("text").alias("x")).select("doc_id", F.col("x.n").alias("n_shingles"), "x.fp1", "x.fp2", "x.half", "x.sketch")


def table_keys(classes: DataFrame) -> DataFrame:
    """``key, rep, n, own``: every half key of the first collection with every one of the second. Input: ``rep, n, half``."""
    first = classes.select("rep", "n", F.explode(F.slice("half", 1, COUNT)).alias("a"), F.slice("half", COUNT + 1, COUNT).alias("later"))
    return first.select("rep", "n", "a", F.explode("later").alias("b")).select(F.xxhash64("a", "b").alias("key"), "rep", "n", F.lit(True).alias("own"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row: the smallest doc_id reachable by links of similarity 0.8 or more
    of 4-word shingles, and whether the row is that document.

    Null or blank texts have no shingles and stand alone. Repeated rows share a component and are all kept or all not.
    Rows of one doc_id with different texts count as one document that links by each. A null doc_id links nothing, has a
    null component and is kept. Only doc_id and text are read; an empty table gives no rows.
    """
    rows = written(features(docs), "minhash-features")
    same = ["n_shingles", "fp1", "fp2"]
    classes = rows.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "half", "sketch")).alias("least"))
    classes = written(classes.select(*same, F.col("least.doc_id").alias("rep"), "least.half", "least.sketch"), "minhash-classes")
    able = classes.filter("half IS NOT NULL").select("rep", F.col("n_shingles").alias("n"), "half", "sketch")
    groups = linked_classes(able, members_of(table_keys(able)), docs, lambda texts: shingle_sets(texts, WORDS), THRESHOLD)
    return components_of(rows, classes, groups, same).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
