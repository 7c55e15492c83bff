"""Jaccard join on word shingles by parity sketches.

A document's shingles are 64-bit hashes. A sketch deals them to K cells by hash and keeps the XOR of each cell: one
shingle that only one of two documents has changes one cell, so the number of differing cells is at most the size of
the symmetric difference. In the size band of the smaller document that difference is at most d at the threshold, and
with K = d + 1 cells one is equal. Cells are the join keys: all of them, with independent repetitions up to ``KEYS``
keys, where K is small; for long documents the first ``KEYS`` cells, of which about a third agree at the threshold.
The chance that a pair at the threshold shares no key with a shingle in it is about 1e-8, and falls fast above it.
Documents emit the keys of their own band and of the band below.

Equal sets are one class before anything is joined. What shares a key is compared behind a 1024-bit parity sketch, whose
Hamming distance is a lower bound too, and verified on whole sets in ``pairs``. With ``exact`` long documents emit all
their cells, and no chance is left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import bounded_batches, written
from curalake.llm.pairs import Threshold, components_of, linked_classes, members_of, parity_bits

WORDS = 5
THRESHOLD = Threshold(75)
KEYS = 48
#: Characters handled at once (a longer text is handled alone), and powers kept between chunks.
CHUNK = 250_000
KEPT_POWERS = 1 << 12

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_IS_WHITE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEPT = _BASE ** np.arange(KEPT_POWERS, dtype=np.uint64)
_STEP = _rng.integers(1, 1 << 63, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_REPEAT = _rng.integers(1, 1 << 63, size=KEYS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Size bands [_BANDS[i], _BANDS[i + 1]): sizes of linked sets differ by a factor of at most 4/3, so bands by one.
_BANDS = [1]
while _BANDS[-1] < 1 << 40:
    _BANDS.append(max(_BANDS[-1] + 1, -(-_BANDS[-1] * THRESHOLD.denominator // THRESHOLD.numerator)))
FEATURES_DDL = "n_shingles bigint, fp1 bigint, fp2 bigint, keys array<bigint>, sketch array<bigint>, band bigint"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of the base by repeated doubling. Only those for words of usual length are kept."""
    have = _KEPT
    while len(have) < n:
        have = np.concatenate([have, have * (have[-1:] * _BASE)])
    return have


def shingle_sets(texts: Sequence[str | None], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``size`` words, or all words if there are fewer; only A-Z are lower-cased."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(texts)
    chunk: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if text:
            chunk.append(i)
            held += len(text)
        if held > CHUNK or chunk and i == len(texts) - 1:
            _sets_of(texts, chunk, out, size)
            chunk, held = [], 0
    if chunk:
        _sets_of(texts, chunk, out, size)
    return out


def _sets_of(texts: Sequence[str | None], chunk: list[int], out: list[np.ndarray], size: int) -> None:
    parts = [texts[i].encode("utf-8", "surrogatepass").lower() for i in chunk]
    data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
    white = _IS_WHITE[data]
    starts = np.flatnonzero(~white & np.append(True, white[:-1]))
    if not len(starts):
        return
    spans = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    words = mixed(np.add.reduceat(_BYTE[data[starts[0] :]] * powers(int(spans.max()))[place], starts - starts[0]))
    borders = np.cumsum([len(p) + 1 for p in parts])
    cuts = np.append(0, np.searchsorted(starts, borders))
    n = len(words)
    if n >= size:
        runs = words[: n - size + 1] * _STEP[0]
        for k in range(1, size):
            runs = runs + words[k : n - size + 1 + k] * _STEP[k]
        runs = mixed(runs)
    for k, i in enumerate(chunk):
        a, b = int(cuts[k]), int(cuts[k + 1])
        if b - a >= size:
            own = np.sort(runs[a : b - size + 1])
            out[i] = own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            out[i] = mixed((words[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a))


def band(size: int) -> int:
    return int(np.searchsorted(_BANDS, size, side="right")) - 1


def cell_keys(tokens: np.ndarray, of_band: int, exact: bool = False) -> np.ndarray:
    """Keys of the non-empty cells that documents of a band (as the smaller side) emit."""
    cells = (_BANDS[of_band + 1] - 1) // 3 + 1
    if cells >= KEYS:
        place = ((mixed(tokens * _REPEAT[KEYS]) >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
        inside = place < (cells if exact else KEYS)
        place, values = place[inside], tokens[inside]
    else:
        repeats = -(-KEYS // cells)
        spread = mixed(tokens[None, :] * _REPEAT[:repeats, None]) >> np.uint64(32)
        place = ((spread * np.uint64(cells)) >> np.uint64(32)) + (np.arange(repeats, dtype=np.uint64) * np.uint64(cells))[:, None]
        place, values = place.ravel(), np.broadcast_to(tokens, place.shape).ravel()
    if not len(place):
        return np.zeros(0, dtype=np.uint64)
    order = np.argsort(place, kind="stable")
    place, values = place[order], values[order]
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    parity = np.bitwise_xor.reduceat(values, starts)
    # the last bit tells the band's parity, and so whether a document emits a key for its own band or for the one below
    return mixed(parity + mixed(place[starts] + np.uint64(of_band << 32) + _STEP[6])) & ~np.uint64(1) | np.uint64(of_band & 1)


def features_of(tokens: np.ndarray, exact: bool = False) -> tuple[int, int, int, np.ndarray | None, np.ndarray | None, int]:
    n = len(tokens)
    if not n:
        return 0, 0, 0, None, None, 0
    sums = [int(mixed(tokens * step).sum().view(np.int64)) for step in (_STEP[5], _STEP[7])]
    if n < 3:  # smaller sets link with equal sets only
        return n, *sums, None, None, 0
    own = band(n)
    keys = np.concatenate([cell_keys(tokens, own, exact), cell_keys(tokens, own - 1, exact)])
    return n, *sums, keys.view(np.int64), parity_bits(tokens), own


def shingle_features(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, number of shingles, 128-bit fingerprint of the set, join keys and sketch of every row."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(FEATURES_DDL)
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [features_of(s, exact) for s in shingle_sets(texts.tolist())]
            yield pd.DataFrame(rows, columns=["n_shingles", "fp1", "fp2", "keys", "sketch", "band"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), features(F.col("text").cast("string")).alias("x")).select("doc_id", "x.*")


def similar_components(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the smallest doc_id reachable by links of similarity 0.75 or more.

    Null or blank texts have no shingles and stand alone. Repeated rows share a component. A null doc_id links
    nothing and has a null component. Rows of one doc_id with different texts count as one document that links by each.
    ``exact`` has long documents emit all their cells instead of the first ``KEYS``.
    """
    rows = written(shingle_features(docs, exact), "shingle-features")
    same = ["n_shingles", "fp1", "fp2"]
    classes = rows.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "keys", "sketch", "band")).alias("least"))
    classes = written(classes.select(*same, F.col("least.doc_id").alias("rep"), "least.keys", "least.sketch", "least.band"), "shingle-classes")
    able = classes.filter("keys IS NOT NULL").select("rep", F.col("n_shingles").alias("n"), "keys", "sketch", "band")
    members = members_of(able.select(F.explode("keys").alias("key"), "rep", "n", "band").withColumn("own", F.col("key").bitwiseAND(1) == F.col("band").bitwiseAND(1)))
    groups = linked_classes(able, members, docs, shingle_sets, THRESHOLD)
    return components_of(rows, classes, groups, same)


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component; documents without shingles and without doc_id stay.

    Repeated rows of the document that stays are all kept: they are one document's rows, not documents of a group.
    """
    losers = similar_components(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(written(losers, "shingle-losers"), "doc_id", "left_anti").select(*docs.columns)
