"""Edit-aware token counts: a segment tree over pre-tokens per document, re-encoded only around edits.

A leaf covers ``LEAF`` consecutive pre-tokens and holds their characters and tokens; inner nodes are sums in heap order.
An edit touches the leaves it overlaps; one leaf of context before it and as many after it as it takes for the new
split to meet an old leaf border are encoded anew, everything else keeps its counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import bounded_batches, free_name
from curalake.llm.tokens import _SHORT, PreTokenEncoder, encoder, vocabulary_path

LEAF = 64
TREE_DDL = "chars array<int>, sums array<bigint>"
EDITS_DDL = "array<struct<start:int,stop:int,text:string>>"
COUNTS_DDL = "n_tokens bigint, n_tokens_after bigint, n_edits bigint, n_leaves bigint, n_encoded bigint"

#: Personal data that the production query takes out: mail addresses and telephone-like digit groups.
PRIVATE = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\+?\d[\d ()-]{6,}\d")
INSTEAD = "[private]"


def tree_sums(leaves: Sequence[int]) -> list[int]:
    """Heap-ordered sums over leaves padded with zeros to a power of two; the total comes first."""
    width = 1 << max(0, len(leaves) - 1).bit_length()
    level = np.zeros(width, dtype=np.int64)
    level[: len(leaves)] = leaves
    levels = [level]
    while len(level) > 1:
        level = level[0::2] + level[1::2]
        levels.append(level)
    return np.concatenate(levels[::-1]).tolist()


def build_tree(coder: PreTokenEncoder, text: str | None) -> tuple[list[int], list[int]]:
    """Leaf lengths in code points and the tree's sums. A text that the pattern cannot split is one leaf."""
    if not text:
        return [], [0]
    if not coder.plain(text):
        return [len(text)], [coder.count(text)]
    pieces = coder.split(text)
    starts = np.arange(0, len(pieces), LEAF)
    chars = np.add.reduceat(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)), starts)
    return chars.tolist(), tree_sums(np.add.reduceat(np.array(coder.counts(pieces), dtype=np.int64), starts))


def build_trees(coder: PreTokenEncoder, texts: Sequence[str | None]) -> list[tuple[list[int], list[int]]]:
    """``build_tree`` of many texts; those that can be split together are."""
    together = [i for i, t in enumerate(texts) if t and coder.plain(t) and not ("'" in t and _SHORT.search(t))]
    out = dict.fromkeys(range(len(texts)))
    for chunk in coder.chunks(texts, together):
        _, lengths, _, size, bounds = coder.encode_plain([texts[i] for i in chunk])
        for k, i in enumerate(chunk):
            a, b = int(bounds[k]), int(bounds[k + 1])
            starts = np.arange(0, b - a, LEAF)
            out[i] = np.add.reduceat(lengths[a:b], starts).tolist(), tree_sums(np.add.reduceat(size[a:b], starts))
    return [out[i] or build_tree(coder, texts[i]) for i in range(len(texts))]


def leaf_counts(sums: Sequence[int], leaves: int) -> np.ndarray:
    return np.asarray(sums, dtype=np.int64)[len(sums) // 2 :][:leaves]


def apply_edits(coder: PreTokenEncoder, text: str | None, chars: Sequence[int], sums: Sequence[int],
                edits: Sequence[tuple[int, int, str]]) -> tuple[str, list[int], list[int], int]:
    """(new text, new leaf lengths, new sums, code points encoded) after ordered edits that do not overlap."""
    text = text or ""
    if not edits:
        return text, list(chars), list(sums), 0
    counts = leaf_counts(sums, len(chars))
    borders = np.concatenate([[0], np.cumsum(chars)]) if len(chars) else np.zeros(1, dtype=np.int64)
    new_text, shifts, at = [], [], 0
    for start, stop, instead in edits:
        new_text += [text[at:start], instead]
        at = stop
    new = "".join([*new_text, text[at:]])
    if not coder.plain(new) or not coder.plain(text) or not len(chars):
        fresh = build_tree(coder, new)
        return new, *fresh, len(new)
    # one leaf of context before the first touched leaf of each edit
    delta, out_chars, out_counts, encoded, leaf, i = 0, [], [], 0, 0, 0
    n = len(chars)
    while i < len(edits):
        first = max(leaf, int(np.searchsorted(borders, edits[i][0], side="right")) - 2)
        out_chars += list(chars[leaf:first])
        out_counts += counts[leaf:first].tolist()
        begin = int(borders[first]) + delta
        last = first  # leaves before ``last`` are encoded anew
        while True:
            while i < len(edits) and (last < n and edits[i][0] <= borders[last] or last == n or not last > first):
                start, stop, instead = edits[i]
                delta += len(instead) - (stop - start)
                last = max(last, min(n, int(np.searchsorted(borders, stop, side="right")) + 1))
                i += 1
            end = int(borders[last]) + delta
            region = new[begin : end if last == n else end + 2]
            pieces = coder.split(new[begin:end])
            # the border holds if the split of the region with what follows has a pre-token border there, too
            if last == n or _border(coder, region, end - begin):
                break
            last += 1
        starts = np.arange(0, len(pieces), LEAF)
        if len(pieces):
            out_chars += np.add.reduceat(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)), starts).tolist()
            out_counts += np.add.reduceat(np.array(coder.counts(pieces), dtype=np.int64), starts).tolist()
        encoded += end - begin
        leaf = last
    out_chars += list(chars[leaf:])
    out_counts += counts[leaf:].tolist()
    return new, out_chars, tree_sums(out_counts), encoded


def _border(coder: PreTokenEncoder, region: str, at: int) -> bool:
    """Whether a pre-token of ``region``, which goes on a little behind ``at``, ends at ``at``."""
    end = 0
    for piece in coder.split(region):
        end += len(piece)
        if end >= at:
            return end == at
    return end == at


def find_private(text: str | None) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), INSTEAD) for m in PRIVATE.finditer(text)] if text else []


def with_trees(docs: DataFrame, path: str | None = None, name: str = "tree") -> DataFrame:
    """``docs`` with a struct ``name`` (leaf lengths, sums), the form in which trees are kept between edits."""
    bounded_batches(docs.sparkSession)
    path = path or vocabulary_path()

    @F.pandas_udf(TREE_DDL)
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for texts in batches:
            yield pd.DataFrame(build_trees(coder, texts.tolist()), columns=["chars", "sums"])

    return docs.withColumn(name, build(F.col("text").cast("string")))


def private_edits(docs: DataFrame, name: str = "edits") -> DataFrame:
    """``docs`` with an array ``name`` of edits (start, stop, text in code points) that blank out personal data."""

    @F.pandas_udf(EDITS_DDL)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start": a, "stop": b, "text": t} for a, b, t in find_private(x)] for x in texts.tolist()])

    return docs.withColumn(name, find(F.col("text").cast("string")))


def recount(docs: DataFrame, tree: str = "tree", edits: str = "edits", path: str | None = None, name: str = "counts") -> DataFrame:
    """Adds struct ``name``: tokens before and after the edits, edits, leaves of the new tree, code points encoded again.

    ``edits`` must be ordered and must not overlap; null means none.
    """
    path = path or vocabulary_path()

    @F.pandas_udf(COUNTS_DDL)
    def update(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for texts, trees, changes in batches:
            rows = []
            for text, chars, sums, own in zip(texts.tolist(), trees["chars"], trees["sums"], changes, strict=True):
                own = [(e["start"], e["stop"], e["text"]) for e in own] if own is not None else []
                _, leaves, after, encoded = apply_edits(coder, text, list(chars), list(sums), own)
                rows.append((int(sums[0]), after[0], len(own), len(leaves), encoded))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTS_DDL.split(", ")])

    return docs.withColumn(name, update(F.col("text").cast("string"), F.col(tree), F.col(edits)))


def edited_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, tokens before and after personal data is taken out, and what had to be encoded.

    A null or empty text has no leaf and no token. Repeated rows give repeated results; other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    tree, edits, counts = (free_name(rows, x) for x in ("tree", "edits", "counts"))
    return recount(private_edits(with_trees(rows, path, tree), edits), tree, edits, path, counts).select("doc_id", f"{counts}.*")
