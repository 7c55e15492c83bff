"""Removal of repeated line runs: a suffix array over line ids by distributed prefix doubling.

Lines without a word are no part of the sequence. Level k names every window of 2**k consecutive lines that occurs
at least twice by the place of its first copy; a pair of names at distance 2**k is the key of level k + 1. Suffixes
with one name at level k are one interval of the suffix array with a common prefix of 2**k lines or more.

Deleted is, from every place, the longest common prefix with any earlier place if it has ``min_words`` words. Such a
run is the union of its least windows: for each of its lines the fewest lines from it on, or the fewest up to it, with
``min_words`` words. Each least window of a run has an earlier copy, as the run has; and one with an earlier copy is a
run itself. So it is enough to find the least windows that occur earlier, whichever copies their runs have. Two
overlapping windows of a level name a least window, and its first copy is the earliest place of that name.

A least window has at most ``min_words`` lines, so the number of levels is fixed. No group is gathered: intervals are
only counted and their first place taken. What is gathered is per document and bounded by its own lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalake.llm.common import bounded_batches, free_name, written

MIN_WORDS = 50
WHITE = " \t\n\r\x0b\x0c"
#: Stands for a null doc_id in places; nulls come first in the order of documents.
NO_ID = -(1 << 63)

LINES_DDL = "h1 array<bigint>, h2 array<bigint>, least array<array<int>>, line_no array<int>"


def line_features(text: str | None, min_words: int = MIN_WORDS) -> tuple[list[int], list[int], list[list[int]], list[int]]:
    """Of each line with a word: two halves of a 128-bit hash of the stripped line, lines of the least windows from it on, line number."""
    if not text:
        return [], [], [], []
    numbers, words, first, second = [], [], [], []
    for number, line in enumerate(text.split("\n")):
        if line := line.strip(WHITE):
            data = line.encode("utf-8", "surrogatepass")
            digest = xxhash.xxh3_128_intdigest(data)
            numbers.append(number)
            words.append(len(data.split()))
            first.append((digest >> 64) - (1 << 63))
            second.append((digest & ((1 << 64) - 1)) - (1 << 63))
    upto = np.append(0, np.cumsum(np.array(words, dtype=np.int64)))
    least: list[list[int]] = [[] for _ in words]
    for start, end in enumerate(np.searchsorted(upto, upto[:-1] + min_words).tolist()):
        if end < len(upto):
            least[start].append(end - start)
    for end, start in enumerate((np.searchsorted(upto, upto[1:] - min_words, side="right") - 1).tolist(), 1):
        if start >= 0 and end - start not in least[start][:1]:  # lengths from one line on differ but for the first
            least[start].append(end - start)
    return first, second, least, numbers


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(LINES_DDL)
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([line_features(t, min_words) for t in texts.tolist()], columns=["h1", "h2", "least", "line_no"])

    rows = docs.select(_id(F.col("doc_id")).alias("did"), _hash(F.col("text")).alias("th"), features(F.col("text").cast("string")).alias("x"))
    return written(rows.select("did", "th", "x.*").filter(F.size("h1") > 0).dropDuplicates(["did", "th"]), "lines")


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(NO_ID))


def _hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur at least twice, with the first place of the keys as name ``m``."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "th", "idx")).alias("m")).filter("n > 1").drop("n")
    return rows.join(groups, keys).select("did", "th", "idx", "least", "m")


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``did, th, idx, n``: least windows, of ``n`` lines from ``idx`` on, that occur at an earlier place too."""
    rows = lines.select("did", "th", F.posexplode(F.arrays_zip("h1", "h2", "least")).alias("idx", "x")).select("did", "th", "idx", "x.*")
    level = written(_named(rows, ["h1", "h2"]), "windows")
    found, k = [], 0
    while True:
        size = 1 << k
        inside = W.partitionBy("did", "th").orderBy("idx")
        # the second window ends with the least window; two of one size overlap or touch
        own = level.select("did", "th", "idx", "m", F.explode(F.filter("least", lambda n: (n >= size) & (n < 2 * size))).alias("n"))  # noqa: B023
        ends = level.select("did", "th", F.col("idx").alias("at"), F.col("m").alias("m2"))
        whole = own.withColumn("at", F.col("idx") + F.col("n") - size).join(ends, ["did", "th", "at"]).select("did", "th", "idx", "n", "m", "m2")
        firsts = whole.groupBy("n", "m", "m2").agg(F.min(F.struct("did", "th", "idx")).alias("first"))
        later = whole.join(firsts, ["n", "m", "m2"]).filter(F.struct("did", "th", "idx") > F.col("first"))
        found.append(later.select("did", "th", "idx", "n"))
        if 2 * size > min_words:
            break
        pairs = level.withColumn("m2", F.first("m").over(inside.rangeBetween(size, size))).filter("m2 IS NOT NULL").withColumnRenamed("m", "m1")
        level = written(_named(pairs, ["m1", "m2"]), "windows")
        k += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``did, th, gone, n_lines``: per document text that has later copies of runs, their line numbers in it and its lines with a word."""
    lines = _lines(docs, min_words)
    copies = later_copies(lines, min_words).groupBy("did", "th").agg(F.collect_list("idx").alias("starts"), F.collect_list("n").alias("lengths"))

    @F.pandas_udf("array<int>")
    def covered(starts: pd.Series, lengths: pd.Series, line_no: pd.Series) -> pd.Series:
        return pd.Series([numbers[run_cover(s, n, len(numbers))] for s, n, numbers in zip(starts, lengths, line_no, strict=True)])

    met = copies.join(lines.select("did", "th", "line_no"), ["did", "th"])
    return met.select("did", "th", F.size("line_no").alias("n_lines"), covered("starts", "lengths", "line_no").alias("gone"))


def run_cover(starts: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
    """Indexes, below ``total``, of lines inside any of the windows."""
    change = np.bincount(starts, minlength=total + 1) - np.bincount(np.asarray(starts) + np.asarray(lengths), minlength=total + 1)
    return np.flatnonzero(np.cumsum(change)[:total])


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "n_removed", total: str = "n_lines") -> DataFrame:
    """``docs`` with later copies of repeated line runs cut out of ``text``.

    A run is the longest that begins at a line and occurs earlier, and counts if it holds ``min_words`` words. The earliest copy, by doc_id and then by line, stays;
    a run may repeat within one document. Adds ``removed`` and ``total``, lines with a word gone and before (null text:
    0). A null doc_id comes before all others. Rows with equal doc_id and text are one place, so repeated rows are cut alike.
    Lines without a word stay.
    """
    did, th, gone = (free_name(docs, x) for x in ("_did", "_th", "_gone"))
    cuts = repeated_lines(docs, min_words).select(F.col("did").alias(did), F.col("th").alias(th), F.col("gone").alias(gone), F.col("n_lines").alias(total))
    keyed = docs.withColumns({did: _id(F.col("doc_id")), th: _hash(F.col("text"))})
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone, i)), "\n")
    cut = keyed.join(cuts, [did, th], "left")
    columns = [F.when(F.col(gone).isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    with_word = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"(?:\A|(?<=\n))[^\n]*?[^\n \t\r\x0b\f]")), F.lit(0))
    n = F.when(F.col(gone).isNull(), with_word).otherwise(F.col(total)).cast("bigint").alias(total)
    return cut.select(*columns, F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(removed), n)
