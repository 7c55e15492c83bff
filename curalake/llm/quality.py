"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, then a joined filter.

A sketch is a histogram whose bins keep the six leading bits of an integer measure (relative error below 1/32).
Adding bin counts merges sketches exactly and in any order, so results do not depend on partitions, retries or
partial aggregation. A (language, source) with fewer than ``min_group`` documents takes the merged sketch of its
language, and that of all documents if the language is small too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalake.llm.common import attach, bounded_batches, free_name, null_key, written

WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DDL = ", ".join(f"{c} bigint" for c in (*BASE, "n_lines"))

#: measure -> (numerator, denominator, factor, sides, least distance of a fence, counts of one event)
#: A fence follows the group's own quantiles. The least distance is one per cent for shares (three for repeats, one
#: window in 200 words) and 0.1 characters for word lengths, and never less than a bin; one repeated line or window passes.
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 1000, "upper", 10, 1),
    "word_length": ("word_chars", "n_words", 100, "both", 10, 0),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, "upper", 10, 1),
    "repeats": ("n_repeat_words", "n_words", 1000, "upper", 30, 6),
}
SPREADS = 3
#: Quantiles a fence starts from, from the inner one outwards: up to a quarter of a group may be junk on either side.
UPPER, LOWER = (75, 90, 95), (25, 10, 5)
MIN_GROUP = 200
MIN_WORDS = 50


def text_measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The base counts of one text and its lines with a word; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * len(seen) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(window), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : len(window) + shift] |= hit
    return int(covered.sum())


def measure(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the struct ``name`` of base counts of the whole text."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(DDL)
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(np.array([text_measures(t) for t in texts.tolist()], dtype=np.int64).reshape(-1, 6), columns=[*BASE, "n_lines"])

    return docs.withColumn(name, measures(F.col("text").cast("string")))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _value(m: Column, measure_name: str) -> Column:
    top, bottom, factor, *_ = MEASURES[measure_name]
    return F.floor(m[top] * factor / F.greatest(m[bottom], F.lit(1))).cast("bigint")


def _bin(value: Column) -> Column:
    """Lowest value of the bin: all but the six leading bits cleared."""
    width = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    step = F.pow(F.lit(2.0), width).cast("bigint")
    return value - F.pmod(value, step)


def _fence(quantiles: dict[int, Column], outwards: tuple[int, ...], least: int) -> Column:
    """``SPREADS`` times an outer quantile's distance from the median beyond that quantile.

    The next outer quantile counts only if it lies within the fence of the one before; otherwise it is junk's.
    """
    sign = 1 if outwards[0] > 50 else -1

    def fence(at: Column) -> Column:
        return at + sign * F.greatest(SPREADS * F.abs(at - quantiles[50]), F.lit(least), F.shiftright(at, 5) + 1)

    at = quantiles[outwards[0]]
    for pct in outwards[1:]:
        at = F.when(sign * (quantiles[pct] - fence(at)) <= 0, quantiles[pct]).otherwise(at)
    return fence(at)


def thresholds(measured: DataFrame, name: str, min_group: int = MIN_GROUP) -> DataFrame:
    """``lang_key, source_key`` and a lower and an upper fence per measure, from sketches over all rows that pass the base rules."""
    m = F.col(name)
    rows = measured.select(
        null_key(F.col("lang")).alias("lang_key"), null_key(F.col("source")).alias("source_key"), base_failed(m).alias("failed"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _bin(_value(m, k)).alias("bin")) for k in MEASURES])).alias("x"),
    )
    cells = rows.groupBy("lang_key", "source_key", "x.measure", "x.bin").agg(F.sum(F.when(F.col("failed"), 0).otherwise(1)).alias("n"))
    cells = written(cells, "quality-sketch")
    levels = (
        cells.select(F.struct(F.lit(0).alias("level"), "lang_key", "source_key").alias("g"), "measure", "bin", "n")
        .unionByName(cells.select(F.struct(F.lit(1).alias("level"), "lang_key", F.lit("").alias("source_key")).alias("g"), "measure", "bin", "n"))
        .unionByName(cells.select(F.struct(F.lit(2).alias("level"), F.lit("").alias("lang_key"), F.lit("").alias("source_key")).alias("g"), "measure", "bin", "n"))
        .groupBy("g", "measure", "bin").agg(F.sum("n").alias("n"))
    )
    inside = W.partitionBy("g", "measure")
    ranked = levels.withColumns({"upto": F.sum("n").over(inside.orderBy("bin")), "total": F.sum("n").over(inside)})
    quantile = lambda pct: F.min(F.when((F.col("upto") * 100 >= F.col("total") * pct) & (F.col("upto") > 0), F.col("bin")))
    levels_of = sorted({50, *UPPER, *LOWER})
    fences = ranked.groupBy("g", "measure").agg(F.max("total").alias("total"), *[quantile(pct).alias(f"q{pct}") for pct in levels_of])
    quantiles = {pct: F.col(f"q{pct}") for pct in levels_of}
    columns = []
    for k, (_, _, _, sides, least, _) in MEASURES.items():
        upper = _fence(quantiles, UPPER, least)
        lower = _fence(quantiles, LOWER, least) if sides == "both" else F.lit(-1)
        for side, value in (("upper", upper), ("lower", lower)):
            columns.append(F.max(F.when(F.col("measure") == k, value)).cast("bigint").alias(f"{k}_{side}"))
    table = fences.groupBy("g").agg(F.max("total").alias("total"), F.struct(*columns).alias("fence"))
    own = table.filter("g.level = 0").select("g.lang_key", "g.source_key", F.col("total").alias("n0"), F.col("fence").alias("f0"))
    lang = table.filter("g.level = 1").select("g.lang_key", F.col("total").alias("n1"), F.col("fence").alias("f1"))
    every = table.filter("g.level = 2").select(F.lit(1).alias("one"), F.col("fence").alias("f2"))
    return (
        own.join(lang, "lang_key").withColumn("one", F.lit(1)).join(every, "one")
        .select("lang_key", "source_key", F.when(F.col("n0") >= min_group, F.col("f0")).when(F.col("n1") >= min_group, F.col("f1")).otherwise(F.col("f2")).alias("fence"))
        .select("lang_key", "source_key", "fence.*")
    )


def judge(measured: DataFrame, name: str, table: DataFrame, verdict: str) -> DataFrame:
    """Adds boolean ``verdict``: base rules passed and every measure within the fences of its language and source."""
    keyed = measured.withColumns({"lang_key": null_key(F.col("lang")), "source_key": null_key(F.col("source"))})
    joined = attach(keyed, table, ["lang_key", "source_key"], F.struct(*[c for c in ("doc_id", "n_chars") if c in measured.columns], F.col(f"{name}.n_words")))
    m = F.col(name)
    ok = ~base_failed(m)
    for k, (top, _, _, sides, _, event) in MEASURES.items():
        # a fence is null only where no document passed the base rules
        within = _value(m, k).between(F.col(f"{k}_lower"), F.col(f"{k}_upper"))
        ok = ok & F.coalesce(within | (m[top] <= event) if sides == "upper" else within, F.lit(False))
    return joined.withColumn(verdict, F.coalesce(ok, F.lit(False))).select(*measured.columns, verdict)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, ``base_failed`` and ``kept``. Texts are read once.

    Null or blank texts have no words and fail. Repeated rows are judged alike, one result each. Null languages
    and sources form groups of their own. Columns other than doc_id, text, lang and source are not read.
    """
    measured = written(measure(docs.select("doc_id", "text", "lang", "source"), "m").drop("text"), "quality-measures")
    judged = judge(measured, "m", written(thresholds(measured, "m"), "quality-fences"), "kept")
    return judged.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in BASE], base_failed(F.col("m")).alias("base_failed"), "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only.

    Texts are measured twice: once for the sketches, once with the fences at hand, so that no text is shuffled.
    """
    name = free_name(docs, "_measures")
    narrow = measure(docs.select("text", "lang", "source"), name).drop("text")
    table = written(thresholds(narrow, name), "quality-fences")
    clash = [c for c in docs.columns if c.lower() in {x.lower() for x in (*table.columns, "lang_key", "source_key")}]
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", "source", *[c for c in ("doc_id",) if c in docs.columns]) if clash else docs
    verdict = free_name(packed, "_kept")
    kept = judge(measure(packed, name), name, table, verdict).filter(F.col(verdict))
    return kept.select("_row.*") if clash else kept.select(*docs.columns)
