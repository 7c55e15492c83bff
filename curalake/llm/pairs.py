"""From table keys to links: candidate pairs of shingle sets, exact bounds, verification, and keys that many sets share.

A class stands for all documents with one shingle set: ``rep`` (its smallest doc_id), ``n`` (size of the set) and
``sketch`` (parity sketch). ``members`` has a row per key and class that share it: ``key, rep, n, prev, c``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalake.llm.common import BLOOM, rows_of, settings, written
from curalake.llm.components import components

SKETCH_BITS = 1024
#: Classes up to which a key is compared in full.
SMALL_KEY = 12
#: Keys of a class, the least ones, by which repeats of a pair are told.
FIRST_KEYS = 8


@dataclass(frozen=True)
class Threshold:
    """Sets link if ``denominator`` times their intersection is at least ``numerator`` times their union."""

    numerator: int
    denominator: int = 100

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.denominator >= F.greatest(a, b) * self.numerator

    def shared_fits(self, shared: Column, total: Column) -> Column:
        """Whether sets of this total size link if they share so many."""
        return shared * (self.denominator + self.numerator) >= total * self.numerator

    def sketches_fit(self, a: Column, b: Column, total: Column) -> Column:
        """Hamming distance within the largest symmetric difference of linked sets of this total size."""
        distance = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))
        return distance * (self.denominator + self.numerator) <= total * (self.denominator - self.numerator)


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """The parity sketch as 64-bit words; its Hamming distance is at most the symmetric difference."""
    odd = np.bincount((tokens >> np.uint64(20)) & np.uint64(SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def members_of(rows: DataFrame) -> DataFrame:
    """``key, rep, n, prev, c`` of every key that at least two of the rows ``key, rep, n, own`` share, with the class before in the
    chain (by size) and their number. A key that is no member's ``own`` is left out: its classes meet under their own keys too.
    Every class emits many keys, so one key holds a small share of the rows at most."""
    key, order = W.partitionBy("key"), W.partitionBy("key").orderBy("n", "rep")
    ranked = rows.select("key", "rep", "n", "own").withColumns({
        "prev": F.lag(F.struct("rep", "n")).over(order), "c": F.count(F.lit(1)).over(key), "_own": F.max("own").over(key),
    })
    return written(ranked.filter("c > 1 AND _own").select("key", "rep", "n", "prev", "c"), "pair-members")


def candidates(members: DataFrame, classes: DataFrame, threshold: Threshold) -> DataFrame:
    """``a, b, shared``: pairs of classes in a chain or a small key whose sizes and sketches fit, and in how many keys."""
    chain = members.filter((F.col("c") == 2) | (F.col("c") > SMALL_KEY)).filter("prev IS NOT NULL")
    chain = chain.select(F.col("prev.rep").alias("a"), F.col("prev.n").alias("n"), F.col("rep").alias("b"), F.col("n").alias("m"))
    small = members.filter((F.col("c") > 2) & (F.col("c") <= SMALL_KEY))
    full = small.select("key", F.col("rep").alias("a"), "n").join(small.select("key", F.col("rep").alias("b"), F.col("n").alias("m")), "key").filter("a < b")
    pairs = chain.unionByName(full.select("a", "n", "b", "m")).filter(threshold.sizes_fit(F.col("n"), F.col("m")) & (F.col("a") != F.col("b")))
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    left, right = (classes.select(F.col("rep").alias(i), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"s{i}")) for i in "ab")
    fits = threshold.sizes_fit(F.col("na"), F.col("nb")) & threshold.sketches_fit(F.col("sa"), F.col("sb"), F.col("na") + F.col("nb"))
    return written(pairs.join(left, "a").join(right, "b").filter(fits).groupBy("a", "b").agg(F.max("shared").alias("shared")), "pair-candidates")


def sets_of(ids: DataFrame, docs: DataFrame, shingle_sets) -> DataFrame:  # noqa: ANN001
    """``rep, s``: whole shingle sets of the documents in ``ids``, by one pass over the texts of which only theirs are moved.
    A repeated doc_id yields what its rows hold."""
    spark = docs.sparkSession

    @F.pandas_udf("array<bigint>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([s.view(np.int64) for s in shingle_sets(texts.tolist())])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = written(ids.select(F.col("rep").alias("doc_id")).distinct(), "pair-ids")
    with settings(spark, BLOOM):
        return written(rows_of(texts, keys, "doc_id").select(F.col("doc_id").alias("rep"), sets("text").alias("s")), "pair-sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """Those pairs ``a, b`` whose whole sets link. Only the sets of their documents are moved."""
    pairs = written(pairs.select("a", "b"), "pair-asked").filter((F.col("a") >= -(1 << 63)) & (F.col("b") >= -(1 << 63)))
    left, right = (sets.select(F.col("rep").alias(i), F.col("s").alias(f"s{i}")) for i in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    sized = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    with settings(pairs.sparkSession, BLOOM):
        return written(sized.filter(threshold.shared_fits(F.col("i"), F.col("t"))).select("a", "b").distinct(), "pair-links")


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are not connected yet."""
    for i in "ab":
        pairs = pairs.join(groups.select(F.col("node").alias(i), F.col("component").alias(f"g{i}")), i, "left").withColumn(f"g{i}", F.coalesce(f"g{i}", i))
    return pairs.filter("ga <> gb").select("a", "b")


def common_share(placed: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """``rep, n, common`` of the classes in ``placed``: how many shingles another class in ``placed`` holds too. No pair of them
    can share more. Classes that cannot reach the threshold with so few are left out. Only the sets of placed classes are moved."""
    spark = placed.sparkSession
    asked = written(placed.select("rep", "n").distinct(), "pair-ids")  # of known size, so a short list is broadcast and no set is moved
    with settings(spark, BLOOM):
        sets = rows_of(sets, asked, "rep")
        tokens = sets.select("rep", F.explode("s").alias("token"))
        alone = tokens.groupBy("token").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).filter("rep = last")
        single = sets.groupBy("rep").agg(F.count(F.lit(1)).alias("sets")).filter("sets = 1")  # a doc_id with several texts counts as all common
        lonely = alone.groupBy("rep").agg(F.count(F.lit(1)).alias("u")).join(single, "rep", "left_semi")
        shared = asked.join(lonely, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("common"))
        return written(shared.filter(F.col("common") * threshold.denominator >= F.col("n") * threshold.numerator), "pair-shares")


def mixed(placed: DataFrame) -> DataFrame:
    """The rows ``key, rep, n, g`` of keys whose members are in several components (``g``)."""
    key = W.partitionBy("key")
    return placed.withColumns({"_first": F.min("g").over(key), "_last": F.max("g").over(key)}).filter("_first < _last").drop("_first", "_last")


def across(placed: DataFrame, sets: DataFrame, classes: DataFrame, threshold: Threshold) -> DataFrame:
    """``a, b``: pairs of different components in a mixed key that may link. ``placed``: ``key, rep, n, g``; ``sets`` has theirs.

    What stays of a key is joined with what is outside its largest component; most repeats of a pair under further keys are left out.
    """
    # a class meets what is known of it once, with its keys as an array: no join has a row per key
    held = placed.groupBy("rep", "n", "g").agg(F.collect_set("key").alias("keys")).join(common_share(placed, sets, threshold), ["rep", "n"])
    # what left may leave a key to one component
    sized = mixed(held.select(F.explode("keys").alias("key"), "rep", "n", "g", "common")).withColumn("c", F.count(F.lit(1)).over(W.partitionBy("key", "g")))
    rest = sized.withColumn("top", F.max(F.struct("c", "g")).over(W.partitionBy("key"))["g"])
    cards = rest.groupBy("rep", "n", "g", "common").agg(F.sort_array(F.collect_list(F.struct("key", "top"))).alias("keys"))  # a class has few keys
    cards = written(cards.join(classes.select("rep", "n", "sketch"), ["rep", "n"]), "pair-cards")
    cards = cards.withColumn("firsts", F.slice("keys.key", 1, FIRST_KEYS)).select("*", F.explode("keys").alias("of")).select("*", "of.key", "of.top")
    side = lambda i: [F.col("rep").alias(i), *[F.col(c).alias(f"{c}{i}") for c in ("n", "g", "common", "sketch", "firsts")]]
    left, right = (rows.select("key", *side(i)) for rows, i in ((cards.filter("g <> top"), "a"), (cards, "b")))
    total = F.col("na") + F.col("nb")
    fits = (
        threshold.sizes_fit(F.col("na"), F.col("nb")) & threshold.shared_fits(F.least("commona", "commonb"), total)
        & threshold.sketches_fit(F.col("sketcha"), F.col("sketchb"), total)
    )
    # what two classes share among their first keys makes all later keys of the pair repeats; its least common key always stays
    fresh = F.coalesce(F.array_min(F.array_intersect("firstsa", "firstsb")), F.col("key")) >= F.col("key")
    pairs = left.join(right, "key").filter((F.col("ga") != F.col("gb")) & F.when(fits, fresh).otherwise(F.lit(False)))
    return written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pair-candidates")


def linked_classes(classes: DataFrame, members: DataFrame, docs: DataFrame, shingle_sets, threshold: Threshold) -> DataFrame:  # noqa: ANN001
    """``node, component`` of the classes (``rep, n, sketch``) that link with another one; ``docs`` has their texts.

    The pair that shares most keys is verified first for each class, then the pairs whose ends are still apart. A large key
    whose members are in several components afterwards holds documents that share a template: those of which too much is
    found in no other of them leave, and what stays outside its largest component is compared with its other components by
    sizes, common shares and sketches, and verified. All tests are bounds, so no pair of a key that links is dropped.
    """
    pairs = candidates(members, classes, threshold)
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = sets_of(ids, docs, shingle_sets)
    edges = verified(pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")), sets, threshold)
    groups = written(components(edges), "pair-groups")
    more = verified(apart(pairs, groups), sets, threshold)
    if not more.isEmpty():
        groups = _joined(groups, more)
    large = members.filter(F.col("c") > SMALL_KEY).select("key", "rep", "n").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    placed = written(mixed(large.select("key", "rep", "n", F.coalesce("component", "rep").alias("g"))), "pair-mixed")
    others = written(placed.select("rep").distinct().join(ids, "rep", "left_anti"), "pair-ids")
    if not others.isEmpty():
        sets = sets.unionByName(sets_of(others, docs, shingle_sets))
    more = verified(across(placed, sets, classes, threshold), sets, threshold)
    return groups if more.isEmpty() else _joined(groups, more)


def _joined(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of what is grouped already and of further edges."""
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return written(components(stars.unionByName(edges.select("a", "b"))), "pair-groups")


def components_of(rows: DataFrame, classes: DataFrame, groups: DataFrame, same: Sequence[str]) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``rows`` (``doc_id, n_shingles`` and the columns ``same``).

    A row without doc_id or shingles stands alone. Rows of one doc_id with different texts join their components.
    """
    linked = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    named = linked.select("doc_id", *same).join(classes.select(*same, "rep"), list(same)).select("doc_id", "n_shingles", "rep")
    named = named.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    named = written(named, "pair-named")
    twice = named.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("z")).filter("a <> z")
    bridges = written(named.join(twice, "doc_id").select("a", F.col("component_id").alias("b")).filter("a <> b").distinct(), "pair-bridges")
    if not bridges.isEmpty():
        merged = components(bridges).select(F.col("node").alias("component_id"), F.col("component").alias("_joined"))
        named = named.join(merged, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("_joined", "component_id").alias("component_id"))
    alone = rows.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone)
