"""Shingle join, line dedup and components against brute force."""

import random

import numpy as np
import pytest

from curalake.llm import common, components, linedup, pairs, shingles
from llm import brute

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def corpus(seed, n=160):
    """Unrelated texts, near copies around the threshold, exact copies, a passage that many share, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    out = []
    bases = [[word() for _ in range(rng.choice([4, 6, 12, 30, 80, 200, 900]))] for _ in range(12)]
    for _ in range(n):
        kind = rng.random()
        words = list(rng.choice(bases))
        if kind < 0.6:
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.3:
                words = words[: int(len(words) * rng.uniform(0.7, 1))]
        elif kind < 0.8:
            words = [word() for _ in range(rng.randint(20, 120))] + passage.split()
        else:
            words = [word() for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.2:
            words = [w.upper() for w in words]
        out.append(rng.choice([" ", "  ", "\t", "\n"]).join(words))
    return list(enumerate([*out, None, "", " \n ", "é É", "é é", "one", "ONE", "a b c d", "x" * 50_000]))


def templates(seed, n=150, length=120, first=0):
    """Many texts near the threshold in one key: a base with up to 7 % of its words changed, and copies of copies that link."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(length)]
    rows = []
    for i in range(n):
        words = list(rng.choice(rows)[1].split() if rows and rng.random() < 0.3 else base)
        for _ in range(rng.randint(length // 60, length * 9 // 120)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((first + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    found = {r[0]: (r[1], r[2]) for r in shingles.similar_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()}
    assert found == brute.components(rows)


@pytest.mark.parametrize("exact", [False, True])
def test_groups_of_variants_lose_no_link(spark, exact):
    """Production constants: large keys, similarities on both sides of the threshold, short and long texts."""
    rows = templates(4, 60) + templates(5, 60, 500, 1000)
    found = {r[0]: r[2] for r in shingles.similar_components(frame(spark, rows), exact).select("doc_id", "n_shingles", "component_id").collect()}
    assert found == {i: c for i, (_, c) in brute.components(rows).items()}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for n in (5, 40, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.union1d(a[: int(n * 0.9)], rng.integers(0, 1 << 63, max(1, n // 20)).astype(np.uint64))
        distance = sum(int(x).bit_count() for x in (pairs.parity_bits(a) ^ pairs.parity_bits(b)).view(np.uint64))
        assert distance <= len(np.setxor1d(a, b))
        assert set(shingles.cell_keys(a, shingles.band(len(a)))) & set(shingles.cell_keys(b, shingles.band(len(a))))


def test_pairs_at_the_threshold_share_a_key():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(3000):
        n = int(rng.choice([3, 4, 6, 9, 15, 40, 100, 400]))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.union1d(a, rng.integers(0, 1 << 63, len(a) // 3).astype(np.uint64))  # the largest difference there is
        missed += not set(shingles.cell_keys(a, shingles.band(len(a)))) & set(shingles.cell_keys(b, shingles.band(len(a))))
    assert missed == 0


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(7, text), (7, text), (3, text), (None, text), (None, None)]
    found = sorted(map(tuple, shingles.similar_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert found == sorted([(7, 26, 3), (7, 26, 3), (3, 26, 3), (None, 26, None), (None, 0, None)], key=repr)
    assert sorted(r[0] or -1 for r in shingles.keep_one(frame(spark, rows)).collect()) == [-1, -1, 3]
    empty = frame(spark, [])
    assert shingles.similar_components(empty).count() == 0 and shingles.keep_one(empty).count() == 0
    extra = frame(spark, rows).selectExpr("*", "1 AS component_id", "2 AS n", "3 AS key")
    assert shingles.keep_one(extra).columns == extra.columns and shingles.keep_one(extra).count() == 3


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def line_corpus(seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op"]) + str(rng.randint(0, 30)) for _ in range(n))
    runs = [[line(rng.choice([3, 10, 20, 55])) for _ in range(rng.randint(1, 14))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            run = rng.choice(runs)
            a = rng.randrange(len(run))
            parts += rng.choice([[line(rng.randint(1, 60))], run, run[a:], run[: a + 1], ["", "  "], [run[a]] * 3, ["hot line"] * 4])
        rows.append((i, "\n".join(parts)))
    return [*rows, (60, None), (61, ""), (62, "\n\n"), (63, line(80) + "\n"), (64, "\r\n".join(runs[0]))]


def test_line_runs_follow_the_longest_earlier_copy(spark):
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    p, q, r = line("p", 60), line("q", 10), line("r", 20)
    rows = [(1, f"{p}\n{line('x', 5)}"), (2, f"{p}\n{q}\n{r}"), (3, f"{p}\n{q}\n{r}\n{line('y', 5)}")]
    found = {i["doc_id"]: i["text"] for i in linedup.drop_repeated_runs(frame(spark, rows)).collect()}
    assert found == {1: rows[0][1], 2: f"{q}\n{r}", 3: line("y", 5)} == brute.without_longest_runs(rows)


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5])
def test_line_runs_equal_all_earlier_places(spark, seed):
    rows = line_corpus(seed)
    found = {r["doc_id"]: r["text"] for r in linedup.drop_repeated_runs(frame(spark, rows)).collect()}
    assert found == brute.without_longest_runs(rows)


def test_line_runs_of_repeated_rows_and_odd_tables(spark):
    run = " ".join(f"w{k}" for k in range(60))
    rows = [(2, run), (2, run), (1, f"a\n{run}\nb"), (None, f"{run}\nx"), (5, f"{run}\n{run}")]
    found = sorted(((r["doc_id"], r["text"], r["n_removed"], r["n_lines"]) for r in linedup.drop_repeated_runs(frame(spark, rows)).collect()), key=repr)
    assert found == sorted([(2, "", 1, 1), (2, "", 1, 1), (1, "a\nb", 1, 3), (None, f"{run}\nx", 0, 2), (5, "", 2, 2)], key=repr)
    assert linedup.drop_repeated_runs(frame(spark, [])).count() == 0
    extra = frame(spark, rows).selectExpr("*", "1 AS did", "2 AS th", "3 AS gone", "4 AS idx")
    assert linedup.drop_repeated_runs(extra).columns == [*extra.columns, "n_removed", "n_lines"]


def test_common_shares_count_the_classes_that_are_compared(spark):
    from curalake.llm import pairs

    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 5]), (3, [4, 5, 6, 7])], "rep bigint, s array<bigint>")
    placed = spark.createDataFrame([(9, 1, 4), (9, 2, 4), (8, 1, 4)], "key bigint, rep bigint, n bigint")
    found = pairs.common_share(placed, sets, pairs.Threshold(75))
    assert sorted((r["rep"], r["n"], r["common"]) for r in found.collect()) == [(1, 4, 3), (2, 4, 3)]


def test_joins_of_large_keys_have_a_row_per_class(spark, monkeypatch):
    """Many keys in common must not multiply the rows that are joined with what is known of a class."""
    tokens = {r: np.arange(20) + (r > 8) for r in range(1, 17)}
    sets = spark.createDataFrame([(r, t.tolist()) for r, t in tokens.items()], "rep bigint, s array<bigint>")
    classes = spark.createDataFrame([(r, 20, pairs.parity_bits(t.astype(np.uint64)).tolist()) for r, t in tokens.items()], "rep bigint, n bigint, sketch array<bigint>")
    placed = spark.createDataFrame([(k, r, 20, 1 if r < 14 else r) for k in range(10) for r in tokens], "key bigint, rep bigint, n bigint, g bigint")
    kept, joined = type(placed).join, []

    def join(self, other, on=None, how=None):
        out = kept(self, other, on, how)
        if on == ["rep", "n"]:
            joined.append(out.count())
        return out

    monkeypatch.setattr(type(placed), "join", join)
    found = {(r["a"], r["b"]) for r in pairs.across(placed, sets, classes, pairs.Threshold(75)).collect()}
    assert found == {(a, b) for a in tokens for b in (14, 15, 16) if a < b}
    assert joined and max(joined) <= len(tokens)


def test_rounds_of_few_stars_write_one_file(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a bigint, b bigint")
    kept, files = components.written, []

    def written(df, name):
        out = kept(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "written", written)
    with common.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        assert {r["component"] for r in components.components(edges).collect()} == {0}
    assert len(files) > 2 and set(files[1:]) == {1}
