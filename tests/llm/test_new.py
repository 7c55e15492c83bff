"""Hard negatives, whitening and MinHash near duplicates against plain versions."""

import numpy as np
import pytest

from curalake.llm import minhash, negatives, whitening
from llm import brute
from llm.test_joins import corpus, frame, templates

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(seed, n=500, d=20, labels=4):
    """Clusters with close, equal and negative scores, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = [(i, [float(np.float32(c)) for c in 0.2 * (centres[i % 6] + 0.6 * rng.normal(size=d))], int(rng.integers(labels))) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 3) for i in range(30)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * d, 1), (1003, [None] + [1.0] * (d - 1), 1), (1004, rows[0][1], None), (1005, [1.0, 2.0], 1)]
    return [*rows, (1050, [2.0, 1.0], 1), (1006, [1.5, 1.0], 2), (1007, [0.0] * d, 0), (1100, [0.0] * d, 0), (None, rows[0][1], 1), rows[5], (1150, [float("inf")] * d, 0)]


@pytest.mark.parametrize(("seed", "shard_rows", "block_rows"), [(1, 5000, 500), (2, 40, 7), (3, 64, 500)])
def test_hard_negatives_equal_brute_force(spark, seed, shard_rows, block_rows):
    rows = vectors(seed)
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS x", "2 AS dim", "3 AS shard", "4 AS w")
    usable = negatives.usable_rows(table)
    out = negatives.hard_negatives(usable, usable.filter("vec_id % 10 = 0"), shard_rows=shard_rows, block_rows=block_rows)
    found = sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert found == brute.hard_negatives(rows, 10) and len(found) > 100


def test_hard_negatives_with_large_scores_and_empty_tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(c) for c in rng.integers(-(1 << 20), 1 << 20, 8)], i % 2) for i in range(80)]  # products beyond 2**53
    rows = [*rows, (90, rows[0][1], 0), (90, rows[1][1], 0), (91, [1e30] * 8, 0)]
    usable = negatives.usable_rows(spark.createDataFrame(rows, VECTORS))
    out = negatives.hard_negatives(usable, usable.filter("vec_id % 5 = 0"), shard_rows=30)
    found = sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert found == brute.hard_negatives(rows[:-1], 5) and found and max(r[4] for r in found) > 1 << 53
    empty = usable.limit(0)
    assert negatives.hard_negatives(empty, empty).count() == 0


def test_the_index_omits_rows_and_keeps_results():
    rng = np.random.default_rng(4)
    rows = np.floor(256 * rng.normal(size=(300, 24)) * rng.uniform(0.01, 1, size=(300, 1))).astype(np.int64)
    shard = negatives.Shard(rows, rows[:10])
    barred = np.zeros((10, 300), dtype=bool)
    exact = rows[:10] @ rows.T
    for t in (400_000.0, 50_000.0, 0.0, -1e9):
        a, r, score = shard.above(np.arange(10), np.full(10, t), barred)
        assert sorted(zip(a, r, score)) == sorted((i, j, exact[i, j]) for i, j in zip(*np.nonzero(exact >= t)))


@pytest.mark.parametrize("values", [
    [1 + 1e-9 * i for i in range(8)] + list(range(2, 18)), [1.0] * 12 + [2.0] * 12, [1 + 1e-13 * i for i in range(24)], [0.0] * 23 + [1.0], list(np.logspace(-10, 4, 24)),
])
def test_refinement_handles_clusters(values):
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(24, 24)))[0].astype(np.longdouble)
    a = q @ np.diag(np.array(values, dtype=np.longdouble)) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    assert list(found) == sorted(found, reverse=True)
    assert np.abs(found - np.sort(np.array(values))[::-1]).max() < 1e-14 * max(values) * 24
    assert np.abs(x.T @ x - np.eye(24)).max() < 1e-13
    assert np.abs(a @ x - x * found).max() < 1e-16 * max(values)
    single = np.linalg.eigh(a.astype(np.float32))
    assert np.abs(a @ single[1] - single[1] * single[0]).max() > 1e3 * np.abs(a @ x - x * found).max()


def whitened_by_numpy(rows, d):
    x = {i: [int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for i, v, *_ in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)}
    fit = np.unique(np.array(list(x.values())), axis=0)
    mean = fit.mean(axis=0)
    e, q = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    return x, fit, mean, e[::-1], q[:, ::-1]


def test_whitening_equals_numpy(spark):
    rows = [r for r in vectors(7, d=12) if r[0] is not None]
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS x", "2 AS n", "3 AS component").repartition(5)
    out = whitening.whitened(table).collect()
    x, fit, mean, e, q = whitened_by_numpy(rows, 12)
    assert len(out) == 4 * (len([r for r in rows if r[0] in x])) and {r["n"] for r in out} == {len(fit)}
    assert max(r["identity_error"] for r in out) < 1e-12
    sums = fit.sum(axis=0)
    for k in range(4):
        own = [r for r in out if r["component"] == k + 1]
        expected = np.array([(np.array(x[r["vec_id"]]) - mean) @ q[:, k] / np.sqrt(e[k]) for r in own])
        found = np.array([r["whitened"] for r in own])
        assert np.abs(found * np.sign(found @ expected) - expected).max() < 1e-10
        assert all(abs(r["explained"] - e[k] / e.sum()) < 1e-12 for r in own)
        assert all(r["deviation"] == sum((len(fit) * c - int(s)) ** 2 for c, s in zip(x[r["vec_id"]], sums)) for r in own)


def test_whitening_without_variance_and_of_odd_tables(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.0], 0), (None, [1.0, 2.0, 3.0], 0), (3, [5.0], 0), (4, None, 0)], VECTORS)
    out = whitening.whitened(one).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in out) == [
        (i, k, 1, 0, None, 0.0, None) for i in (0, 1, 2) for k in (1, 2, 3)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 0) for i in range(9)], VECTORS)
    out = whitening.whitened(line).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in out) and {round(r["explained"], 12) for r in out} == {0.0, 1.0}
    assert whitening.whitened(one.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e30, 1.0], 0), (2, [2.0**40, 1.0], 0), (3, [-(2.0**40), 0.5], 0)], VECTORS)
    out = whitening.whitened(huge).filter("component = 1").collect()
    assert {r["vec_id"] for r in out} == {2, 3} and {r["deviation"] for r in out} == {None} and all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_minhash_equals_brute_force(spark, seed):
    rows = corpus(seed)
    out = minhash.near_duplicates(frame(spark, rows).selectExpr("*", "1 AS rep", "2 AS n", "3 AS kept", "4 AS key")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute.components(rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("seed", [5, 6])
def test_large_mixed_keys_lose_no_link(spark, seed):
    rows = templates(seed)
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: c for i, (_, c) in brute.components(rows, 4, 80).items()}


def test_tensored_tables_find_pairs_at_the_threshold():
    """2 * (1 - s ** WIDE) ** COUNT is the chance to miss a pair."""
    assert 2 * (1 - 0.8**minhash.WIDE) ** minhash.COUNT < 2e-5
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(1000):
        shared = rng.integers(0, 1 << 63, 160).astype(np.uint64)
        a, b = (np.unique(np.append(shared, rng.integers(0, 1 << 63, 20).astype(np.uint64))) for _ in range(2))
        keys = minhash.half_keys(np.concatenate([a, b]), np.array([0, len(a)]))
        same = keys[0] == keys[1]
        missed += not (same[: minhash.COUNT].any() and same[minhash.COUNT :].any())
    assert missed == 0


def test_minhash_of_repeated_rows_and_odd_tables(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(7, text), (7, text), (3, text), (None, text), (None, None), (9, "other words"), (7, "other words"), (8, " \n"), (2, "x" * 200_000)]
    out = sorted((tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert out == sorted([
        (7, 27, 3, False), (7, 27, 3, False), (3, 27, 3, True), (None, 27, None, True), (None, 0, None, True), (9, 1, 3, False), (7, 1, 3, False), (8, 0, 8, True), (2, 1, 2, True),
    ], key=repr)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
