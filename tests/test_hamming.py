import random

import pytest
from conftest import rows

from curalake.operators import clusters
from curalake.operators import hamming as H
from curalake.operators.audit import audit_summary
from curalake.operators.violations import GateError
from curalake.plans import jobs

SPLITS = ["train", "validation", "test"]
DDL = "image_id string, perceptual_hash string, dataset_split string, class_name string"


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(12)]
    result = []
    for i in range(160):
        h = rnd.choice(base)
        for _ in range(rnd.randint(0, 7)):
            h ^= 1 << rnd.randrange(64)
        result.append((f"i{i:03d}", f"{h:016x}", rnd.choice(SPLITS), rnd.choice("nsdr")))
    # a third of the rows share one hash
    result += [(f"z{i:03d}", "0" * 16, rnd.choice(SPLITS), rnd.choice("nsdr")) for i in range(80)]
    return result


def brute(data, distance):
    for i, a in enumerate(data):
        for b in data[i + 1:]:
            d = (int(a[1], 16) ^ int(b[1], 16)).bit_count()
            if d <= distance:
                yield a, b, d


@pytest.mark.parametrize("distance,options", [(6, {}), (6, {"hot": 4}), (6, {"hot": 3, "spare": 1}), (11, {"hot": 8, "spare": 1}), (0, {})])
def test_edges_equal_the_pair_loop(spark, data, distance, options):
    df = spark.createDataFrame(data, DDL)
    pairs = list(brute(data, distance))
    expected = (len(pairs), sum(a[2] != b[2] for a, b, _ in pairs), sum(a[3] != b[3] for a, b, _ in pairs))
    edges = H.near_dup_edges(df, distance, **options)
    assert tuple(H.near_dup_totals(edges).first()) == expected


def test_large_buckets_are_compared_as_arrays(spark, monkeypatch):
    rnd = random.Random(3)
    hashes = sorted({rnd.getrandbits(9) | rnd.choice((0, 7 << 40, 1 << 63)) for _ in range(900)})
    df = spark.createDataFrame([(f"i{h}", f"{h:016x}", rnd.choice(SPLITS), "n") for h in hashes], DDL)
    expected = sum((a ^ b).bit_count() <= 3 for i, a in enumerate(hashes) for b in hashes[i + 1:])
    for name, value in {"BLOCK": 50, "SMALL": 8, "MATRIX": 512, "CELL_ROWS": 700, "BATCH_PAIRS": 100, "TASK_ROWS": 4000}.items():
        monkeypatch.setattr(H, name, value)
    for hot in (4096, 40):
        edges = H.near_dup_edges(df, 3, hot=hot)
        assert edges.count() == edges.select("hash_a", "hash_b").distinct().count() == expected
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and len(plan) < 100_000  # no join of bucket rows with each other, no tables of masks


def test_audit_makes_the_edges_once(spark, data):
    df = spark.createDataFrame(data, DDL).selectExpr("*", "1 AS orientation", "'x' AS source_object_label", "'s' AS source_dataset", "'g' AS source_group")
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    edges = H.near_dup_edges(df, 6)
    marked = edges.mapInArrow(counted, edges.schema)
    summary = audit_summary(df, marked, pairs=True).first()
    assert runs.value == edges.count() and summary["near_duplicate_pairs"] == len(list(brute(data, 6)))


def test_cross_split_counts_and_pivot(spark, data):
    df = spark.createDataFrame(data, DDL)
    expected = sum(a[2] != b[2] for a, b, _ in brute(data, 6))
    for options in ({}, {"pivot": "train"}, {"pivot": "train", "hot": 3}, {"hot": 3}):
        found = H.near_dup_cross_split(df, SPLITS, 6, **options)
        assert found.selectExpr("sum(pair_count)").first()[0] == expected
        assert found.count() == found.select("line").distinct().count()


def test_two_tables_members_and_expansion(spark, data):
    df = spark.createDataFrame(data, DDL)
    small, large = data[:40], data[40:]
    expected = sum((int(a[1], 16) ^ int(b[1], 16)).bit_count() <= 6 for a in small for b in large)
    found = H.near_dup_between(spark.createDataFrame(small, DDL), spark.createDataFrame(large, DDL), hot=5)
    assert found.selectExpr("sum(pair_count)").first()[0] == expected
    edges = H.near_dup_edges(df, 6)
    partners = {}
    for a, b, _ in brute(data, 6):
        partners[a[0]] = partners.get(a[0], 0) + 1
        partners[b[0]] = partners.get(b[0], 0) + 1
    assert dict(rows(H.near_dup_members(df, edges), "image_id", "partner_count")) == partners
    listed = H.expand_pairs(df, edges, budget=10**6)
    assert rows(listed) == sorted((tuple(sorted((a[0], b[0]))) + (d,) for a, b, d in brute(data, 6)), key=repr)
    with pytest.raises(GateError, match="budget"):
        H.expand_pairs(df, edges, budget=10)


def test_near_duplicate_line(spark):
    df = spark.createDataFrame([
        ("a", "0000000000000000", "train", "x"), ("b", "0000000000000001", "validation", "x"), ("c", "ffffffffffffffff", "test", "x"),
    ], DDL)
    assert rows(H.near_dup_cross_split(df, SPLITS, 1), "line") == [("train:a<->validation:b (dHash distance 1)",)]
    with pytest.raises(ValueError):
        H.near_dup_cross_split(df, SPLITS, 64)


def test_invalid_hashes(spark):
    df = spark.createDataFrame([("a", " "), ("b", None), ("c", "xyz"), ("d", "00000000000000AA")], "image_id string, perceptual_hash string")
    assert rows(H.invalid_hashes(df), "image_id", "rule") == [("a", "blank_hash"), ("b", "blank_hash"), ("c", "invalid_hash")]


def test_longer_keys_for_larger_tables():
    assert H.default_spare(6, 10**3) == 2 and H.default_spare(6, 10**10) == 4
    assert len(H.band_keys(H.ALL_BITS, 6, 2)) == 28 and len(H.band_keys(H.ALL_BITS, 6, 4)) == 210


def test_audit_refuses_incomplete_hashes(spark):
    split = spark.createDataFrame([("a", "00000000000000ff"), ("b", "zz"), ("c", " ")], "image_id string, perceptual_hash string")
    with pytest.raises(GateError, match="perceptual hashes"):
        jobs.audit(split)


def test_clusters_equal_union_find(spark):
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(0, 90)] + [(200, 200), (300, -5), (-5, 301)] + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(260)]
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    found = {r["node"]: r["cluster"] for r in clusters.clusters(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {n: top(n) for n in up}
    assert clusters.clusters(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
