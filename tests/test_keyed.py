"""Keyed tables, the used-once fingerprint and stored graphs over several batches and restarts."""

from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from curalake.operators import graph as gr
from curalake.streaming import flows, keyed

CHANGES = "k string, v bigint, at bigint"


def folder(spark, path, data, ddl):
    spark.createDataFrame(data, ddl).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(ddl).parquet(str(path))


def test_a_second_run_rewrites_only_its_buckets(spark, tmp_path):
    existing = spark.createDataFrame([("a", 1), ("z", 9)], "k string, v bigint")
    first = [(f"k{i}", i, i) for i in range(200)] + [("a", 5, 3), ("a", 4, 2), ("k1", 7, None)]
    out = rows(flows.upserted(folder(spark, tmp_path / "in", first, CHANGES), existing, ["k"], ["at"], str(tmp_path / "t")))
    assert out == sorted([(f"k{i}", i) for i in range(200)] + [("a", 5), ("z", 9)], key=repr)
    table = keyed.KeyedTable.like(spark.createDataFrame([], CHANGES), str(tmp_path / "t/table"), ["k"], ["at"])
    version, before = table.pointer()
    second = [("k7", 70, 300), ("k8", -1, 1), ("new", 1, 1)]  # k8's change is older than what is there
    out = rows(flows.upserted(folder(spark, tmp_path / "in", second, CHANGES), existing, ["k"], ["at"], str(tmp_path / "t")))
    after = table.pointer()
    touched = {b for b, v in after[1].items() if v != before.get(b)}
    buckets = {r[0] for r in spark.createDataFrame(second, CHANGES).select(table._bucket()).collect()}
    assert after[0] == version + 1 and touched == buckets and len(before) > len(touched) + 10
    written = {r[0] for r in spark.read.parquet(str(tmp_path / f"t/table/data/version={after[0]}")).select("bucket").distinct().collect()}
    assert written == buckets
    assert out == sorted([(f"k{i}", {7: 70}.get(i, i)) for i in range(200)] + [("a", 5), ("z", 9), ("new", 1)], key=repr)
    # the same as one batch over all changes; a replay and an uncommitted version change nothing
    batch = gr.upsert(existing, spark.createDataFrame(first + second, CHANGES), ["k"], ["at"])
    assert out == rows(batch)
    assert table.merge(spark.createDataFrame([("k7", 0, 999)], CHANGES), after[0]) == []
    spark.createDataFrame([("k7", 0)], "k string, v bigint").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / f"t/table/data/version={after[0] + 1}"))
    assert rows(table.read()) == out
    assert rows(table.read(version)) == sorted([(f"k{i}", i) for i in range(200)] + [("a", 5), ("z", 9)], key=repr)
    assert table.merge(spark.createDataFrame([("z", 10, 1)], CHANGES), after[0] + 1) and ("z", 10) in rows(table.read())


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    changes = spark.range(200_000, numPartitions=8).selectExpr("concat('k', id) AS k", "id AS v", "id AS at")
    table = keyed.KeyedTable.like(changes, str(tmp_path / "t"), ["k"], ["at"], buckets=2)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        assert table.merge(changes, 1) == [0, 1] and table.merge(changes.selectExpr("k", "-v AS v", "at + 1 AS at"), 2) == [0, 1]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert all(len(list((tmp_path / f"t/data/version={v}/bucket={b}").glob("*.parquet"))) > 1 for v in (1, 2) for b in (0, 1))
    assert table.read().selectExpr("count(*)", "count(DISTINCT k)", "sum(v)").first()[:] == (200_000, 200_000, -sum(range(200_000)))


def test_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], CHANGES)
    table = keyed.KeyedTable.like(none, str(tmp_path / "t"), ["k"], ["at"])
    assert table.read().count() == 0 and table.read().columns == ["k", "v"] and table.merge(none, 1) == []
    table.create(none.select("k", "v"))
    assert table.pointer() == (-1, {}) or table.read().count() == 0


def test_graph_seeds_are_seen_as_a_whole(spark, tmp_path):
    def catalog(name, price, parts):
        return gr.Catalog(
            spark.createDataFrame([("panel", "dent", name)], "object_type string, class_name string, display_name string"),
            spark.createDataFrame([("dent", 1, f"{name} one")], "class_name string, position bigint, instruction string"),
            spark.createDataFrame([("dent", p, p, price, "INR", 1, "in_stock", "2026-01-01") for p in parts],
                                  "class_name string, part_id string, part_name string, mock_price double, currency string, fake_stock_quantity int, availability_status string, last_updated string"),
        )

    old, new = (gr.graph_from_catalog(c) for c in (catalog("Dent", 1.0, ["P1", "P2"]), catalog("Dents", 2.0, ["P2", "P3"])))
    store = keyed.GraphStore(spark, str(tmp_path / "g"), 4)
    assert store.seeds() == 0 and store.read(old).part.count() == 0
    assert (store.seed(old), store.seed(new), store.seed(new)) == (1, 2, 3)
    expected = gr.upsert_graph(old, new)
    found = store.read(new)
    for name in gr.KEYS:
        assert rows(getattr(found, name).select(*getattr(expected, name).columns)) == rows(getattr(expected, name)), name
    # a seed that died after some tables is not visible, and its number is used again
    store._tables(old)["part"].merge(old.part.withColumn("_seed", F.lit(4).cast("bigint")).withColumn("part_name", F.lit("half")), 4)
    assert rows(store.read(new).part, "part_id") == [("P1",), ("P2",), ("P3",)] and "half" not in str(rows(store.read(new).part))


def test_fingerprints_are_used_once_over_batches(spark, tmp_path):
    day = lambda d, h=0: datetime(2026, 1, 1) + timedelta(days=d, hours=h)
    predictions, feedback = "prediction_id string, predicted_at timestamp, image_sha256 string", "seq bigint, timestamp timestamp, prediction_id string, image_sha256 string"

    def run(told, asked):
        told = folder(spark, tmp_path / "told", told, predictions)
        asked = folder(spark, tmp_path / "asked", asked, feedback)
        out = flows.fingerprinted_feedback(asked, told, str(tmp_path / "out"), "1 day")
        return sorted((r["seq"], r["prediction_id"], r["image_sha256"]) for r in out.collect())

    out = run([("p1", day(0), "h1"), ("p2", day(0), "h2"), ("p0", day(0), None)],
              [(2, day(0, 3), "p1", "late"), (1, day(0, 2), "p1", None), (3, day(0, 2), "unknown", None), (4, day(0), "p0", "own")])
    assert out == [(1, "p1", "h1"), (2, "p1", "late"), (3, "unknown", ""), (4, "p0", "own")]
    # later batches: used stays used, p2 binds, feedback before its prediction keeps its own hash
    out = run([("p3", day(0, 12), "h3")], [(5, day(0, 4), "p1", "own"), (6, day(0, 5), "p2", "own"), (7, day(0, 11), "p3", "early"), (8, day(2), "p3", "too late")])
    assert out[4:] == [(5, "p1", "own"), (6, "p2", "h2"), (7, "p3", "early"), (8, "p3", "too late")]
    # a month later: old state is gone, a prediction older than the watermark is not taken up, feedback is kept however old
    run([("p9", day(30), "h9")], [(9, day(0, 13), "p3", "before the timer")])
    run([("old", day(1), "gone"), ("p10", day(31), "h10")], [(10, day(0), "p1", "very old")])
    out = run([("p11", day(32), "h11")], [(11, day(1, 1), "old", "own"), (12, day(31, 2), "p10", None)])
    assert out[8:] == [(9, "p3", "h3"), (10, "p1", "very old"), (11, "old", "own"), (12, "p10", "h10")]
    states = spark.read.format("statestore").load(str(tmp_path / "out/checkpoint"))
    assert {r["key"]["prediction_id"] for r in states.select("key").collect()} <= {"p10", "p11", "p9"}


def test_fingerprints_are_bound_without_a_call_per_key(spark, tmp_path):
    hour = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    told = [("a", hour(2), "second"), ("a", hour(1), "first"), ("b", hour(1), "hb"), ("c", None, "no time"), ("d", hour(1), "hd"), (None, hour(1), "no id")]
    asked = [
        (1, hour(3), "a", "own"), (1, hour(3), "a", "own"), (2, hour(25), "b", None), (3, hour(26), "b", None), (4, hour(2), "c", "own"),
        (5, None, "d", "no time"), (6, hour(25.001), "d", "too late"), (7, hour(2), None, "own"),
    ]
    told = folder(spark, tmp_path / "told", told, "prediction_id string, predicted_at timestamp, image_sha256 string")
    asked = folder(spark, tmp_path / "asked", asked, "seq bigint, timestamp timestamp, prediction_id string, image_sha256 string")
    out = flows.fingerprinted_feedback(asked, told, str(tmp_path / "out"), "1 day")
    assert rows(out, "seq", "image_sha256") == [(1, "first"), (1, "own"), (2, "hb"), (3, ""), (4, "own"), (5, "no time"), (6, "too late"), (7, "own")]
    operators = spark.read.format("state-metadata").load(str(tmp_path / "out/checkpoint")).select("operatorName").collect()
    assert {r[0] for r in operators} == {"dedupeWithinWatermark"}
