import pytest
from conftest import rows
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.operators import feedback as fb
from curalake.operators import graph as gr
from curalake.operators import serving
from curalake.operators.violations import GateError
from curalake.plans import jobs

SHA = "a" * 64
FEEDBACK = "prediction_id string, image_filename string, image_sha256 string, predicted_class string, confidence double, is_correct boolean, corrected_class string, comment string, timestamp timestamp, seq bigint"


def catalog(spark, steps=2, price=100.0):
    defects = []
    for c in S.CLASS_NAMES:
        quiet = c == "normal"
        part = (f"PART-{c.upper()}", f"{c} part", price, "INR", 5, "in_stock")
        defects.append((c, c.title(), [] if quiet else [f"step {i}" for i in range(1, steps + 1)], [] if quiet else [part]))
    return spark.createDataFrame([("Car panel", "2026-08-19", 0.6, "review", defects)], S.CATALOG_DDL)


def event(spark, data):
    from datetime import datetime, timedelta

    base = datetime(2026, 1, 1)
    full = [(*row, base + timedelta(minutes=i), i) for i, row in enumerate(data)]
    return spark.createDataFrame(full, FEEDBACK)


def test_seed_twice_and_keep_removed(spark):
    graph, summary = jobs.seed_and_check_graph(None, catalog(spark, steps=3), S.CLASS_NAMES)
    assert dict(rows(summary)) == {"ObjectType": 1, "Defect": 4, "RepairStep": 9, "Part": 3, "InventoryRecord": 3}
    again, _ = jobs.seed_and_check_graph(graph, catalog(spark, steps=3), S.CLASS_NAMES)
    assert rows(gr.graph_nodes(again)) == rows(gr.graph_nodes(graph)) and rows(gr.graph_edges(again)) == rows(gr.graph_edges(graph))
    less, _ = jobs.seed_and_check_graph(graph, catalog(spark, steps=2, price=90.0), S.CLASS_NAMES)
    assert less.repair_step.count() == 9  # the seed never deletes
    assert rows(less.inventory, "mock_price") == [(90.0,)] * 3
    assert rows(gr.repair_steps_for_defect(graph).filter("class_name = 'dent'"), "position", "step_id") == [
        (1, "dent-step-01"), (2, "dent-step-02"), (3, "dent-step-03")
    ]
    assert rows(gr.parts_for_defect(graph, spark.createDataFrame([("rust",)], "class_name string")), "part_id") == [("PART-RUST",)]
    with pytest.raises(GateError, match="completeness"):
        jobs.seed_and_check_graph(None, catalog(spark, steps=1), S.CLASS_NAMES)
    with pytest.raises(GateError, match="catalog"):
        jobs.seed_and_check_graph(None, catalog(spark, price=-1.0), S.CLASS_NAMES)


def test_lookup_folds_one_or_both_sides(spark):
    keys = spark.createDataFrame([(" SCRATCH ",), ("none",)], "class_name string")
    defects = spark.createDataFrame([("Scratch", "S")], "class_name string, display_name string")
    assert rows(gr.defect_lookup(keys, defects), "display_name") == [("S",), (None,)]
    assert rows(gr.defect_lookup(keys, defects, fold_stored=False), "display_name") == [(None,), (None,)]


def test_a_class_may_have_any_number_of_parts(spark):
    defects = spark.sql("SELECT 'car' AS object_type, 'dent' AS class_name, 'Dent' AS display_name UNION ALL SELECT 'car', 'normal', 'Normal'")
    steps = spark.sql("SELECT 'dent' AS class_name, 1L AS position, 'clean' AS instruction")
    parts = spark.range(1_001).selectExpr("'dent' AS class_name", "concat('P', id) AS part_id", "concat('2026-01-', 10 + id % 20) AS last_updated")
    known = gr.knowledge_records(gr.Catalog(defects, steps, parts))
    assert rows(known, "class_name", "step_count", "part_count", "inventory_last_updated") == [("dent", 1, 1_001, "2026-01-29"), ("normal", 0, 0, "2026-01-29")]


def test_feedback_rules(spark):
    good = ("p", "f.png", SHA, "scratch", 0.91, True, None, None)
    data = [
        good, ("p", "f.png", SHA, "scratch", 0.91, False, "dent", None), ("p", "f.png", None, "unknown", 0.0, True, None, ""),
        ("p", "f.png", SHA, "scratch", 0.91, False, None, None), ("p", "f.png", SHA, "scratch", 0.91, False, "chip", None),
        ("", "", SHA + "\n", "chip", float("nan"), True, "dent", "x" * 501),
    ]
    df = event(spark, data)
    assert rows(fb.feedback_valid(df, S.CLASS_NAMES), "seq") == [(0,), (1,), (2,)]
    found = {r["seq"]: sorted(r["errors"]) for r in fb.feedback_rejected(df, S.CLASS_NAMES).collect()}
    assert found[3] == ["correction_required"] and found[4] == ["corrected_class_unknown"]
    assert found[5] == [
        "comment_too_long", "confidence_range", "correction_forbidden", "empty_image_filename", "empty_prediction_id",
        "image_sha256_format", "predicted_class_unknown",
    ]


def test_latest_label_skips_invalid_rows(spark):
    data = [
        ("p", "f", SHA, "normal", 0.9, True, None, None), ("p", "f", SHA, "normal", 0.9, False, "scratch", None),
        ("p", "f", SHA, "normal", 0.9, False, None, None), ("p", "f", SHA, "unknown", 0.9, True, None, None),
        ("p", "f", "", "dent", 0.9, True, None, None),
    ]
    assert rows(fb.latest_feedback(event(spark, data), S.CLASS_NAMES)) == [(SHA, "scratch")]
    legacy = event(spark, data).drop("image_sha256")
    upgraded = fb.feedback_upgrade(legacy)
    assert upgraded.columns == S.FEEDBACK_COLUMNS and rows(upgraded.select("image_sha256").distinct()) == [("",)]


def test_override_and_response(spark):
    predictions = spark.createDataFrame([("a", 0, 0.9), ("b", 0, 0.9), ("c", 3, 0.2), ("d", 2, 0.3), ("e", 1, 0.9)], "image_sha256 string, pred_idx int, confidence double")
    latest = spark.createDataFrame([("a", "scratch"), ("b", "normal"), ("d", "dent")], "image_sha256 string, feedback_class string")
    answer = serving.feedback_override(predictions, latest, 0.65, S.CLASS_NAMES)
    known = gr.knowledge_records(gr.flatten_catalog(catalog(spark)))
    knowledge = serving.knowledge_fallback(known.select("class_name"), known.filter("class_name = 'dent'"), known)
    found = {r["image_sha256"]: r for r in serving.enriched_predictions(answer, knowledge).collect()}
    a, b, c, d = (found[k] for k in "abcd")
    assert (a["predicted_class"], a["most_likely_class"], a["feedback_applied"], a["requires_manual_review"]) == ("scratch", "normal", True, False)
    assert (b["predicted_class"], b["feedback_applied"]) == ("normal", False)
    assert (c["predicted_class"], c["requires_manual_review"], c["step_count"], c["part_count"], c["display_name"], c["status"]) == (
        "unknown", True, 0, 0, S.UNKNOWN_DISPLAY_NAME, 200
    )
    # any label differs from "unknown", so it lifts the review
    assert (d["predicted_class"], d["feedback_applied"], d["requires_manual_review"], d["knowledge_source"]) == ("dent", True, False, "neo4j")
    assert (a["step_count"], a["part_count"], a["knowledge_source"]) == (2, 1, S.FALLBACK_SOURCE)
    assert c["inventory_last_updated"] == a["inventory_last_updated"] is not None and c["message"] == serving.UNKNOWN_MESSAGE
    lost = serving.enriched_predictions(answer, knowledge.filter("class_name <> 'scratch'"))
    assert rows(lost.filter("status = 500"), "image_sha256") == [("a",), ("e",)]


def test_fingerprint_is_used_once(spark):
    data = [("p1", "f", None, "dent", 0.9, True, None, None), ("p1", "f", SHA, "dent", 0.9, True, None, None), ("p2", "f", SHA, "dent", 0.9, True, None, None)]
    log = spark.createDataFrame([("p1", "r1")], "prediction_id string, image_sha256 string")
    assert rows(fb.feedback_fingerprint(event(spark, data), log), "seq", "image_sha256") == [(0, "r1"), (1, SHA), (2, SHA)]


def test_upload_status(spark):
    data = [
        ("a.JPG", "image/jpeg", 10, True, True, 200), ("a.png", " IMAGE/PNG", 10, True, True, 415), ("a.png", "image/gif", 10, True, True, 415),
        ("a.png", "image/png", 10 * 1024 * 1024 + 1, True, True, 413), ("a.jpg", "image/png", 10, True, True, 400), ("", "image/png", 10, True, True, 400),
        ("a.png", "image/png", 0, True, True, 400), ("a.png", "image/png", 10, False, True, 400), ("a.png", "image/png", 10, True, False, 503),
        (".png", "image/png", 10, True, True, 400), ("x/y.tar.png", "IMAGE/png", 10, True, True, 200),
    ]
    df = spark.createDataFrame(data, "filename string, content_type string, size_bytes bigint, decodable boolean, model_available boolean, expected int")
    assert df.filter(serving.upload_status() != F.col("expected")).count() == 0


def test_serve_batch_and_report(spark):
    uploads = spark.createDataFrame(
        [("a.png", "image/png", 10, True, True, "a", [9.0, 0.0, 0.0, 0.0]), ("b.gif", "image/gif", 10, True, True, "b", [9.0, 0.0, 0.0, 0.0])],
        "filename string, content_type string, size_bytes bigint, decodable boolean, model_available boolean, image_sha256 string, logits array<double>",
    )
    feedback = event(spark, [("p", "f", "a", "normal", 0.9, False, "rust", None)])
    known = gr.knowledge_records(gr.flatten_catalog(catalog(spark)))
    found = jobs.serve_batch(uploads, feedback, known.limit(0), known, S.CLASS_NAMES, 0.65)
    assert rows(found, "filename", "status", "predicted_class") == [("a.png", 200, "rust"), ("b.gif", 415, None)]
    report = jobs.feedback_report(event(spark, [("p", "f", SHA, "normal", 0.9, True, None, None), ("p", "f", SHA, "normal", 2.0, True, None, None)]),
                                  spark.createDataFrame([], "prediction_id string, image_sha256 string"), S.CLASS_NAMES)
    assert (report.accepted.count(), report.rejected.count()) == (1, 1) and rows(report.latest) == [(SHA, "normal")]


def test_last_submission_of_a_part_wins(spark):
    part = "named_struct('part_id', 'P', 'part_name', 'bolt', 'mock_price', {}D, 'currency', 'INR', 'fake_stock_quantity', 1, 'availability_status', 'in_stock')"
    entry = "named_struct('class_name', '{}', 'display_name', 'x', 'repair_steps', array('s'), 'parts', array({}))"
    defects = ", ".join(entry.format(c, part.format(p)) for c, p in (("scratch", 90.0), ("dent", 10.0)))
    nested = spark.sql(f"SELECT 'car' AS object_type, '2026-08-19' AS inventory_last_updated, array({defects}) AS defects")
    built = gr.graph_from_catalog(gr.flatten_catalog(nested))
    assert [r["mock_price"] for r in built.inventory.collect()] == [10.0]
    assert "seq" not in built.inventory.columns + built.part.columns + built.has_repair_step.columns + built.may_require.columns
