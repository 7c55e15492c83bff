import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.operators.violations import GateError
from curalake.operators import history, metrics, quantiles, scoring, thresholds

DDL = "true_idx bigint, pred_idx bigint, confidence double"


def labels(spark, true, pred, confidence=None):
    return spark.createDataFrame(list(zip(true, pred, confidence or [0.9] * len(true))), DDL)


def test_small_label_set(spark):
    df = labels(spark, [0, 0, 0, 1, 2, 2, 2, 3, 3, 3], [0, 2, 0, 1, 2, 2, 1, 3, 0, 3])
    found = {r["class_name"]: r for r in metrics.per_class_metrics(df, S.CLASS_NAMES).collect()}
    assert [found[c]["support"] for c in S.CLASS_NAMES] == [3, 1, 3, 3]
    assert [round(found[c]["precision"], 4) for c in S.CLASS_NAMES] == [0.6667, 0.5, 0.6667, 1]
    assert [round(found[c]["f1_score"], 4) for c in S.CLASS_NAMES] == [0.6667, 0.6667, 0.6667, 0.8]
    assert metrics.overall_accuracy(df).first()["accuracy"] == 0.7
    with pytest.raises(Exception, match="outside the classes"):
        metrics.confusion_matrix(labels(spark, [0, 4], [0, 1]), S.CLASS_NAMES).collect()
    diagonal = rows(metrics.confusion_matrix(df, S.CLASS_NAMES).filter("true_idx = pred_idx"), "true_idx", "n")
    assert diagonal == [(0, 2), (1, 1), (2, 2), (3, 2)]


def test_published_test_set(spark):
    """Confusion matrix of the published 35-image test set and its scores."""
    matrix = [[7, 0, 0, 1], [0, 9, 0, 1], [0, 4, 6, 0], [2, 1, 1, 3]]
    pairs = [(t, p) for t, line in enumerate(matrix) for p, n in enumerate(line) for _ in range(n)]
    df = labels(spark, *zip(*pairs))
    assert round(metrics.overall_accuracy(df).first()["accuracy"], 7) == 0.7142857
    f1 = metrics.macro_weighted_f1(df, S.CLASS_NAMES).first()
    assert (round(f1["macro_f1"], 7), round(f1["weighted_f1"], 7)) == (0.6948529, 0.7042017)


def test_edge_classes(spark):
    df = labels(spark, [0, 0], [0, 2], [0.4, 0.65])
    found = {r["class_name"]: r for r in metrics.per_class_metrics(df, S.CLASS_NAMES).collect()}
    assert found["rust"]["f1_score"] == 0 and found["dent"]["precision"] == 0 and found["normal"]["recall"] == 0.5
    assert round(metrics.macro_weighted_f1(df, S.CLASS_NAMES).first()["macro_f1"], 6) == round((2 / 3) / 4, 6)
    summary = {r["group_name"]: r for r in metrics.confidence_summary(df.filter("true_idx = pred_idx")).collect()}
    assert summary["incorrect"]["n"] == 0 and summary["incorrect"]["median"] is None and summary["overall"]["median"] == 0.4
    edges = labels(spark, [0] * 4, [0] * 4, [0.0, 0.4, 0.8, 1.0])
    assert rows(metrics.confidence_histogram(edges), "bin", "n") == [(0, 1), (1, 1), (2, 0), (3, 2)]


def test_threshold_rules(spark):
    df = labels(spark, [0, 1, 1, 0], [0, 1, 0, 0], [0.95, 0.75, 0.35, 0.85])
    chosen = thresholds.select_threshold(df, ["normal", "scratch"], 0.75, [0.20, 0.55, 0.90, 0.55]).first()
    assert chosen["confidence_threshold"] == 0.55 and chosen["accepted_accuracy"] == 1.0
    assert thresholds.threshold_sweep(df, ["normal", "scratch"], [0.20, 0.55, 0.90, 0.55]).count() == 3
    with pytest.raises(ValueError):
        thresholds.select_threshold(df, ["normal", "scratch"], 0.0)
    none = thresholds.threshold_analysis(df, ["normal", "scratch"], 1.0).first()
    assert none["accepted_accuracy"] is None and none["rejected_by_true_class"] == {"normal": 2, "scratch": 2} and none["coverage"] == 0
    exact = thresholds.threshold_analysis(df, ["normal", "scratch"], 0.85).first()
    assert exact["accepted_count"] == 2  # accepted from the threshold on


def test_low_confidence_logits(spark):
    df = spark.createDataFrame([([0.1, 0.0, 0.0, 0.0], 0), ([8.0, 0.0, 0.0, 0.0], 0)], "logits array<double>, true_idx bigint")
    found = metrics.prediction_records(scoring.softmax_predict(df), S.CLASS_NAMES, 0.60)
    assert [r["requires_manual_review"] for r in found.orderBy("confidence").collect()] == [True, False]
    analysis = thresholds.threshold_analysis(found, S.CLASS_NAMES, 0.60).first()
    assert analysis["coverage"] == 0.5 and analysis["rejected_by_true_class"]["normal"] == 1


def test_exact_median_equals_numpy(spark):
    values = [((i * 7919) % 1009) / 1009 for i in range(501)] + [0.25] * 300
    data = [("hot", v) for v in values] + [("b", 0.1), ("b", 0.4), ("c", 0.7)]
    df = spark.createDataFrame(data, "g string, v double")
    for few in (False, True):
        assert dict(rows(quantiles.exact_median(df, ["g"], "v", few))) == {"hot": float(np.median(values)), "b": 0.25, "c": 0.7}


def test_exact_median_of_extreme_values(spark):
    tiny, huge = 5e-324, 1.7976931348623157e308
    groups = {
        "signs": [-2.5, -1.0, -0.0, 0.0, 3.0], "tiny": [tiny, 2 * tiny, 3 * tiny], "huge": [-huge, 1.0, huge, huge], "even": [-1e-300, 1e300], "powers": [2.0**k for k in range(-1074, 1024)],
        "edges": [np.nextafter(2.0**k, 0) for k in range(-40, 40)] + [2.0**k for k in range(-40, 40)], "infinite": [float("-inf"), 1.0, float("inf"), float("inf"), 2.0], "null": [None, 1.5],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in map(lambda x: None if x is None else float(x), vs)], "g string, v double")
    found = dict(rows(quantiles.exact_median(df, ["g"], "v")))
    assert found == {g: float(np.median([v for v in vs if v is not None])) for g, vs in groups.items()}
    whole = spark.createDataFrame([(1, (1 << 62) + 2), (1, -5), (1, (1 << 62) + 2), (2, None)], "g int, v bigint")
    assert rows(quantiles.exact_median(whole, ["g"], "v")) == [(1, float((1 << 62) + 2))]


def test_exact_median_spreads_close_values(spark):
    """300,000 values within 1e-6 of each other share their first digit and most of the second; no digit has more than 2 ** 16 counts."""
    df = spark.range(300_000).selectExpr("1 AS g", "1 - cast(id * 7919 % 300000 AS double) / 3e11 AS v")
    digits = df.select(*[F.shiftright(quantiles.ordered_bits(F.col("v")), 64 - quantiles.DIGIT * k).alias(f"p{k}") for k in (1, 2, 3)])
    most = [digits.groupBy(f"p{k}").agg(F.count_distinct(f"p{k + 1}").alias("n")).agg(F.max("n")).first()[0] for k in (1, 2)]
    assert digits.select("p1").distinct().count() <= 2 and max(most) <= 1 << quantiles.DIGIT
    values = 1 - np.arange(300_000).astype(float) / 3e11
    assert [tuple(r) for r in quantiles.exact_median(df, ["g"], "v", few=True).collect()] == [(1, float(np.median(values)))]


def test_class_weights(spark):
    data = [(c,) for c, n in zip(S.CLASS_NAMES, (64, 80, 80, 56)) for _ in range(n)]
    found = metrics.class_weights(spark.createDataFrame(data, "class_name string"), S.CLASS_NAMES)
    assert rows(found, "idx", "weight") == [(0, 1.09375), (1, 0.875), (2, 0.875), (3, 1.25)]
    with pytest.raises(GateError, match="chip"):
        metrics.class_weights(spark.createDataFrame(data, "class_name string"), [*S.CLASS_NAMES, "chip"], strict=True)


def test_history(spark):
    loss = [0.9, 0.8, 0.85, 0.8, 0.7, 0.75, 0.71, 0.72]
    stage = ["head"] * 3 + ["all"] * 5
    df = spark.createDataFrame([("r", i + 1, s, v) for i, (v, s) in enumerate(zip(loss, stage))], "run_id string, epoch bigint, stage string, loss double")
    assert rows(history.best_epoch(df)) == [("r", 5, 0.7, 8)]
    expected = [(1, 0, False), (2, 0, False), (3, 1, False), (4, 1, False), (5, 0, False), (6, 1, False), (7, 2, False), (8, 3, True)]
    for size in (1, 2, 3, 100):
        assert rows(history.early_stop_trace(df, 3, chunk_size=size), "epoch", "epochs_without_improvement", "stop") == expected


def test_history_documents(spark):
    metric = lambda v: (v, 0.5, "head", 0.1)
    doc = spark.createDataFrame([([metric(1.0), metric(0.9)], [metric(0.8), metric(0.6)], 2, 0.6, 2)], S.HISTORY_DDL).withColumn("run_id", F.lit("r"))
    assert rows(history.history_epochs(doc), "epoch", "loss", "training_loss") == [(1, 0.8, 1.0), (2, 0.6, 0.9)]


def test_scoring_checks_shape_and_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id bigint, x array<double>")
    scored = scoring.batch_score(df, "x", lambda: lambda x: x * 2, 2)
    assert rows(scored.filter("id = 3"), "logits") == [([6.0, 2.0],)]
    with pytest.raises(Exception, match="expected"):
        scoring.batch_score(df, "x", lambda: lambda x: x, 3).collect()
    ids = df.select("id")
    a, b = scoring.table_fingerprint(ids, ["id"]).first(), scoring.table_fingerprint(ids.repartition(5), ["id"]).first()
    assert a == b
    assert a["fingerprint"] != scoring.table_fingerprint(ids.union(ids.limit(1)), ["id"]).first()["fingerprint"]


def test_version_comparison(spark):
    ddl = "filename string, expected_class string, predicted_class string"
    before = spark.createDataFrame([("a", "x", "x"), ("b", "x", "y"), ("c", "x", "y")], ddl)
    after = spark.createDataFrame([("a", "x", "x"), ("b", "x", "x"), ("c", "x", "z")], ddl)
    found = metrics.version_comparison(before, after).first()
    assert (found["changed"], found["fixed"], found["broken"], round(found["gain"], 4)) == (2, 1, 0, 0.3333)
