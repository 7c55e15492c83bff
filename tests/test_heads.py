import numpy as np
import pytest
from pyspark.sql import functions as F

from curalake.operators import heads, scoring
from curalake.operators.violations import GateError
from curalake.plans import jobs
from curalake.sources import tables

NAMES = ["a", "b", "c"]


def clusters(spark, n=600, parts=4):
    rng = np.random.default_rng(11)
    centres = np.array([[1.5, 0.0, 0.2], [-1.0, 1.0, 0.0], [0.0, -1.4, 0.5]])
    labels = rng.choice(3, n, p=[0.6, 0.3, 0.1])
    rows = [(i, [float(v) for v in centres[k] + 0.5 * rng.normal(size=3)], int(k)) for i, k in enumerate(labels)]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label bigint").repartition(parts)


def plain(rows, steps, rate=0.5, momentum=0.9, strength=1e-3):
    """The same descent in plain loops, without scaled integers."""
    counts = [sum(r["label"] == k for r in rows) for k in range(3)]
    w, v = np.zeros((3, 4)), np.zeros((3, 4))
    for _ in range(steps):
        g = np.zeros((3, 4))
        for r in rows:
            x = np.array([1.0, *r["features"]])
            p = np.exp(w @ x)
            p /= p.sum()
            for k in range(3):
                g[k] += len(rows) / (3 * counts[r["label"]]) * (p[k] - (k == r["label"])) * x
        shrunk = strength * w
        shrunk[:, 0] = 0
        v = momentum * v + g / len(rows) + shrunk
        w = w - rate * v
    return w


def test_descent_equals_plain_loops_for_every_partitioning(spark):
    df = clusters(spark)
    first = heads.head_descent(df, NAMES, steps=8)
    assert first == heads.head_descent(df.orderBy(F.desc("id")).coalesce(1), NAMES, steps=8)
    assert np.abs(np.array(first.coefficients) - plain(df.collect(), 8)).max() < 1e-5


def test_descent_agrees_with_spark_ml(spark):
    df = clusters(spark)
    ours = heads.head_decisions(heads.head_descent(df, NAMES, steps=60), df)
    theirs = scoring.head_predict(scoring.head_fit(df, NAMES), df).select("id", F.col("pred_idx").alias("other"))
    both = ours.join(theirs, "id")
    assert both.filter("pred_idx = other").count() >= 590
    assert both.filter("pred_idx = true_idx").count() >= 540
    assert both.filter("confidence < 1 / 3.0 OR confidence > 1").count() == 0


def test_descent_refuses_what_it_cannot_fit(spark):
    df = clusters(spark, 60)
    with pytest.raises(ValueError, match="no training rows of d"):
        heads.head_descent(df, [*NAMES, "d"])
    with pytest.raises(ValueError, match="outside the configured classes"):
        heads.head_descent(df, NAMES[:2])
    for odd in ([1.0], [1.0, float("nan"), 0.0], [1.0, None, 0.0]):
        more = spark.createDataFrame([(99, odd, 0)], df.schema)
        with pytest.raises(ValueError, match="finite and of one length"):
            heads.head_descent(df.union(more), NAMES)
    with pytest.raises(ValueError, match="no training rows"):
        heads.head_descent(df.limit(0), NAMES)


def test_rows_without_label_or_features_take_no_part(spark):
    df = clusters(spark, 200)
    more = spark.createDataFrame([(900, None, 1), (901, [1.0, 2.0, 3.0], None)], df.schema)
    assert heads.head_descent(df, NAMES, steps=3) == heads.head_descent(df.union(more), NAMES, steps=3)
    assert heads.head_table(df, heads.head_descent(df, NAMES, steps=1)).count() == 12


def evaluated(spark, columns):
    rows = [(i, f'a "{i}", b.png', [float(i % 3 == k) * (i % 5) for k in range(3)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_index bigint, filename string, x array<double>, true_idx bigint").select(*columns)
    return jobs.evaluate(df, "x", lambda: lambda x: x, NAMES)


def test_written_evaluation_reads_back(spark, tmp_path):
    report = evaluated(spark, ["sample_index", "filename", "x", "true_idx"])
    for _ in range(2):  # a second run replaces the first
        paths = jobs.write_evaluation(report, str(tmp_path))
    for name, (columns, form) in jobs.REPORTS.items():
        made = getattr(report, name).select(*columns)
        back = tables.scan_report(spark, paths[name], made.schema, form)
        assert back.columns == list(columns)
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, made.collect()), key=repr)


def test_evaluation_without_a_column_writes_nothing(spark, tmp_path):
    report = evaluated(spark, ["sample_index", "x", "true_idx"])
    with pytest.raises(GateError, match="filename"):
        jobs.write_evaluation(report, str(tmp_path))
    assert not list(tmp_path.iterdir())
