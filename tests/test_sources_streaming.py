import hashlib
import json
import os
from datetime import datetime, timedelta
from urllib.parse import unquote

import pytest
from conftest import rows
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.operators import feedback as fb
from curalake.operators import history, metrics, review
from curalake.operators.violations import GateError
from curalake.session import settings, shared_folder
from curalake.sources import tables
from curalake.streaming import flows


def test_json_sources(spark, tmp_path):
    (tmp_path / "classes.json").write_text(json.dumps(S.CLASS_NAMES))
    assert rows(tables.scan_class_names(spark, str(tmp_path / "classes.json"))) == list(enumerate(S.CLASS_NAMES))
    (tmp_path / "twice.json").write_text('["a", "a"]')
    with pytest.raises(ValueError):
        tables.scan_class_names(spark, str(tmp_path / "twice.json"))
    (tmp_path / "decisions.json").write_text(json.dumps({"reviewer": "r", "review_protocol": "p", "rules": [], "accepted_class_indices": {"dent": [0, 2]}}, indent=1))
    assert rows(review.decision_rows(tables.scan_decisions(spark, str(tmp_path / "decisions.json")))) == [("dent", 0), ("dent", 2)]
    metric = lambda v: {"loss": v, "accuracy": 0.5, "stage": "head", "learning_rate": 0.1}
    (tmp_path / "history.json").write_text(json.dumps({"training_metrics": [metric(1.0), metric(0.5)], "validation_metrics": [metric(0.4), metric(0.6)]}, indent=1))
    epochs = history.history_epochs(tables.scan_history(spark, str(tmp_path / "history.json")))
    assert rows(history.best_epoch(epochs), "best_epoch", "best_validation_loss") == [(1, 0.4)]
    (tmp_path / "catalog.json").write_text(json.dumps({
        "object_type": "Car panel", "inventory_last_updated": "2026-08-19", "confidence_threshold": 0.6, "unknown_message": "m",
        "defects": [{"class_name": "dent", "display_name": "Dent", "repair_steps": ["a"], "parts": []}],
    }, indent=1))
    assert rows(tables.scan_catalog(spark, str(tmp_path / "catalog.json")).select(F.inline("defects")), "class_name") == [("dent",)]
    for split in S.SPLITS:
        (tmp_path / f"{split}_manifest.csv").write_text("image_id\n" + split + "\n")
    assert rows(tables.scan_splits(spark, str(tmp_path))) == [("test", "test"), ("train", "train"), ("validation", "validation")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0.9), (1, 0, 0.3)], "true_idx bigint, pred_idx bigint, confidence double")
    table = metrics.per_class_metrics(df, S.CLASS_NAMES)
    for form in ("parquet", "json", "csv"):
        tables.write_report(table.select(*S.METRIC_COLUMNS), str(tmp_path / form), S.METRIC_COLUMNS, form)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 4
    with pytest.raises(GateError, match="support"):
        tables.write_report(table.drop("support"), str(tmp_path / "x"), S.METRIC_COLUMNS)
    split = spark.createDataFrame([("a b", "p/1.jpg", "dent", "train")], "image_id string, file_path string, class_name string, dataset_split string")
    tables.write_split_directories(split, str(tmp_path / "dirs"))
    assert rows(spark.read.parquet(str(tmp_path / "dirs")), "destination", "dataset_split") == [("train/dent/a_b__1.jpg", "train")]


def test_feedback_log_with_mixed_line_ends(spark, tmp_path):
    header = ",".join(S.FEEDBACK_COLUMNS)
    line = lambda ok, fixed: f"2026-01-01,p,f,{'a' * 64},normal,0.9,{ok},{fixed},"
    text = header + "\r\n" + line("True", "") + "\n" + line("False", "dent") + "\r\n" + line("False", "") + "\n"
    (tmp_path / "log.csv").write_bytes(text.encode())
    log = tables.scan_feedback(spark, str(tmp_path / "log.csv"))
    assert log.count() == 3
    assert rows(fb.latest_feedback(log, S.CLASS_NAMES)) == [("a" * 64, "dent")]


def test_feedback_log_order_over_splits(spark, tmp_path):
    for name, first, count in (("a", 0, 3000), ("b", 3000, 9000)):  # the larger file comes second but is packed first
        lines = "".join(f"{i},{'x' * 50}\n" for i in range(first, first + count))
        (tmp_path / f"{name}.csv").write_text("k,v\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        found = [int(r["k"]) for r in tables.scan_feedback(spark, str(tmp_path)).orderBy("seq").select("k").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == list(range(12000))


def test_stream_continues_where_it_stopped(spark, tmp_path):
    base = datetime(2026, 1, 1)

    def batch(start):
        data = [(f"s{i % 3}", "normal" if i % 2 else "unknown", i % 4 != 0, None if i % 4 else ["dent", "rust"][i % 8 == 0], base + timedelta(hours=i), i) for i in range(start, start + 20)]
        df = spark.createDataFrame(data, "image_sha256 string, predicted_class string, is_correct boolean, corrected_class string, timestamp timestamp, seq bigint")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
        return rows(flows.latest_labels(stream, S.CLASS_NAMES, str(tmp_path / "out")))

    for start in (0, 20):
        batch(start)
        found = run()
        assert found == rows(fb.latest_feedback(spark.read.parquet(str(tmp_path / "in")), S.CLASS_NAMES))
    assert run() == found  # nothing new, nothing lost


def test_damaged_csv_rows_are_rejected_with_a_reason(spark, tmp_path):
    text = 'a,b,c\r\n1,"x, ""y""",3\n\n4,5\r\n6,7,8,9\n10,"open,12\n,,\n"a","b","c"\n13,é,15'
    (tmp_path / "log.csv").write_bytes(text.encode())
    checked = tables.scan_csv_checked(spark, str(tmp_path / "log.csv"), ["a", "b", "c"])
    assert rows(checked.filter("reason IS NULL"), "a", "b", "c") == sorted([("1", 'x, "y"', "3"), (None, None, None), ("13", "é", "15")], key=repr)
    assert rows(checked.filter("reason IS NOT NULL"), "a", "record", "reason") == sorted(
        [(None, "4,5", "short_row"), (None, "6,7,8,9", "long_row"), (None, '10,"open,12', "unclosed_quote")], key=repr)
    tables.write_rejects(checked, str(tmp_path / "rejects"))
    tables.write_rejects(checked, str(tmp_path / "rejects"))
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 6
    assert rows(tables.csv_violations(checked), "rule") == [("long_row",), ("short_row",), ("unclosed_quote",)]


def test_a_second_scan_reads_only_changed_files(spark, tmp_path):
    folder, cache = tmp_path / "files", str(tmp_path / "cache")
    folder.mkdir()
    for name in ("a", "b [1]", "c{x}", "d*"):
        (folder / name).write_bytes(name.encode())
    digest = lambda data: hashlib.sha256(data).hexdigest()

    def scan():
        found = tables.refresh_digests(spark, str(folder), cache, chunk=2)
        return {unquote(r["path"]).rsplit("/", 1)[1]: (r["actual_checksum"], r["fresh"]) for r in found.collect()}

    assert scan() == {n: (digest(n.encode()), True) for n in ("a", "b [1]", "c{x}", "d*")}
    assert {fresh for _, fresh in scan().values()} == {False}
    before = (folder / "a").stat()
    (folder / "a").write_bytes(b"?")  # same length and time: not read again
    os.utime(folder / "a", ns=(before.st_atime_ns, before.st_mtime_ns))
    (folder / "b [1]").write_bytes(b"other")
    (folder / "e").write_bytes(b"new")
    (folder / "d*").unlink()
    assert scan() == {"a": (digest(b"a"), False), "b [1]": (digest(b"other"), True), "c{x}": (digest(b"c{x}"), False), "e": (digest(b"new"), True)}
    empty = tmp_path / "empty"
    empty.mkdir()
    assert tables.refresh_digests(spark, str(empty), str(tmp_path / "none")).count() == 0


def test_digests_of_many_files_take_few_jobs(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(40):
        (folder / f"f{k}").write_text(str(k))
    context = spark.sparkContext
    context.setJobGroup("digests", "a scan")
    try:
        with settings(spark, {"spark.sql.files.maxPartitionBytes": "4m"}):  # a partition per file
            found = tables.refresh_digests(spark, str(folder), str(tmp_path / "cache"))
        jobs = context.statusTracker().getJobIdsForGroup("digests")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() == 40 and len(jobs) < 12


def test_shared_folder_is_stable(spark):
    assert shared_folder(spark) == shared_folder(spark)
