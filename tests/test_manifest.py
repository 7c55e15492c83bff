import pytest
from conftest import rows
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.operators import identity, manifest, ranking, review, sampling
from curalake.operators.violations import GateError, gate
from curalake.plans import jobs
from curalake.sources import tables

SPLIT_DDL = "image_id string, file_path string, class_name string, checksum string"


def eighty(spark, extra=()):
    data = [(f"{c}-{i}", f"{c}/{c}-{i}.jpg", c, f"checksum-{c}-{i}") for c in S.CLASS_NAMES for i in range(20)]
    return spark.createDataFrame([*data, *extra], SPLIT_DDL)


def test_strict_split(spark):
    df = eighty(spark)
    split = sampling.strict_split(df)
    assert rows(split.groupBy("class_name", "dataset_split").count()) == sorted(
        [(c, s, n) for c in S.CLASS_NAMES for s, n in (("train", 16), ("validation", 2), ("test", 2))], key=repr
    )
    again = sampling.strict_split(df.repartition(7), seed=42)
    assert rows(split, "image_id", "dataset_split") == rows(again, "image_id", "dataset_split")
    other = sampling.strict_split(df, seed=43)
    assert rows(split, "image_id", "dataset_split") != rows(other, "image_id", "dataset_split")
    assert manifest.strict_split_counts(split, S.CLASS_NAMES).filter("NOT ok").count() == 0
    short = split.filter("NOT (class_name = 'rust' AND dataset_split = 'test')")
    assert manifest.strict_split_counts(short, S.CLASS_NAMES).filter("NOT ok").count() > 0
    jobs.validate_splits(split, S.CLASS_NAMES, frozen=jobs.frozen_fingerprint(split).first()["fingerprint"])
    tampered = split.withColumn("checksum", F.when(F.col("dataset_split") == "test", F.concat("checksum", F.lit("x"))).otherwise(F.col("checksum")))
    with pytest.raises(GateError, match="frozen"):
        jobs.validate_splits(tampered, S.CLASS_NAMES, frozen=jobs.frozen_fingerprint(split).first()["fingerprint"])
    with pytest.raises(GateError, match="classes"):
        jobs.validate_splits(split.filter("class_name <> 'rust'"), S.CLASS_NAMES)


def test_incompatible_counts_and_ratios(spark):
    df = eighty(spark, [("normal-extra", "normal/extra.jpg", "normal", "x")])
    with pytest.raises(GateError, match="compatible"):
        sampling.strict_split(df)
    assert manifest.valid_ratios((0.8, 0.1, 0.1))
    assert not manifest.valid_ratios((0.7, 0.1, 0.1)) and not manifest.valid_ratios((0.8, 0.2, 0.0))


def test_exact_and_group_leak(spark):
    df = spark.createDataFrame([
        ("same", "normal/a.jpg", "normal", "abc", "train", "g1"), ("same", "normal/A.jpg", "normal", "abc", "validation", " "),
        ("other", "normal/b.jpg", "normal", "def", "test", "g1"), ("x", None, "normal", "", "test", None), ("y", None, "normal", "", "train", None),
    ], SPLIT_DDL + ", dataset_split string, source_group string")
    assert rows(identity.cross_split_duplicates(df, S.SPLITS), "identity") == [
        ("checksum:abc",), ("file_path:normal/a.jpg",), ("image_id:same",), ("source_group:g1",)
    ]


def test_ranks_equal_the_window(spark):
    from pyspark.sql import Window as W

    data = [(f"id-{i:05d}", "hot" if i % 3 else f"c{i % 5}", f"p/{(i * 7919) % 3001:05d}") for i in range(3000)]
    df = spark.createDataFrame(data, "image_id string, class_name string, file_path string")
    by_md5 = W.partitionBy("class_name").orderBy(F.md5(F.concat(F.lit("9:"), "image_id")))
    expected = rows(df.withColumn("rank", F.row_number().over(by_md5)), "image_id", "rank")
    assert rows(ranking.seeded_rank(df, "class_name", "image_id", 9), "image_id", "rank") == expected
    assert rows(ranking.seeded_rank(df, "class_name", "image_id", 9, digits=1, keep=F.lit(50)), "image_id", "rank") == [r for r in expected if r[1] <= 50]
    by_path = W.partitionBy("class_name").orderBy("file_path")
    expected = rows(df.withColumn("rank", F.row_number().over(by_path)), "image_id", "rank")
    assert rows(ranking.ordered_rank(df, "class_name", ["file_path"], partitions=7), "image_id", "rank") == expected


def test_samples(spark):
    data = [(f"{c}-{i}", c, 100 + i) for c, n in (("normal", 60), ("scratch", 45), ("dent", 38), ("rust", 31)) for i in range(n)]
    df = spark.createDataFrame(data, "source_group string, class_name string, short_side int")
    balanced = sampling.balanced_sample(df, 100)
    assert rows(balanced.groupBy("class_name").count()) == [(c, 30) for c in sorted(S.CLASS_NAMES)]
    assert rows(balanced) == rows(sampling.balanced_sample(df.repartition(5), 100))
    assert sampling.balanced_sample(df, 100, requested=10).count() == 40
    with pytest.raises(GateError):
        sampling.balanced_sample(df, 100, requested=40)
    tiered = sampling.tiered_sample(df, {"rust": 5, "normal": 30})
    assert tiered.filter("class_name = 'rust'").count() == 5
    # rust has 3 rows with short side >= 128, normal 32: sharp rows come first
    assert tiered.filter("short_side >= 128").count() == 3 + 30
    assert rows(sampling.sample_shortfall(df, {"rust": 99, "dent": 2})) == [("rust", 99, 31)]
    ids = df.withColumnRenamed("source_group", "image_id")
    assert rows(sampling.review_sample(ids, 6).groupBy("class_name").count()) == [(c, 6) for c in sorted(S.CLASS_NAMES)]


def test_manifest_rules(spark):
    good = [(f"i{i}", f"p/{i}.jpg", "normal", "src", "CC", f"{i:064x}", "", f"g{i}") for i in range(3)]
    ddl = "image_id string, file_path string, class_name string, source string, license string, checksum string, dataset_split string, source_group string"
    assert manifest.manifest_violations(spark.createDataFrame(good, ddl)).count() == 0
    dirty = [*good, ("i0", "p/9.jpg", "normal", " ", None, "zz", "train", "g1")]
    found = rows(manifest.manifest_violations(spark.createDataFrame(dirty, ddl)))
    assert found == [
        ("assigned_split", "i0"), ("blank_license", "i0"), ("blank_source", "i0"), ("checksum_format", "i0"),
        ("duplicate_image_id", "i0"), ("duplicate_source_group", "g1"),
    ]
    assert rows(manifest.manifest_violations(spark.createDataFrame(good, ddl).drop("license")), "subject") == [("license",)]
    assert ("missing_column_original_label",) in rows(manifest.traceability_violations(spark.createDataFrame(good, ddl)), "rule")
    with pytest.raises(GateError):
        gate(manifest.manifest_violations(spark.createDataFrame(dirty, ddl)), "manifest")


def test_csv_scan_keeps_text(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b'image_id,crop_box,perceptual_hash\r\na,"[88,159,249,320]",0012\nb,"x ""q"", y;z",00ff\r\n')
    assert rows(tables.scan_manifest(spark, str(tmp_path / "m.csv"))) == [("a", "[88,159,249,320]", "0012"), ("b", 'x "q", y;z', "00ff")]
    (tmp_path / "n.csv").write_text('image_id,note\na,"two\nlines"\n')
    assert rows(tables.scan_manifest(spark, str(tmp_path / "n.csv"), line_breaks=True)) == [("a", "two\nlines")]
    (tmp_path / "e.csv").write_text("image_id\n")
    with pytest.raises(GateError, match="empty"):
        tables.scan_manifest(spark, str(tmp_path / "e.csv"))


def test_review_decisions(spark):
    data = [(f"{c}/{i:02d}.jpg", c, "note") for c in S.CLASS_NAMES for i in range(12)]
    df = spark.createDataFrame(data, "file_path string, class_name string, review_notes string")
    documents = spark.createDataFrame([("r", "p1", ["x"], {c: list(range(10)) for c in S.CLASS_NAMES})], S.DECISIONS_DDL)
    decisions = review.decision_rows(documents)
    assert review.decision_violations(df, decisions, S.CLASS_NAMES).count() == 0
    decided = review.apply_review_decisions(df, decisions, "p1")
    assert rows(decided.filter("review_status = 'rejected' AND class_name = 'dent'"), "file_path") == [("dent/10.jpg",), ("dent/11.jpg",)]
    tally = {(a, b): n for a, b, n in rows(review.review_tally(decided))}
    assert tally[("rust", "accepted")] == 10 and tally[(None, None)] == 48
    dirty = spark.createDataFrame([("dent", 3), ("dent", 3), ("rust", 12), ("rust", -1)], "class_name string, accepted_index bigint")
    assert rows(review.decision_violations(df, dirty, S.CLASS_NAMES), "rule", "class_name", "accepted_index") == [
        ("class_without_decision", "normal", None), ("class_without_decision", "scratch", None), ("duplicate_index", "dent", 3),
        ("index_out_of_range", "rust", -1), ("index_out_of_range", "rust", 12),
    ]
    pages = review.review_pages(df, per_page=5, columns=2).filter("class_name = 'dent' AND record_number = 8")
    assert rows(pages, "page", "page_row", "page_column") == [(2, 1, 1)]


def test_bind_and_split_jobs(spark, tmp_path):
    import hashlib
    import random

    rnd = random.Random(3)
    data = [(f"{c}/{i:02d}.jpg", c, "l", "s", "u", "CC", f"{c}{i}", "pending", "") for c in S.CLASS_NAMES for i in range(12)]
    records = spark.createDataFrame(data, ", ".join(f"{c} string" for c in S.RECORD_COLUMNS))
    content = spark.createDataFrame(
        [(r[0], hashlib.sha256(r[0].encode()).hexdigest(), f"{rnd.getrandbits(64):016x}") for r in data], "file_path string, actual_checksum string, actual_hash string"
    )
    decisions = spark.createDataFrame([(c, i) for c in S.CLASS_NAMES for i in range(10)], "class_name string, accepted_index bigint")
    bound = jobs.bind_reviewed_manifest(records, decisions, "p", content)
    assert bound.columns == S.MANIFEST_V2_COLUMNS and bound.count() == 40
    frozen = jobs.split_and_freeze(bound, content, S.CLASS_NAMES, str(tmp_path / "split"))
    split = spark.read.parquet(str(tmp_path / "split"))
    jobs.validate_splits(split, S.CLASS_NAMES, content, frozen.first()["fingerprint"], traceable=True)
    with pytest.raises(Exception, match="exists"):
        tables.write_splits(split, str(tmp_path / "split"))
    broken = content.withColumn("actual_checksum", F.repeat(F.lit("0"), F.lit(64)))
    assert manifest.content_mismatches(bound, broken).filter("error = 'checksum_mismatch'").count() == 40


def test_content_mismatches(spark):
    df = spark.createDataFrame([("a", "1.jpg", "AA", "f0"), ("b", "2.jpg", "bb", "f0"), ("c", "3.jpg", "cc", ""), ("d", "4.jpg", "dd", "f0")],
                               "image_id string, file_path string, checksum string, perceptual_hash string")
    content = spark.createDataFrame([("1.jpg", "aa", True, "f0"), ("2.jpg", "xx", True, "f0"), ("3.jpg", "cc", False, None)],
                                    "file_path string, actual_checksum string, decodable boolean, actual_hash string")
    assert rows(manifest.content_mismatches(df, content), "image_id", "error") == [("b", "checksum_mismatch"), ("c", "undecodable"), ("d", "missing")]


def test_heldout_rules(spark):
    data = [(f"{c}{i}", c, "yes", "Yes") for c in S.CLASS_NAMES for i in range(10)]
    ddl = "filename string, expected_class string, excluded_from_training_validation string, selected_before_inference string"
    assert manifest.heldout_manifest_violations(spark.createDataFrame(data, ddl)).count() == 0
    dirty = [*data[1:], ("q", "chip", "no", "")]
    assert rows(manifest.heldout_manifest_violations(spark.createDataFrame(dirty, ddl))) == [
        ("class_count", "normal"), ("not_excluded", "q"), ("not_frozen_before_inference", "q"), ("unexpected_class", "chip")
    ]


def test_certification_without_label_column(spark):
    df = spark.createDataFrame([("normal",), ("dent",)], "class_name string")
    assert rows(manifest.normal_certification(df)) == [(0, 1)]
    assert rows(manifest.acquisition_yield(df, 12), "needed_rows", "ok") == [(10, False)]


def test_heldout_check_needs_every_column(spark):
    columns = [c for c in S.HELDOUT_COLUMNS if c not in ("checksum", "selection_protocol_version")]
    heldout = spark.createDataFrame([], S.all_strings(columns))
    with pytest.raises(GateError, match=r"missing columns: \['checksum', 'selection_protocol_version'\]"):
        jobs.heldout_check(heldout, heldout, heldout)
