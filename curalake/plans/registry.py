"""The registered queries: one entry per operator, each over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.functions import geometry, hashing, text
from curalake.operators import (
    annotations, audit, clusters, feedback, graph, hamming, heads, history, identity, images, manifest, metrics, review, sampling, scoring,
    serving, thresholds,
)
from curalake.operators.violations import count_by_rule
from curalake.plans import jobs
from curalake.plans import views as V
from curalake.session import materialize, scratch_path, spread
from curalake.sources import tables
from curalake.streaming import flows, keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
C = S.CLASS_NAMES


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- sources and sinks ------------------------------------------------------------


@query
def scan_manifest(spark, d):
    path = scratch_path(spark, "manifest")
    columns = ["image_id", "file_path", "class_name", "checksum"]
    V.manifest(spark, d).select(columns).write.option("header", True).csv(path)
    return tables.scan_manifest(spark, path, columns)


@query
def manifest_violations(spark, d):
    return manifest.manifest_violations(V.source_manifest(spark, d))


@query
def csv_rejects(spark, d):
    """A written log with short, long and unclosed rows: whole rows and rejects, each with its reason."""
    path, rejects = scratch_path(spark, "log"), scratch_path(spark, "rejects")
    V.table(spark, d, "events").selectExpr(V.LOG_LINE).write.text(path)
    checked = tables.scan_csv_checked(spark, path, ["event_id", "user_id", "event_type", "comment"])
    tables.write_rejects(checked, rejects)
    damaged = spark.read.parquet(rejects).select(F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("comment"), "record", "reason")
    return damaged.unionByName(checked.filter("reason IS NULL").select("event_id", "comment", F.lit(None).cast("string").alias("record"), "reason"))


@query
def incremental_digests(spark, d):
    """Digests of files of a thousand documents; the second scan reads only the odd ones, which came after the first."""
    path, cache = scratch_path(spark, "files"), scratch_path(spark, "digests")
    for odd in (0, 1):
        V.document_files(spark, d).filter(F.col("chunk") % 2 == odd).write.mode("append").partitionBy("lang", "source", "chunk").text(path)
        digests = tables.refresh_digests(spark, path, cache, "*.txt")
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
    return digests.select(part("lang").alias("lang"), part("source").alias("source"), part("chunk").cast("bigint").alias("chunk"), "length", "actual_checksum", "fresh")


@query
def union_splits(spark, d):
    rows = V.split(spark, d)
    columns = ["image_id", "class_name", "source_object_label"]
    frames = {s: rows.filter(F.col("dataset_split") == s).select(columns[: 2 if s == "test" else 3]) for s in S.SPLITS}
    return manifest.union_splits(frames)


def _annotations(spark, d):
    return tables.parse_annotations(V.annotation_documents(spark, d))


@query
def annotation_objects(spark, d):
    rows = annotations.with_objects(_annotations(spark, d))
    return rows.select("annotation_path", F.inline("usable")).select(
        "annotation_path", "title", "label", "box.left", "box.top", "box.right", "box.bottom"
    )


@query
def content_checksum(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("actual_checksum"), F.octet_length("text").cast("bigint").alias("length")
    )


@query
def image_decode_audit(spark, d):
    audited = images.decode_audit(V.images(spark, d))
    return audited.select("path", "decodable", *[F.col(c).cast("bigint").alias(c) for c in ("width", "height", "short_side")])


@query
def folder_class_coverage(spark, d):
    return manifest.folder_class_coverage(V.manifest(spark, d), ["en", "fr", "de", "it"])


@query
def class_table(spark, d):
    names = V.manifest(spark, d).groupBy("class_name").agg(F.min("doc_id").alias("first_doc"))
    return manifest.class_table(spark, C).join(names, "class_name").select("idx", "class_name", "first_doc")


@query
def catalog_violations(spark, d):
    parsed = V.catalog_documents(spark, d).select("catalog_id", F.from_json("document", S.CATALOG_DDL).alias("c")).select("catalog_id", "c.*")
    return graph.catalog_violations(parsed)


@query
def licensed_candidates(spark, d):
    listing = V.pages(spark, d)
    used = listing.filter("page_id % 9 = 0").select(F.concat(F.lit("commons-"), F.col("page_id").cast("string")).alias("source_group"))
    picked = annotations.licensed_candidates(listing, used, 100)
    return picked.select("page_id", "source_group", "title", "licence", text.plain_text(F.col("artist_html")).alias("artist"))


@query
def split_fingerprint(spark, d):
    rows = V.split(spark, d).filter("dataset_split = 'test'")
    return scoring.table_fingerprint(rows, ["image_id", "class_name", "checksum"])


@query
def safe_destination(spark, d):
    rows = V.split(spark, d).withColumn("image_id", F.concat(F.lit("doc "), F.col("doc_id"), F.lit("/"), F.col("class_name"), F.lit("#")))
    return manifest.with_destination(rows).select("doc_id", "destination")


@query
def feedback_append(spark, d):
    path = scratch_path(spark, "feedback-log")
    rows = feedback.feedback_valid(V.feedback(spark, d), C)
    tables.append_feedback(rows.filter("is_correct"), path)
    tables.append_feedback(rows.filter("NOT is_correct"), path)
    return spark.read.parquet(path).select("prediction_id", "predicted_class", "is_correct", "corrected_class")


@query
def feedback_upgrade(spark, d):
    legacy = V.feedback(spark, d).select(
        F.col("seq").alias("timestamp"), "prediction_id", "image_filename", "predicted_class", "is_correct", "corrected_class", "comment"
    )
    return feedback.feedback_upgrade(legacy)


# ---- projections, filters, rules --------------------------------------------------


@query
def normalize_required(spark, d):
    rows = V.source_manifest(spark, d).withColumn("source", F.when(F.length("image_id") % 2 == 0, F.concat(F.lit("  "), "source")))
    return manifest.normalize_required(rows).select(*S.REQUIRED_COLUMNS)


@query
def traceability_violations(spark, d):
    rows = V.hashed_split(spark, d).withColumns({
        "original_label": F.col("source_object_label"),
        "perceptual_hash": F.when(F.col("doc_id") % 103 == 0, "").otherwise(F.col("perceptual_hash")),
        "checksum": F.when(F.col("doc_id") % 107 == 0, F.concat("checksum", F.lit("\n"))).otherwise(F.col("checksum")),
    })
    return manifest.traceability_violations(rows)


@query
def accepted_records(spark, d):
    return manifest.accepted_records(V.records(spark, d)).select("file_path", "class_name", "review_status")


@query
def accepted_violations(spark, d):
    return manifest.accepted_violations(V.records(spark, d), [*C[:3], "chip"])


def _records(spark, d, threshold=0.65):
    return metrics.prediction_records(V.predictions(spark, d), C, threshold)


@query
def misclassified(spark, d):
    return metrics.misclassified(_records(spark, d)).select("sample_index", "true_class", "predicted_class", "confidence")


@query
def manual_review(spark, d):
    return _records(spark, d).select("sample_index", "confidence", "requires_manual_review", "is_correct")


@query
def upload_admission(spark, d):
    return V.uploads(spark, d).select("event_id", serving.upload_admitted().alias("admitted"))


@query
def upload_status(spark, d):
    return V.uploads(spark, d).select("event_id", serving.upload_status().cast("bigint").alias("status"))


@query
def feedback_valid(spark, d):
    return feedback.feedback_valid(V.feedback(spark, d), C).select("seq", "prediction_id", "predicted_class", "corrected_class")


@query
def feedback_rejected(spark, d):
    return feedback.feedback_rejected(V.feedback(spark, d), C).select("seq", F.array_join(F.array_sort("errors"), ",").alias("errors"))


@query
def annotation_admission(spark, d):
    return annotations.with_objects(_annotations(spark, d)).select("annotation_path", "status")


@query
def label_map(spark, d):
    rows = annotations.with_objects(_annotations(spark, d)).filter("source_kind = 'damage'").select(F.explode("usable.label").alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("class_name", annotations.mapped_class(F.col("label")))


@query
def demo_manifest_violations(spark, d):
    return manifest.heldout_manifest_violations(V.heldout(spark, d))


@query
def class_distribution(spark, d):
    return manifest.class_coverage(V.manifest(spark, d), [*C[:3], "chip"])


@query
def split_label_violations(spark, d):
    rows = V.split(spark, d).withColumn("found_in", F.when(F.col("doc_id") % 51 == 0, "train").otherwise(F.col("dataset_split")))
    return manifest.wrong_split_values(rows, "found_in").select("image_id", "dataset_split", "found_in")


@query
def graph_completeness(spark, d):
    g = graph.graph_from_catalog(V.supplier_catalog(spark, d))
    # one supplier plays the normal class, which must not have guidance
    names = [f"sup-{i}" for i in range(1, 6)] + ["sup-0"]
    return graph.graph_completeness(g, names, normal="sup-2")


@query
def digest_mismatches(spark, d):
    rows = V.manifest(spark, d)
    recorded = rows.withColumn("checksum", F.when(F.col("doc_id") % 33 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.upper("checksum")))
    content = rows.filter("doc_id % 40 <> 0").select(
        "file_path", F.sha2(F.encode("text", "UTF-8"), 256).alias("actual_checksum"), (F.col("doc_id") % 45 != 0).alias("decodable")
    )
    return manifest.content_mismatches(recorded, content)


@query
def prediction_violations(spark, d):
    rows = V.predictions(spark, d).withColumns({
        "pred_idx": F.when(F.col("sample_index") % 89 == 0, F.lit(4)).otherwise(F.col("pred_idx")),
        "confidence": F.when(F.col("sample_index") % 97 == 0, F.col("confidence") + 1.0).otherwise(F.col("confidence")),
    })
    return metrics.prediction_violations(rows, C)


# ---- identity and near-duplicates --------------------------------------------------


@query
def cross_split_duplicates(spark, d):
    return identity.cross_split_duplicates(V.split(spark, d), S.SPLITS)


@query
def near_dup_cross_split(spark, d):
    found = hamming.near_dup_cross_split(V.hashed_split(spark, d), S.SPLITS, 6, pivot="train")
    return found.select("line", "first_hash", "second_hash", "first_count", "second_count", "pair_count")


@query
def near_dup_all(spark, d):
    return hamming.near_dup_edges(V.hashed_split(spark, d), 6)


@query
def near_dup_members(spark, d):
    rows = materialize(V.hashed_split(spark, d).select("image_id", "perceptual_hash", "dataset_split", "class_name"))
    return hamming.near_dup_members(rows, hamming.near_dup_edges(rows, 6))


@query
def near_dup_clusters(spark, d):
    rows = materialize(V.hashed_split(spark, d).select("image_id", "perceptual_hash", "dataset_split", "class_name"))
    return clusters.near_dup_clusters(rows, hamming.near_dup_edges(rows, 6))


@query
def near_dup_all_refined(spark, d):
    """``near_dup_all`` with buckets of 64 rows at most: hot buckets are banded again and cut into blocks."""
    return hamming.near_dup_edges(V.hashed_split(spark, d), 6, hot=64)


@query
def near_dup_two_tables(spark, d):
    found = hamming.near_dup_between(V.heldout(spark, d), V.development(spark, d), distance=6)
    return found.select("line", "first_hash", "second_hash", "pair_count")


@query
def heldout_leakage(spark, d):
    return identity.heldout_leakage(*V.parted(spark, d))


@query
def heldout_intersect(spark, d):
    return identity.shared_values(*V.parted(spark, d), "checksum")


@query
def exclude_used_groups(spark, d):
    rows = V.records(spark, d)
    tests = V.split(spark, d).filter("dataset_split = 'test'")
    return identity.exclude_groups(rows, [V.parted(spark, d)[0], tests]).select("image_id", "source_group")


@query
def duplicate_keys(spark, d):
    return manifest.duplicate_keys(V.manifest(spark, d), ["file_path", "image_id", "checksum", "source_group"])


@query
def pick_listed(spark, d):
    listed = V.table(spark, d, "labels").selectExpr("CASE WHEN doc_id % 10 = 3 THEN concat('gone-', doc_id) ELSE concat('doc-', doc_id) END AS image_id")
    return identity.pick_listed(V.manifest(spark, d).select("image_id", "class_name"), listed, "image_id")


@query
def hash_violations(spark, d):
    rows = V.hashed_manifest(spark, d).withColumn(
        "perceptual_hash", F.when(F.col("doc_id") % 61 == 0, " ").when(F.col("doc_id") % 67 == 0, "xyz").otherwise(F.col("perceptual_hash"))
    )
    return hamming.invalid_hashes(rows)


# ---- graph, feedback, serving -------------------------------------------------------


def _catalog(spark, d):
    """The catalog with its parts computed once, for queries that derive several tables from it."""
    catalog = V.supplier_catalog(spark, d)
    return graph.Catalog(catalog.defects, catalog.steps, materialize(catalog.parts))


@query
def graph_nodes(spark, d):
    return graph.graph_nodes(graph.graph_from_catalog(_catalog(spark, d)))


@query
def graph_edges(spark, d):
    return graph.graph_edges(graph.graph_from_catalog(_catalog(spark, d)))


@query
def graph_upsert(spark, d):
    old = V.table(spark, d, "part").selectExpr("concat('P', p_partkey) AS inventory_id", "p_retailprice AS mock_price", "p_size AS stock")
    new = V.table(spark, d, "lineitem").selectExpr(
        "concat('P', l_partkey * 2) AS inventory_id", "l_extendedprice AS mock_price", "cast(l_quantity AS int) AS stock", "l_orderkey AS seq"
    )
    return graph.upsert(old, new, ["inventory_id"], order=["seq"])


@query
def graph_store(spark, d):
    """A catalog seeded twice into stored tables: the first time with other names and fewer suppliers."""
    catalog = _catalog(spark, d)
    early = lambda df: df.filter("class_name NOT LIKE '%3'")
    first = graph.Catalog(
        early(catalog.defects).withColumn("display_name", F.lit("old")), early(catalog.steps).withColumn("instruction", F.lit("old")),
        early(catalog.parts).withColumns({"part_name": F.lit("old"), "availability_status": F.lit("old")}),
    )
    store = keyed.GraphStore(spark, scratch_path(spark, "graph"), 2)
    for seeded in (first, catalog):
        store.seed(graph.graph_from_catalog(seeded))
    return graph.graph_nodes(store.read(graph.graph_from_catalog(catalog)))


@query
def graph_seed_summary(spark, d):
    return graph.seed_summary(V.supplier_catalog(spark, d))


@query
def repair_step_ids(spark, d):
    return V.supplier_catalog(spark, d).steps.withColumn("step_id", graph.step_id(F.col("class_name"), F.col("position")))


@query
def defect_lookup(spark, d):
    keys = V.table(spark, d, "lineitem").selectExpr("l_orderkey", "concat(' SUP-', l_suppkey + l_linenumber % 2 * 5, ' ') AS class_name")
    found = graph.defect_lookup(keys, V.supplier_catalog(spark, d).defects)
    return found.groupBy("found_class", "display_name").agg(F.count(F.lit(1)).alias("n"))


@query
def parts_for_defect(spark, d):
    g = graph.graph_from_catalog(_catalog(spark, d))
    return graph.parts_for_defect(g, g.defect)


@query
def repair_steps_for_defect(spark, d):
    return graph.repair_steps_for_defect(graph.graph_from_catalog(V.supplier_catalog(spark, d)))


@query
def inventory_last_updated(spark, d):
    return graph.inventory_last_updated(graph.graph_from_catalog(V.supplier_catalog(spark, d)).inventory)


@query
def knowledge_fallback(spark, d):
    defects = V.supplier_catalog(spark, d).defects.select("class_name", "display_name")
    number = F.substring_index("class_name", "-", -1).cast("bigint")
    keys = V.table(spark, d, "orders").selectExpr("o_orderkey", "concat('sup-', o_custkey % 120) AS class_name")
    return serving.knowledge_fallback(
        keys, defects.filter(number % 5 != 0), defects.filter(number % 35 != 0).withColumn("display_name", F.concat(F.lit("static "), "display_name"))
    )


@query
def latest_feedback(spark, d):
    return feedback.latest_feedback(V.feedback(spark, d), C)


def _overridden(spark, d):
    return serving.feedback_override(V.predictions(spark, d), feedback.latest_feedback(V.feedback(spark, d), C), 0.65, C)


@query
def feedback_override(spark, d):
    return _overridden(spark, d).select(
        "sample_index", "most_likely_class", "predicted_class", "feedback_applied", "requires_manual_review", "message"
    )


@query
def enriched_predictions(spark, d):
    known = graph.knowledge_records(V.panel_catalog(spark, d))
    # the graph knows two classes, the static catalog three: one class is in neither
    classes = known.select("class_name")
    knowledge = serving.knowledge_fallback(
        classes, known.filter(F.col("class_name").isin("scratch", "dent")), known.filter("class_name <> 'rust'")
    ).filter("knowledge_source IS NOT NULL")
    found = serving.enriched_predictions(_overridden(spark, d), knowledge)
    return found.select(
        "sample_index", "most_likely_class", "predicted_class", "display_name", "requires_manual_review", "feedback_applied", "message",
        F.col("status").cast("bigint").alias("status"), "step_count", "part_count", "inventory_last_updated", "knowledge_source",
    )


@query
def feedback_fingerprint(spark, d):
    return feedback.feedback_fingerprint(V.feedback(spark, d), V.prediction_log(spark, d)).select("seq", "prediction_id", "image_sha256")


@query
def correction_rate(spark, d):
    rates = feedback.correction_rates(V.feedback(spark, d))
    return rounded(rates.withColumn("day", F.date_format("day", "yyyy-MM-dd")), "correction_rate")


@query
def table_health(spark, d):
    def fresh(name, stamp, since):
        latest = V.table(spark, d, name).agg(F.max(stamp).alias("latest"))
        return latest.select(F.lit(name if name != "lineitem" else "graph").alias("dependency"), (F.col("latest") >= F.lit(since).cast("timestamp_ntz")).alias("up"))

    return serving.table_health(fresh("lineitem", "l_shipdate", "1999-01-01").unionByName(fresh("events", "ts", "2030-01-01")).unionByName(fresh("orders", "o_orderdate", "1995-01-01")))


# ---- review ---------------------------------------------------------------------------


def _decisions(spark, d):
    return V.table(spark, d, "documents").selectExpr(
        "CASE lang WHEN 'en' THEN 'normal' WHEN 'fr' THEN 'scratch' WHEN 'de' THEN 'dent' ELSE 'rust' END AS class_name", "doc_id div 3 AS accepted_index"
    ).filter("accepted_index % 2 = 0").distinct()


@query
def apply_review_decisions(spark, d):
    decided = review.apply_review_decisions(V.records(spark, d), _decisions(spark, d), "protocol-2")
    return decided.select("file_path", "class_name", "record_index", "review_status", "review_notes")


@query
def decision_violations(spark, d):
    twice = _decisions(spark, d).filter("class_name <> 'rust'")
    return review.decision_violations(V.records(spark, d), twice.unionByName(twice.filter("accepted_index % 5 = 0")), C)


@query
def review_tally(spark, d):
    return review.review_tally(V.records(spark, d))


@query
def review_pages(spark, d):
    return review.review_pages(V.records(spark, d)).select("file_path", "class_name", "record_number", "page", "page_row", "page_column")


@query
def ordered_records(spark, d):
    return review.ordered_records(V.records(spark, d), C).select("idx", "file_path", "class_name")


@query
def review_sample(spark, d):
    return sampling.review_sample(V.manifest(spark, d)).select("image_id", "class_name")


# ---- annotations and geometry -----------------------------------------------------------


@query
def ambiguous_overlap(spark, d):
    rows = annotations.scored_objects(_annotations(spark, d)).filter("source_kind = 'damage'").select("annotation_path", F.inline("scored"))
    return rounded(rows.select("annotation_path", "title", "overlap", (F.col("overlap") <= S.MAXIMUM_OVERLAP).alias("eligible")), "overlap")


@query
def largest_object(spark, d):
    return annotations.crop_candidates(_annotations(spark, d)).select("annotation_path", "class_name", "source_label")


@query
def square_crop(spark, d):
    found = annotations.crop_candidates(_annotations(spark, d))
    return found.select("annotation_path", "source_group", geometry.crop_json(F.col("crop_box")).alias("crop_box"), F.col("short_side").cast("bigint").alias("short_side"))


@query
def scaled_crop(spark, d):
    found = annotations.crop_candidates(_annotations(spark, d))
    box = geometry.scaled_crop(F.col("crop_box"), F.col("annotation_width"), F.col("annotation_height"), F.lit(1021), F.lit(747))
    return found.select("annotation_path", geometry.crop_json(box).alias("crop_box"))


@query
def box_geometry(spark, d):
    c = F.col
    rows = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        geometry.box(c("l_partkey") % 600, c("l_suppkey") % 400, c("l_partkey") % 600 + 20 + c("l_quantity") * 3, c("l_suppkey") % 400 + c("l_tax") * 1000).alias("a"),
        geometry.box(c("l_suppkey") % 500, c("l_partkey") % 300, c("l_suppkey") % 500 + 90, c("l_partkey") % 300 + 80).alias("b"),
    )
    return rounded(rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geometry.area(c("a")).alias("area"), geometry.covered_fraction(c("a"), c("b")).alias("covered")
    ), "area", "covered")


@query
def path_rewrite(spark, d):
    return V.annotation_documents(spark, d).select("annotation_path", text.image_path(F.col("annotation_path")).alias("image_path"))


@query
def raw_url(spark, d):
    path = F.concat(F.lit("set a/img/"), F.col("url"))
    return V.table(spark, d, "pages").select(
        "page_id", text.raw_url("https://host.example/datasets/", F.lit("owner/data set"), F.lit("rev/1"), path).alias("url")
    )


# ---- scalar functions ---------------------------------------------------------------------


@query
def stable_ids(spark, d):
    return V.manifest(spark, d).select("doc_id", hashing.stable_id(F.col("class_name"), F.col("checksum")).alias("stable_id"))


@query
def difference_hash(spark, d):
    return V.hashed_manifest(spark, d).select("image_id", "perceptual_hash")


@query
def hamming_distance(spark, d):
    rows = V.hashed_manifest(spark, d)
    return rows.select("image_id", hashing.hex_hamming(F.col("perceptual_hash"), F.upper(F.substring("checksum", 1, 16))).alias("distance"))


@query
def html_plain_text(spark, d):
    return spread(V.table(spark, d, "pages").select("page_id", "html")).select("page_id", text.plain_text(F.col("html")).alias("plain"))


@query
def display_labels(spark, d):
    return V.table(spark, d, "part").select(
        "p_partkey", text.title_case(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-x"))).alias("title"),
        text.availability_label(F.expr("get(array(' In_Stock ', 'low_stock', 'OUT_OF_STOCK', 'on_order'), cast(p_size % 4 AS int))")).alias("availability"),
        text.file_size_label(F.col("p_partkey") * F.col("p_partkey") * 7).alias("file_size"),
        text.source_label(F.when(F.col("p_size") % 2 == 0, S.GRAPH_SOURCE).otherwise("other")).alias("source"),
    )


# ---- aggregations ---------------------------------------------------------------------------


@query
def class_counts(spark, d):
    return manifest.class_counts(V.manifest(spark, d), [*C, "chip"])


@query
def split_compatibility(spark, d):
    return manifest.split_compatibility(V.manifest(spark, d))


@query
def strict_split_counts(spark, d):
    return manifest.strict_split_counts(V.split(spark, d), [*C, "chip"])


@query
def class_split_crosstab(spark, d):
    return manifest.class_split_crosstab(V.split(spark, d), [*C, "chip"])


@query
def source_label_counts(spark, d):
    return manifest.source_label_counts(V.manifest(spark, d))


@query
def normal_certification(spark, d):
    return manifest.normal_certification(V.manifest(spark, d))


@query
def size_profile(spark, d):
    return metrics.size_profile(V.manifest(spark, d))


@query
def audit_summary(spark, d):
    rows = materialize(V.hashed_split(spark, d).withColumn("orientation", F.when(F.col("doc_id") % 19 == 0, 6).otherwise(1)))
    return audit.audit_summary(rows, hamming.near_dup_edges(rows, 6), pairs=True)


@query
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(V.predictions(spark, d), [*C, "chip"])


@query
def per_class_metrics(spark, d):
    return rounded(metrics.per_class_metrics(V.predictions(spark, d), [*C, "chip"]), "precision", "recall", "f1_score")


@query
def overall_accuracy(spark, d):
    return rounded(metrics.overall_accuracy(V.predictions(spark, d)), "accuracy")


@query
def macro_weighted_f1(spark, d):
    return rounded(metrics.macro_weighted_f1(V.predictions(spark, d), [*C, "chip"]), "macro_f1", "weighted_f1")


def _flat(df):
    return rounded(df.select(
        "confidence_threshold", "sample_count", "accepted_count", "rejected_count", "accepted_error_count", "coverage", "manual_review_rate",
        "accepted_accuracy", *[F.col("rejected_by_true_class")[c].alias(f"rejected_{c}") for c in C], "mean_confidence_correct", "mean_confidence_incorrect",
    ), "coverage", "manual_review_rate", "accepted_accuracy", "mean_confidence_correct", "mean_confidence_incorrect")


@query
def threshold_analysis(spark, d):
    return _flat(thresholds.threshold_analysis(V.predictions(spark, d), C, 0.65))


@query
def threshold_sweep(spark, d):
    return _flat(thresholds.threshold_sweep(V.predictions(spark, d), C))


@query
def select_threshold(spark, d):
    return _flat(thresholds.select_threshold(V.predictions(spark, d), C, minimum_coverage=0.5))


@query
def confidence_summary(spark, d):
    return rounded(metrics.confidence_summary(V.predictions(spark, d)), "mean", "min", "median", "max")


@query
def confidence_histogram(spark, d):
    return metrics.confidence_histogram(V.predictions(spark, d))


def _results(spark, d, wrong):
    rows = _records(spark, d)
    shown = F.when(F.col("sample_index") % wrong == 0, F.lit("unknown")).otherwise(F.col("predicted_class"))
    return rows.select(F.col("sample_index").alias("filename"), F.col("true_class").alias("expected_class"), shown.alias("predicted_class"))


@query
def heldout_summary(spark, d):
    rows = _results(spark, d, 7)
    return rounded(metrics.heldout_summary(rows.withColumn("pass", F.col("expected_class") == F.col("predicted_class"))), "accuracy")


@query
def version_comparison(spark, d):
    return rounded(metrics.version_comparison(_results(spark, d, 3), _results(spark, d, 7)), "old_accuracy", "new_accuracy", "gain")


@query
def class_weights(spark, d):
    return rounded(metrics.class_weights(V.manifest(spark, d), C), "weight")


@query
def acquisition_yield(spark, d):
    return manifest.acquisition_yield(V.pages(spark, d).filter("licence_url <> ''"), 120)


@query
def run_provenance(spark, d):
    return scoring.run_provenance("run-1", {
        "documents": (V.table(spark, d, "documents"), ["doc_id", "lang", "source", "n_chars"]),
        "labels": (V.table(spark, d, "labels"), ["doc_id", "quality", "toxic"]),
        "orders": (V.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
    })


@query
def violation_counts(spark, d):
    return count_by_rule(manifest.manifest_violations(V.source_manifest(spark, d)))


# ---- ranking and sampling --------------------------------------------------------------------


@query
def stratified_split(spark, d):
    return sampling.stratified_split(V.manifest(spark, d).drop("text"), trim=True).select("image_id", "class_name", "dataset_split")


@query
def balanced_sample(spark, d):
    return sampling.balanced_sample(V.manifest(spark, d).drop("text"), 100, identity="image_id").select("image_id", "class_name")


@query
def tiered_sample(spark, d):
    wanted = {"scratch": 60, "dent": 45, "rust": 30}
    return sampling.tiered_sample(V.manifest(spark, d).drop("text"), wanted, identity="image_id").select("image_id", "class_name", "short_side")


@query
def sample_shortfall(spark, d):
    return sampling.sample_shortfall(V.manifest(spark, d), {"scratch": 10**6, "dent": 45, "chip": 30})


@query
def best_epoch(spark, d):
    return history.best_epoch(V.history(spark, d))


@query
def early_stop_trace(spark, d):
    return history.early_stop_trace(V.history(spark, d), patience=2)


@query
def softmax_predict(spark, d):
    found = scoring.softmax_predict(V.table(spark, d, "embeddings").selectExpr("vec_id", "embedding AS logits"))
    return rounded(found.select("vec_id", "pred_idx", "confidence"), "confidence")


@query
def class_set_difference(spark, d):
    return manifest.class_set_difference(V.manifest(spark, d), [*C[:3], "chip"])


# ---- scoring, heads, images ---------------------------------------------------------------------


def _block_model():
    """A fixed linear model: each class sums its quarter of the 64 features."""
    return lambda x: x.astype(np.float64).reshape(len(x), 4, 16).sum(axis=2)


@query
def batch_score(spark, d):
    scored = scoring.batch_score(V.table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", _block_model, 4)
    return rounded(scoring.softmax_predict(scored).select("vec_id", "pred_idx", "confidence"), "confidence")


def _head(spark, d):
    """Labelled rows, a fifth of them marked for validation by hash, and the head fitted on the rest."""
    rows = V.table(spark, d, "embeddings").selectExpr(
        "vec_id", "embedding AS features", "cast(label % 4 AS bigint) AS label", "cast(conv(substring(md5(cast(vec_id AS string)), 1, 8), 16, 10) AS bigint) % 5 = 0 AS validation"
    )
    return rows, heads.head_descent(rows.filter("NOT validation"), C)


@query
def head_coefficients(spark, d):
    return rounded(heads.head_table(*_head(spark, d)), "coefficient")


@query
def head_fit(spark, d):
    rows, head = _head(spark, d)
    return heads.head_decisions(head, rows).select("vec_id", "validation", "true_idx", "pred_idx", F.round("confidence", 3).alias("confidence"))


@query
def head_threshold(spark, d):
    rows, head = _head(spark, d)
    return _flat(thresholds.select_threshold(heads.head_decisions(head, rows.filter("validation")), C))


@query
def image_features(spark, d):
    features = images.image_features(V.images(spark, d), 16)
    return features.select("doc_id", F.size("features").alias("n"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query
def image_luma_range(spark, d):
    return images.image_luma_range(V.images(spark, d))


@query
def image_difference_hash(spark, d):
    return images.image_grids(V.images(spark, d)).select("doc_id", hashing.grid_difference_hash(F.col("grid")).alias("perceptual_hash"))


# ---- composite jobs --------------------------------------------------------------------------------


def _found(ledger):
    return ledger.filter("violation_count > 0").select("check_name", "violation_count")


def _stacked(*parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


@query
def job_validate_splits(spark, d):
    rows = V.hashed_split(spark, d).withColumns({
        "original_label": F.col("source_object_label"), "found_in": F.when(F.col("doc_id") % 51 == 0, "train").otherwise(F.col("dataset_split")),
        "checksum": F.when(F.col("doc_id") % 107 == 0, F.concat("checksum", F.lit("\n"))).otherwise(F.col("checksum")),
    })
    return _found(jobs.split_ledger(rows, C, scratch_path(spark, "splits")))


@query
def job_audit(spark, d):
    rows = materialize(V.hashed_split(spark, d).withColumn("orientation", F.when(F.col("doc_id") % 19 == 0, 6).otherwise(1)))
    report = jobs.audit(rows)
    long = lambda df, section, names: df.select(F.lit(section).alias("section"), "class_name", F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.expr(value).cast("bigint").alias("value")) for name, value in names.items()])))
    summary = report.summary
    return _stacked(
        long(summary.withColumn("class_name", F.lit(None).cast("string")), "summary", {c: c for c in summary.columns}),
        long(report.crosstab, "crosstab", {s: s for s in S.SPLITS}), long(report.sizes, "sizes", {"below_128_count": "below_128_count", "double_median": "2 * short_side_median"}),
        report.source_labels.select(F.lit("source_labels").alias("section"), "class_name", F.col("source_object_label").alias("name"), F.col("record_count").alias("value")),
    )


@query
def job_evaluate(spark, d):
    rows = V.table(spark, d, "embeddings").selectExpr("vec_id AS sample_index", "embedding", "cast(label % 4 AS bigint) AS true_idx")
    report = jobs.evaluate(rows, "embedding", _block_model, C, 0.65)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit("predictions").alias("section"), F.lit(name).alias("name"), "value")
    return _stacked(
        report.confusion.select(F.lit("confusion").alias("section"), F.concat_ws(">", "true_class", "predicted_class").alias("name"), F.col("n").alias("value")),
        count(report.predictions, "rows"), count(report.misclassified, "misclassified"), count(report.predictions.filter("requires_manual_review"), "manual_review"),
    )


@query
def job_write_evaluation(spark, d):
    """The written predictions, misclassified rows and metrics, read again."""
    rows = V.table(spark, d, "embeddings").selectExpr(
        "vec_id AS sample_index", "concat('img, ', vec_id, '.png') AS filename", "embedding", "cast(label % 4 AS bigint) AS true_idx"
    )
    report = jobs.evaluate(rows, "embedding", _block_model, C)
    schemas = {name: getattr(report, name).select(*columns).schema for name, (columns, _) in jobs.REPORTS.items()}
    paths = jobs.write_evaluation(report, scratch_path(spark, "evaluation"))
    back = {name: tables.scan_report(spark, paths[name], schemas[name], form) for name, (_, form) in jobs.REPORTS.items()}
    flags = ["sample_index", "filename", "true_class", "predicted_class", "requires_manual_review", "is_correct"]
    listed = lambda name: back[name].select(F.lit(name).alias("report"), *flags, F.round("confidence", 6).alias("value"))
    metric = back["per_class"].select(F.lit("per_class").alias("report"), F.col("class_name").alias("true_class"), F.round("recall", 6).alias("value"))
    return listed("predictions").unionByName(listed("misclassified")).unionByName(metric, allowMissingColumns=True)


@query
def job_heldout_check(spark, d):
    heldout = V.heldout(spark, d)
    known = {c: F.lit("recorded") for c in S.HELDOUT_COLUMNS if c not in heldout.columns}
    return _found(jobs.heldout_ledger(heldout.withColumns(known) if known else heldout, V.development(spark, d)))


@query
def job_feedback_report(spark, d):
    report = jobs.feedback_report(V.feedback(spark, d), V.prediction_log(spark, d), C)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit("rows").alias("section"), F.lit(name).alias("name"), "value")
    errors = report.rejected.select(F.explode("errors").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("value"))
    return _stacked(
        count(report.accepted, "accepted"), count(report.rejected, "rejected"), errors.select(F.lit("errors").alias("section"), "name", "value"),
        report.daily.select(F.lit("corrections").alias("section"), F.date_format("day", "yyyy-MM-dd").alias("name"), F.col("correction_count").alias("value")),
    )


# ---- streaming ------------------------------------------------------------------------------------


def _event_stream(spark, d):
    schema = V.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query
def stream_admission(spark, d):
    out = flows.admit_feedback(_event_stream(spark, d).selectExpr(*V.FEEDBACK), C, scratch_path(spark, "admission"))
    return out.select("seq", "admitted", "errors")


@query
def stream_latest_feedback(spark, d):
    return flows.latest_labels(_event_stream(spark, d).selectExpr(*V.FEEDBACK), C, scratch_path(spark, "labels"))


@query
def stream_override(spark, d):
    latest = flows.latest_labels(_event_stream(spark, d).selectExpr(*V.FEEDBACK), C, scratch_path(spark, "labels"))
    stream = _event_stream(spark, d).selectExpr(
        "event_id AS sample_index", "user_id % 4 AS true_idx", "CASE WHEN event_type = 'error' THEN (user_id + 1) % 4 ELSE user_id % 4 END AS pred_idx",
        "cast(event_id * 7919 % 1001 AS double) / 1000 AS confidence", V.PREDICTED_IMAGE,
    )
    found = flows.overridden_predictions(stream, latest, 0.65, C, scratch_path(spark, "override"))
    return found.select("sample_index", "predicted_class", "feedback_applied", "requires_manual_review")


@query
def stream_fingerprint(spark, d):
    log = _event_stream(spark, d).filter("event_type = 'view'").selectExpr(*V.PREDICTION_LOG)
    rows = _event_stream(spark, d).selectExpr(*V.FEEDBACK)
    found = flows.fingerprinted_feedback(rows, log, scratch_path(spark, "fingerprint"), delay="1 day")
    return found.select("seq", "prediction_id", "image_sha256")


@query
def stream_review_rate(spark, d):
    stream = _event_stream(spark, d).selectExpr("cast(ts AS timestamp) AS timestamp", "cast(event_id * 7919 % 1001 AS double) / 1000 AS confidence")
    found = flows.review_rates(stream, 0.65, scratch_path(spark, "rates"))
    return rounded(found.withColumn("day", F.date_format("day", "yyyy-MM-dd")), "review_rate")


@query
def stream_graph_upsert(spark, d):
    schema = V.table(spark, d, "lineitem").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d).selectExpr(
        "concat('P', l_partkey * 2) AS inventory_id", "l_extendedprice AS mock_price", "cast(l_quantity AS int) AS stock", "l_orderkey AS seq"
    )
    old = V.table(spark, d, "part").selectExpr("concat('P', p_partkey) AS inventory_id", "p_retailprice AS mock_price", "p_size AS stock")
    return flows.upserted(feed, old, ["inventory_id"], ["seq"], scratch_path(spark, "upsert"))
