"""The composite jobs. Each is a short chain of operators; gates are its only driver actions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.functions.hashing import stable_id
from curalake.operators import annotations as ann
from curalake.operators import audit as au
from curalake.operators import feedback as fb
from curalake.operators import graph as gr
from curalake.operators import hamming, identity, manifest, metrics, review, sampling, scoring, serving, thresholds
from curalake.operators.violations import gate, ledger, observed
from curalake.sources import tables


def curate_candidates(
    annotations: DataFrame, exclusions: Sequence[DataFrame], requested: Mapping[str, int], seed: int = 42
) -> DataFrame:
    """Annotations -> crop candidates without used groups -> tiered sample per class."""
    fresh = identity.exclude_groups(ann.crop_candidates(annotations), exclusions)
    gate(sampling.sample_shortfall(fresh, requested), "too few candidates remain")
    return sampling.tiered_sample(fresh, requested, seed)


def acquire_candidates(listing: DataFrame, excluded: DataFrame | None, scan: DataFrame, limit: int) -> DataFrame:
    """Licensed listing pages of new groups, as many as requested -> those whose scanned image is large enough."""
    listed = ann.licensed_candidates(listing, excluded, limit)
    gate(ann.candidate_shortfall(listed, limit), "too few licensed candidates")
    return ann.large_candidates(listed, scan)


def bind_reviewed_manifest(
    records: DataFrame, decisions: DataFrame, protocol: str, content: DataFrame,
    class_names: Sequence[str] = tuple(S.CLASS_NAMES), distance: int = 6,
) -> DataFrame:
    """Decisions applied, accepted rows bound to measured content, and the result gated.

    ``content``: ``file_path, actual_checksum, actual_hash``.
    """
    gate(review.decision_violations(records, decisions, class_names), "review decisions")
    decided = review.apply_review_decisions(records, decisions, protocol)
    gate(manifest.accepted_violations(decided, class_names), "accepted records")
    accepted = manifest.accepted_records(decided)
    measured = content.select("file_path", F.col("actual_checksum").alias("checksum"), F.col("actual_hash").alias("perceptual_hash"))
    joined = accepted.join(measured, "file_path", "left")
    gate(joined.filter("checksum IS NULL").select("file_path"), "reviewed images are missing")
    bound = joined.withColumns({
        "image_id": stable_id(F.col("class_name"), F.col("checksum")), "dataset_split": F.lit(""),
        "source": F.col("source_dataset"), "license": F.col("licence"),
    }).select(*S.MANIFEST_V2_COLUMNS)
    gate(manifest.duplicate_keys(bound, ["checksum"]), "exact duplicate images remain")
    gate(hamming.invalid_hashes(bound), "perceptual hashes")
    gate(hamming.near_dup_edges(bound, distance), "perceptual near-duplicates remain")
    gate(manifest.split_compatibility(bound).filter("NOT compatible"), "class counts")
    return bound


def split_and_freeze(source: DataFrame, content: DataFrame, class_names: Sequence[str], path: str, seed: int = 42) -> DataFrame:
    """Gate the source manifest, split it exactly, write it and return the frozen test fingerprint."""
    gate(manifest.manifest_violations(source), "source manifest")
    gate(manifest.class_set_difference(source, class_names), "classes")
    gate(manifest.content_mismatches(source, content), "source images")
    split = sampling.strict_split(manifest.normalize_required(source), seed=seed)
    tables.write_splits(split, path)
    written = source.sparkSession.read.parquet(path)
    return frozen_fingerprint(written)


def frozen_fingerprint(split: DataFrame) -> DataFrame:
    """Fingerprint of the test rows over all manifest columns."""
    test = split.filter(F.col("dataset_split") == "test")
    return scoring.table_fingerprint(test, sorted(c for c in test.columns if c != "dataset_split"))


def validate_splits(
    split: DataFrame, class_names: Sequence[str], content: DataFrame | None = None, frozen: str | None = None,
    traceable: bool = False, distance: int = 6,
) -> None:
    """All split checks in order; the first one with violations raises."""
    gate(identity.cross_split_duplicates(split, S.SPLITS), "cross-split duplicates")
    if "perceptual_hash" in split.columns:
        gate(hamming.invalid_hashes(split), "perceptual hashes")
        gate(hamming.near_dup_cross_split(split, S.SPLITS, distance, pivot="train"), "cross-split near-duplicates")
    if traceable:
        gate(manifest.traceability_violations(split), "traceability")
    if content is not None:
        gate(manifest.content_mismatches(split, content), "images")
    for name in S.SPLITS:
        gate(manifest.class_set_difference(split.filter(F.col("dataset_split") == name), class_names), f"classes of {name}")
    if "found_in" in split.columns:
        gate(manifest.wrong_split_values(split, "found_in"), "dataset_split values")
    gate(manifest.strict_split_counts(split, class_names).filter("NOT ok"), "strict split counts")
    if frozen is not None:
        gate(frozen_fingerprint(split).filter(F.col("fingerprint") != frozen), "frozen test set")


def split_ledger(split: DataFrame, class_names: Sequence[str], path: str, distance: int = 6) -> DataFrame:
    """Write a split table and account for every check instead of stopping at the first: ``position, check_name, violation_count``.

    The row rules are counted by the pass that writes; the checks across rows read what was written, so the input is scanned once.
    """
    manifest.missing_columns_error(split, S.TRACEABILITY_COLUMNS)
    rules = manifest.traceability_rules()
    if "found_in" in split.columns:
        rules["wrong_split"] = ~F.col("found_in").eqNullSafe(F.col("dataset_split"))
    rows, counts = observed(split, rules)
    tables.write_splits(rows, path)
    written = split.sparkSession.read.parquet(path)
    return ledger(split.sparkSession, {rule: counts.get[rule] for rule in rules}, {
        "cross_split_duplicates": identity.cross_split_duplicates(written, S.SPLITS),
        "near_duplicates": hamming.near_dup_cross_split(written, S.SPLITS, distance, pivot="train"),
        **{f"classes_of_{name}": manifest.class_set_difference(written.filter(F.col("dataset_split") == name), class_names) for name in S.SPLITS},
        "strict_split_counts": manifest.strict_split_counts(written, class_names).filter("NOT ok"),
    })


def heldout_ledger(heldout: DataFrame, development: DataFrame, per_class: int = 10, distance: int = 6) -> DataFrame:
    """The held-out rules, leakage and near-duplicates as a ledger; all required columns must be there."""
    manifest.missing_columns_error(heldout, S.HELDOUT_COLUMNS)
    return ledger(heldout.sparkSession, {}, {
        "heldout_manifest": manifest.heldout_manifest_violations(heldout, per_class), "heldout_leakage": identity.heldout_leakage(heldout, development),
        "near_duplicates": hamming.near_dup_between(heldout, development, distance=distance),
    })


@dataclass(frozen=True)
class Audit:
    summary: DataFrame
    crosstab: DataFrame
    source_labels: DataFrame
    sizes: DataFrame
    near_duplicates: DataFrame


def audit(split: DataFrame, distance: int = 6) -> Audit:
    """Audit tables of a split set with ``short_side``, ``orientation`` and ``perceptual_hash``; every hash must be valid."""
    gate(hamming.invalid_hashes(split), "perceptual hashes")
    edges = hamming.near_dup_edges(split, distance)
    return Audit(
        au.audit_summary(split, edges, distance), manifest.class_split_crosstab(split), manifest.source_label_counts(split),
        metrics.size_profile(split), edges,
    )


@dataclass(frozen=True)
class Evaluation:
    predictions: DataFrame
    per_class: DataFrame
    confusion: DataFrame
    accuracy: DataFrame
    f1: DataFrame
    threshold: DataFrame
    confidence: DataFrame
    histogram: DataFrame
    misclassified: DataFrame


def evaluate(
    df: DataFrame, features: str, load_model: Callable[[], scoring.Model], class_names: Sequence[str], threshold: float = S.DEFAULT_THRESHOLD
) -> Evaluation:
    """Score a labelled table once (``true_idx``), write nothing, return every report table."""
    scored = scoring.batch_score(df, features, load_model, len(class_names)).drop(features)
    rows = metrics.prediction_records(scoring.softmax_predict(scored), class_names, threshold).persist()
    gate(metrics.prediction_violations(rows.withColumn("sample_index", F.monotonically_increasing_id()), class_names), "predictions")
    return Evaluation(
        rows, metrics.per_class_metrics(rows, class_names), metrics.confusion_matrix(rows, class_names), metrics.overall_accuracy(rows),
        metrics.macro_weighted_f1(rows, class_names), thresholds.threshold_analysis(rows, class_names, threshold),
        metrics.confidence_summary(rows), metrics.confidence_histogram(rows), metrics.misclassified(rows),
    )


#: The reports of an evaluation that are written: their columns and their form.
REPORTS = {
    "predictions": (S.PREDICTION_COLUMNS, "parquet"), "misclassified": (S.PREDICTION_COLUMNS, "csv"), "per_class": (S.METRIC_COLUMNS, "json"),
}


def write_evaluation(report: Evaluation, folder: str) -> dict[str, str]:
    """Write the reports to folders of their names in ``folder`` and return these.

    All columns are checked before anything is written. Predictions and misclassified rows are written with exactly the
    sink's columns; a report written before is replaced.
    """
    for name, (columns, _) in REPORTS.items():
        manifest.missing_columns_error(getattr(report, name), columns)
    paths = {name: f"{folder}/{name}" for name in REPORTS}
    for name, (columns, form) in REPORTS.items():
        tables.write_report(getattr(report, name).select(*columns), paths[name], columns, form)
    return paths


def heldout_check(heldout: DataFrame, development: DataFrame, results: DataFrame, per_class: int = 10, distance: int = 6) -> DataFrame:
    """Held-out rules, leakage and near-duplicates; then the pass rates of untouched predictions."""
    manifest.missing_columns_error(heldout, S.HELDOUT_COLUMNS)
    gate(manifest.heldout_manifest_violations(heldout, per_class), "held-out manifest")
    gate(identity.heldout_leakage(heldout, development), "held-out leakage")
    named = heldout.withColumn("image_id", F.col("filename"))
    gate(hamming.invalid_hashes(named), "held-out perceptual hashes")
    gate(hamming.invalid_hashes(development), "development perceptual hashes")
    gate(hamming.near_dup_between(named, development, distance=distance), "held-out near-duplicates")
    gate(hamming.near_dup_edges(named.withColumns({"class_name": F.col("expected_class"), "dataset_split": F.lit("heldout")}), distance, ["heldout"]), "near-duplicates inside the held-out set")
    gate(results.filter("feedback_applied"), "saved feedback altered held-out predictions")
    return metrics.heldout_summary(results.withColumn("pass", F.col("predicted_class") == F.col("expected_class")))


def serve_batch(
    uploads: DataFrame, feedback: DataFrame, graph_knowledge: DataFrame, catalog_knowledge: DataFrame,
    class_names: Sequence[str], threshold: float,
) -> DataFrame:
    """Admission, argmax, feedback override and enrichment of a table of uploads with ``logits``.

    Refused uploads keep their status and have no response fields.
    """
    rows = uploads.withColumn("status", serving.upload_status())
    admitted = scoring.softmax_predict(rows.filter("status = 200").drop("status"))
    latest = fb.latest_feedback(feedback, class_names)
    overridden = serving.feedback_override(admitted, latest, threshold, class_names)
    knowledge = serving.knowledge_fallback(catalog_knowledge.select("class_name").union(graph_knowledge.select("class_name")).distinct(), graph_knowledge, catalog_knowledge)
    answered = serving.enriched_predictions(overridden, knowledge)
    return answered.unionByName(rows.filter("status <> 200"), allowMissingColumns=True)


@dataclass(frozen=True)
class FeedbackReport:
    accepted: DataFrame
    rejected: DataFrame
    latest: DataFrame
    daily: DataFrame


def feedback_report(feedback: DataFrame, predictions: DataFrame, class_names: Sequence[str]) -> FeedbackReport:
    """Valid rows with their image hashes, rejected rows with reasons, labels to apply, daily rates."""
    bound = fb.feedback_fingerprint(fb.feedback_valid(feedback, class_names), predictions)
    return FeedbackReport(
        bound, fb.feedback_rejected(feedback, class_names), fb.latest_feedback(bound, class_names), fb.correction_rates(bound)
    )


def seed_and_check_graph(existing: gr.Graph | None, nested: DataFrame, class_names: Sequence[str]) -> tuple[gr.Graph, DataFrame]:
    """Validate a catalog, upsert its graph and gate its completeness; returns graph and seed counts."""
    gate(gr.catalog_violations(nested.withColumn("catalog_id", F.lit("catalog"))), "catalog")
    catalog = gr.flatten_catalog(nested)
    incoming = gr.graph_from_catalog(catalog)
    merged = incoming if existing is None else gr.upsert_graph(existing, incoming)
    gate(gr.graph_completeness(merged, class_names).filter("status <> 'ok'"), "graph completeness")
    return merged, gr.seed_summary(catalog)
