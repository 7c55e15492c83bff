"""Fixed values and typed schemas of the curation data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: class order, splits, label maps, defaults -------------------
CLASS_NAMES = ["normal", "scratch", "dent", "rust"]
SPLITS = ["train", "validation", "test"]
UNKNOWN_CLASS = "unknown"
NO_DAMAGE_LABELS = ["normal", "undamaged", "no damage"]
DAMAGE_LABELS = {"dent": "dent", "scratch": "scratch", "corrosion": "rust"}
PANEL_LABELS = [
    "back-bumper", "back-door", "fender", "front-bumper", "front-door",
    "hood", "quarter-panel", "rocker-panel", "roof", "trunk",
]
MEDIA_EXTENSIONS = {"image/jpeg": [".jpg", ".jpeg"], "image/png": [".png"]}
AVAILABILITY_LABELS = {"in_stock": "In stock", "low_stock": "Low stock", "out_of_stock": "Out of stock"}
GRAPH_SOURCE = "neo4j"
FALLBACK_SOURCE = "static_catalog_fallback"
SOURCE_LABELS = {GRAPH_SOURCE: "Neo4j knowledge graph", FALLBACK_SOURCE: "Static catalog fallback"}
UNKNOWN_DISPLAY_NAME = "Unknown / Manual Review"
MINIMUM_CROP = 96
MAXIMUM_OVERLAP = 0.10
MINIMUM_SHORT_SIDE = 256
PREFERRED_SHORT_SIDE = 128
DEFAULT_THRESHOLD = 0.60
DEFAULT_THRESHOLDS = [0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]
MAXIMUM_UPLOAD_BYTES = 10 * 1024 * 1024
PAD_COLOR = (124, 116, 104)
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
HISTOGRAM_EDGES = [0.0, 0.4, 0.6, 0.8, 1.0]

REQUIRED_COLUMNS = ["image_id", "file_path", "class_name", "source", "license", "checksum"]
TRACEABILITY_COLUMNS = [
    "image_id", "file_path", "class_name", "original_label", "source_dataset",
    "source_url", "licence", "checksum", "perceptual_hash", "dataset_split",
]
RECORD_COLUMNS = [
    "file_path", "class_name", "original_label", "source_dataset", "source_url",
    "licence", "source_group", "review_status", "review_notes",
]
MANIFEST_V2_COLUMNS = [
    *TRACEABILITY_COLUMNS, "source_group", "review_status", "review_notes", "source", "license",
]
HELDOUT_COLUMNS = [
    "filename", "expected_class", "original_label", "source_dataset", "source_url", "licence",
    "licence_url", "attribution", "source_group", "checksum", "perceptual_hash",
    "excluded_from_training_validation", "selected_before_inference", "selection_protocol_version",
]
FEEDBACK_COLUMNS = [
    "timestamp", "prediction_id", "image_filename", "image_sha256", "predicted_class",
    "confidence", "is_correct", "corrected_class", "comment",
]
PREDICTION_COLUMNS = [
    "sample_index", "filename", "true_class", "predicted_class", "confidence",
    "requires_manual_review", "is_correct",
]
METRIC_COLUMNS = ["class_name", "precision", "recall", "f1_score", "support"]


def all_strings(columns: list[str]) -> T.StructType:
    """Manifests are read as text so that hex hashes keep their leading zeroes."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


CATALOG_DDL = (
    "object_type string, inventory_last_updated string, confidence_threshold double,"
    "unknown_message string, defects array<struct<class_name:string,display_name:string,"
    "repair_steps:array<string>,parts:array<struct<part_id:string,part_name:string,"
    "mock_price:double,currency:string,fake_stock_quantity:int,availability_status:string>>>>"
)
HISTORY_DDL = (
    "training_metrics array<struct<loss:double,accuracy:double,stage:string,learning_rate:double>>,"
    "validation_metrics array<struct<loss:double,accuracy:double,stage:string,learning_rate:double>>,"
    "best_epoch int, best_validation_loss double, epochs_completed int"
)
DECISIONS_DDL = (
    "reviewer string, review_protocol string, rules array<string>,"
    "accepted_class_indices map<string,array<int>>"
)
