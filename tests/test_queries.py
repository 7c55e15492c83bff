"""Registered queries against DuckDB on the smallest tables, streams included."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SKIP = not os.path.isdir(FOLDER)
# the whole registry takes minutes (`python tests/compare.py`); these cover every family
NAMES = [
    "per_class_metrics", "threshold_sweep", "manifest_violations", "traceability_violations", "cross_split_duplicates", "near_dup_cross_split",
    "enriched_predictions", "graph_edges", "graph_upsert", "square_crop", "apply_review_decisions", "early_stop_trace", "html_plain_text",
    "split_fingerprint", "stream_latest_feedback", "stream_fingerprint", "stream_graph_upsert", "stream_review_rate", "stream_admission",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(SKIP, reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_registry_is_consistent():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 110


@pytest.mark.skipif(SKIP, reason="test tables are not here")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["idx", "class_name", "precision", "recall", "f1_score", "support"] and df.count() == 5
