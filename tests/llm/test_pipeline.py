"""The pipeline's stages against plain versions, and the registered queries."""

import corpus_pipeline
import __spark_entry__ as entry
from curalake.llm import packing
from llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns and not any(brute.quality(r["text"])[-1] for r in good.collect())
    cut = stages["lines"](spark, good, SF)
    expected = brute.without_longest_runs([(r["doc_id"], r["text"]) for r in good.collect()])
    expected = {i: t for i, t in expected.items() if brute.WORD.search(t)}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    one = stages["near_duplicates"](spark, cut, SF)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, (_, c) in brute.components(expected.items()).items() if i == c)
    mixed = stages["mixing"](spark, one, SF)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in one.collect()}
    packed = stages["packing"](spark, mixed, SF)
    assert packed.groupBy("sequence_id").sum("length").filter(f"`sum(length)` > {packing.TIERS[0]}").count() == 0


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_empty_and_wide_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.selectExpr("*", "1 AS n_removed", "2 AS copy_no", "3 AS lang_key")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert stage(spark, wide, SF).columns == wide.columns, name


def test_sql_of_the_operators(spark):
    from compare import compare, connect

    con = connect("/root/testdata/sf0.01")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            assert not compare(spark, con, "/root/testdata/sf0.01", entry.queries()[name], sql), name
