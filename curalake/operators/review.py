"""Human review: decisions by position, page layout, tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.operators.ranking import ordered_rank
from curalake.session import class_table


def decision_rows(decisions: DataFrame) -> DataFrame:
    """Decision documents (``schemas.DECISIONS_DDL``) -> ``class_name, accepted_index``."""
    return decisions.select(F.explode("accepted_class_indices").alias("class_name", "indices")).select(
        "class_name", F.explode(F.col("indices").cast("array<bigint>")).alias("accepted_index")
    )


def apply_review_decisions(records: DataFrame, decisions: DataFrame, protocol: str, order: str = "file_path",
                           reason: str = "not on the reviewer's list") -> DataFrame:
    """Mark the listed records of each class as accepted and all others as rejected.

    A record's index is its zero-based position in its class by ``order``.
    """
    placed = ordered_rank(records, "class_name", [order], name="_rank").withColumn("accepted_index", F.col("_rank") - 1)
    listed = decisions.select("class_name", "accepted_index", F.lit(True).alias("_hit")).distinct()
    hit = F.coalesce("_hit", F.lit(False))
    note = F.when(hit, F.lit(f"; accepted under {protocol}")).otherwise(
        F.lit(f"; rejected under {protocol}: {reason}")
    )
    return placed.join(listed, ["class_name", "accepted_index"], "left").withColumns({
        "review_status": F.when(hit, "accepted").otherwise("rejected"),
        "review_notes": F.concat(F.coalesce("review_notes", F.lit("")), note),
    }).withColumnRenamed("accepted_index", "record_index").drop("_rank", "_hit", "group_total")


def decision_violations(records: DataFrame, decisions: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Repeated or out-of-range indices and classes without any decision."""
    repeated = decisions.groupBy("class_name", "accepted_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("duplicate_index").alias("rule"), "class_name", "accepted_index"
    )
    sizes = records.groupBy("class_name").agg(F.count(F.lit(1)).alias("size"))
    outside = decisions.distinct().join(sizes, "class_name", "left").filter(
        (F.col("accepted_index") < 0) | (F.col("accepted_index") >= F.coalesce("size", F.lit(0)))
    ).select(F.lit("index_out_of_range").alias("rule"), "class_name", "accepted_index")
    undecided = class_table(records.sparkSession, class_names).join(
        decisions.select("class_name").distinct(), "class_name", "left_anti"
    ).select(F.lit("class_without_decision").alias("rule"), "class_name", F.lit(None).cast("bigint").alias("accepted_index"))
    return repeated.unionByName(outside).unionByName(undecided)


def review_tally(records: DataFrame) -> DataFrame:
    """Counts per class and status with sub-totals (null = all)."""
    return records.rollup("class_name", "review_status").agg(F.count(F.lit(1)).alias("record_count"))


def review_pages(records: DataFrame, per_page: int = 25, columns: int = 5, order: str = "file_path") -> DataFrame:
    """Page, row and column of every record on its class's contact sheets."""
    placed = ordered_rank(records, "class_name", [order], name="_rank").withColumn("record_number", F.col("_rank") - 1)
    local = F.col("record_number") % per_page
    whole = lambda a, b: F.floor(a / b).cast("bigint")
    return placed.withColumns({
        "page": whole(F.col("record_number"), per_page) + 1, "page_row": whole(local, columns), "page_column": local % columns,
    }).drop("_rank", "group_total")


def ordered_records(records: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Configured class order, then path: a range-partitioned global sort."""
    return records.join(class_table(records.sparkSession, class_names), "class_name").orderBy("idx", "file_path")
