"""Checks return rows ``(rule, subject)``; only :func:`gate` raises."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class GateError(ValueError):
    """A check found violations."""


def row_violations(df: DataFrame, subject: Column, rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule per record, in a single narrow pass."""
    broken = F.filter(
        F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(rule)) for rule, broken in rules.items()]),
        lambda r: r.isNotNull(),
    )
    return df.select(F.explode(broken).alias("rule"), subject.cast("string").alias("subject"))


def observed(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with the numbers of rows that break each rule, and of all rows (``rows``), counted by whatever pass writes it."""
    counts = Observation()
    metrics = [F.count_if(F.coalesce(broken, F.lit(False))).alias(rule) for rule, broken in rules.items()]
    return df.observe(counts, F.count(F.lit(1)).alias("rows"), *metrics), counts


def ledger(spark: SparkSession, counted: Mapping[str, int], checks: Mapping[str, DataFrame]) -> DataFrame:
    """``position, check_name, violation_count``: counts observed on the way, then the number of rows of each violations table."""
    rows = [(i, name, int(n)) for i, (name, n) in enumerate(counted.items())]
    parts = [spark.createDataFrame(rows, "position int, check_name string, violation_count bigint")]
    for i, (name, violations) in enumerate(checks.items(), len(rows)):
        parts.append(violations.agg(F.count(F.lit(1)).alias("violation_count")).select(F.lit(i).alias("position"), F.lit(name).alias("check_name"), "violation_count"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Schema check: needs no job."""
    return sorted(set(required) - set(df.columns))


def count_by_rule(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count(F.lit(1)).alias("violation_count"))


def first_broken(rules: Mapping[str, Column], otherwise: str) -> Column:
    """Cascade: the name of the first rule that is broken."""
    result = None
    for name, broken in rules.items():
        condition = F.coalesce(broken, F.lit(False))
        result = F.when(condition, name) if result is None else result.when(condition, name)
    return F.lit(otherwise) if result is None else result.otherwise(otherwise)


def gate(violations: DataFrame, what: str, shown: int = 20) -> None:
    """Raise with the first few rows of a non-empty violations table."""
    rows = violations.limit(shown).collect()
    if rows:
        raise GateError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))
