"""A linear classification head fitted by a fixed number of descent steps with order-free sums.

Every step is one pass over the rows: tasks add up gradient contributions rounded to ``1 / SCALE`` as integers, so that
their sum is the same for every partitioning, retry and row order, and any engine can check the coefficients. What a
step gathers is one number per coefficient.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.operators.scoring import softmax_predict
from curalake.session import class_table, materialize

SCALE = 1_000_000
#: Rows whose contributions are held at once.
BLOCK = 1_024


@dataclass(frozen=True)
class Head:
    """Per class: the intercept, then one coefficient per feature."""

    class_names: tuple[str, ...]
    coefficients: tuple[tuple[float, ...], ...]


def class_weights_of(df: DataFrame, class_names: Sequence[str], label: str = "label") -> list[float]:
    """``n / (K * n_k)`` per class in configured order. A class without rows, and a label that is none of them, is an error."""
    class_table(df.sparkSession, class_names)  # checks the names
    counts = df.groupBy(F.when(F.col(label).between(0, len(class_names) - 1), F.col(label)).alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    found = {r["idx"]: r["n"] for r in counts.collect()}  # at most one row per class and one for the rest
    if None in found:
        raise ValueError(f"{found[None]} rows have a label outside the configured classes")
    missing = [name for i, name in enumerate(class_names) if i not in found]
    if missing:
        raise ValueError(f"no training rows of {', '.join(missing)}")
    total = sum(found.values())
    return [total / (len(class_names) * found[i]) for i in range(len(class_names))]


def _gradient(rows: DataFrame, weights: np.ndarray, balance: np.ndarray) -> DataFrame:
    """``place, total``: the scaled integer sum of every coefficient's contributions."""
    classes, size = weights.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(classes * size, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                x = np.ones((len(part), size))
                x[:, 1:] = np.stack(part["x"].tolist())
                y = part["y"].to_numpy(dtype=np.int64)
                z = x @ weights.T
                e = np.exp(z - z.max(axis=1, keepdims=True))
                error = e / e.sum(axis=1, keepdims=True)
                error[np.arange(len(y)), y] -= 1.0
                error *= balance[y][:, None]
                total += np.floor(error[:, :, None] * x[:, None, :] * SCALE + 0.5).sum(axis=0).astype(np.int64).reshape(-1)
        if total.any():
            yield pd.DataFrame({"place": np.arange(len(total)), "part": total})

    parts = rows.mapInPandas(run, "place int, part bigint")
    return parts.groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))


def head_descent(
    df: DataFrame, class_names: Sequence[str], features: str = "features", label: str = "label",
    steps: int = 30, rate: float = 0.5, momentum: float = 0.9, strength: float = 1e-3,
) -> Head:
    """Class-weighted multinomial regression after ``steps`` steps of descent with momentum from zero.

    Rows with a null label or null features take no part; features of unequal length, or with null or non-finite
    components, are an error, as are classes without rows. ``strength`` shrinks all coefficients but the intercepts.
    """
    rows = materialize(df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("bigint").alias("y")).dropna())
    balance = np.array(class_weights_of(rows, class_names, "y"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.count_if(bad).alias("bad")).first()
    if shape["low"] != shape["high"] or shape["bad"]:
        raise ValueError("features must be finite and of one length")
    weights = np.zeros((len(class_names), shape["low"] + 1))
    pace, shrunk = np.zeros_like(weights), np.full_like(weights, strength)
    shrunk[:, 0] = 0.0
    for _ in range(steps):
        total = np.zeros(weights.size)
        for r in _gradient(rows, weights, balance).collect():  # one row per coefficient
            total[r["place"]] = float(int(r["total"]))
        pace = momentum * pace + (total.reshape(weights.shape) / (shape["n"] * float(SCALE)) + shrunk * weights)
        weights = weights - rate * pace
    return Head(tuple(class_names), tuple(tuple(float(v) for v in row) for row in weights))


def head_logits(head: Head, df: DataFrame, features: str = "features") -> DataFrame:
    """Adds ``logits``; built-in functions only."""
    x = F.col(features).cast("array<double>")

    def logit(row: Sequence[float]):
        terms = F.zip_with(x, F.array(*map(F.lit, row[1:])), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(row[0]), lambda total, term: total + term)

    return df.withColumn("logits", F.array(*[logit(row) for row in head.coefficients]))


def head_decisions(head: Head, df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """``df`` with ``true_idx, pred_idx, confidence``."""
    scored = softmax_predict(head_logits(head, df, features)).drop("logits")
    return scored.withColumn("true_idx", F.col(label).cast("bigint"))


def head_table(df: DataFrame, head: Head) -> DataFrame:
    """``class_name, place, coefficient`` (place 0 is the intercept), from the session of ``df``."""
    rows = [(name, i, v) for name, row in zip(head.class_names, head.coefficients, strict=True) for i, v in enumerate(row)]
    return df.sparkSession.createDataFrame(rows, "class_name string, place int, coefficient double")
