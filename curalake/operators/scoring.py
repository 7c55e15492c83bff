"""Batch scoring, argmax predictions and the classification head."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalake.functions.hashing import row_digest
from curalake.functions.probability import argmax, softmax
from curalake.session import class_table, computed

Model = Callable[[np.ndarray], np.ndarray]


def batch_score(df: DataFrame, features: str, load_model: Callable[[], Model], classes: int) -> DataFrame:
    """Adds ``logits``. The model is loaded once per task and fed Arrow batches."""
    schema = T.StructType([*df.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            if len(batch) == 0:
                continue
            logits = np.asarray(model(np.stack([np.asarray(v) for v in batch[features]])), dtype=np.float64)
            if logits.shape != (len(batch), classes):
                raise ValueError(f"model output has shape {logits.shape}, expected ({len(batch)}, {classes})")
            yield batch.assign(logits=list(logits))

    return df.mapInPandas(run, schema)


def softmax_predict(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Adds ``pred_idx`` (first maximum) and ``confidence`` (largest probability)."""
    return computed(df, _p=softmax(F.col(logits))).withColumns({
        "pred_idx": argmax(F.col("_p")), "confidence": F.array_max("_p"),
    }).drop("_p")


def head_fit(df: DataFrame, class_names: Sequence[str], features: str = "features", label: str = "label", iterations: int = 50, strength: float = 1e-3):
    """Class-weighted multinomial logistic regression on frozen features, fitted by Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    known = class_table(df.sparkSession, class_names).select(F.col("idx").alias(label)).join(counts, label, "left")
    weights = {int(r[label]): r["_n"] for r in known.collect()}  # K rows
    if any(n is None for n in weights.values()):
        raise ValueError("every configured class needs at least one training row")
    n = total.first()["_total"]
    weight = F.lit(None).cast("double")
    for idx, count in weights.items():
        weight = F.when(F.col(label) == idx, F.lit(n / (len(class_names) * count))).otherwise(weight)
    rows = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("weight"))
    return LogisticRegression(
        family="multinomial", weightCol="weight", maxIter=iterations, regParam=strength, featuresCol="features", labelCol="label"
    ).fit(rows)


def head_predict(model, df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """``true_idx, pred_idx, confidence`` of a fitted head."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    scored = model.setFeaturesCol("_v").transform(rows)
    p = vector_to_array("probability")
    return scored.select(
        *df.columns, F.col(label).cast("bigint").alias("true_idx"), argmax(p).alias("pred_idx"), F.array_max(p).alias("confidence")
    )


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of a table: row count and a digest over summed row digests.

    Sums do not depend on partitioning or row order and count repeated rows.
    """
    digest = row_digest(*[F.col(c) for c in columns])
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.coalesce(F.sum(w), F.lit(0)).cast("string").alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select("row_count", F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), *[f"w{i}" for i in range(8)]), 256).alias("fingerprint"))


def run_provenance(run_id: str, tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One row per input table of a run: its name, row count and fingerprint."""
    result = None
    for name, (df, columns) in sorted(tables.items()):
        part = table_fingerprint(df, columns).select(F.lit(run_id).alias("run_id"), F.lit(name).alias("table_name"), "row_count", "fingerprint")
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError("at least one table is required")
    return result
