"""Structured Streaming flows.

Every flow drains its input with ``availableNow`` and writes to a folder below the
shared scratch path, so that a restarted query continues from its checkpoint. A
batch writes its own sub-folder with overwrite: replaying it changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curalake.operators import feedback as fb
from curalake.operators.serving import feedback_override
from curalake.streaming.keyed import KeyedTable, _read, keep

ROWS_DDL = "prediction_id string, kind int, seq bigint, timestamp timestamp, image_sha256 string"
TOLD_DDL = "prediction_id string, since timestamp, recorded string"
BOUND_DDL = "seq bigint, timestamp timestamp, prediction_id string, image_sha256 string, bound_at timestamp"


def drain(stream: DataFrame, path: str, mode: str = "append", partition: str | None = None) -> DataFrame:
    """Run ``stream`` to the end of its input; returns the written rows with ``batch_id``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/data/batch_id={batch_id}")

    started = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    started.awaitTermination()
    return stream.sparkSession.read.schema(_with_batch(stream)).parquet(f"{path}/data")


def _with_batch(stream: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])


def admit_feedback(stream: DataFrame, class_names: Sequence[str], path: str) -> DataFrame:
    """Good and rejected feedback as two partitions of one table, with the broken rules."""
    checked = fb.with_feedback_errors(stream, class_names)
    rows = checked.withColumns({"admitted": F.size("errors") == 0, "errors": F.array_join(F.array_sort("errors"), ",")})
    return drain(rows, path, partition="admitted")


def latest_labels(stream: DataFrame, class_names: Sequence[str], path: str) -> DataFrame:
    """Running latest valid label per image, kept as a keyed table. The stream itself holds no state."""
    labelled = stream.select("image_sha256", fb.human_label(class_names).alias("feedback_class"), "timestamp", "seq").filter(
        "feedback_class IS NOT NULL AND image_sha256 IS NOT NULL AND image_sha256 <> ''"
    )
    table = KeyedTable.like(labelled, f"{path}/labels", ["image_sha256"], ["timestamp", "seq"])
    return keep(labelled, table, path)


def overridden_predictions(stream: DataFrame, latest: DataFrame, threshold: float, class_names: Sequence[str], path: str) -> DataFrame:
    """Stream-static join of predictions with the label table."""
    return drain(feedback_override(stream, latest, threshold, class_names), path)


def fingerprinted_feedback(feedback: DataFrame, predictions: DataFrame, path: str, delay: str = "1 day") -> DataFrame:
    """Feedback with the image hash of its prediction, used by the first feedback only; all feedback is kept.

    Feedback within ``delay`` of a known prediction takes its hash once, in event order within a batch; all other feedback keeps
    its own. A prediction is known until ``delay`` after it has passed the watermark, which only predictions move; late ones are
    dropped, feedback never is. A batch is bound by joins: ``told`` logs the predictions that each batch took up, ``seen`` the
    newest time in it, and the output the prediction that a row used, so a batch reads the logs of known predictions alone and a
    replay writes the same again.
    """
    spark = feedback.sparkSession
    told = predictions.filter("predicted_at IS NOT NULL").select(
        "prediction_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("seq"), F.col("predicted_at").alias("timestamp"), "image_sha256",
    )
    asked = feedback.select("prediction_id", F.lit(1).alias("kind"), "seq", "timestamp", "image_sha256")
    room = pd.Timedelta(delay) // pd.Timedelta("1us")

    def bind(batch: DataFrame, batch_id: int) -> None:
        # written once: the stateful plan runs once, and what follows is planned by the caller's session
        batch.write.mode("overwrite").parquet(f"{path}/batch")
        rows = spark.read.schema(ROWS_DDL).parquet(f"{path}/batch")
        news = rows.filter("kind = 0")
        alive, used = _known(spark, path, batch_id, room)
        first_told = news.filter("image_sha256 IS NOT NULL").groupBy("prediction_id").agg(F.min(F.struct("timestamp", "image_sha256")).alias("t"))
        taken = first_told.select("prediction_id", F.col("t.timestamp").alias("since"), F.col("t.image_sha256").alias("recorded"))
        taken.join(alive, "prediction_id", "left_anti").write.mode("overwrite").parquet(f"{path}/told/batch_id={batch_id}")
        unused = alive.join(used, ["prediction_id", "since"], "left_anti").select("prediction_id", "since", "recorded")
        states = unused.unionByName(spark.read.schema(TOLD_DDL).parquet(f"{path}/told/batch_id={batch_id}"))

        own = F.struct("timestamp", "seq", "image_sha256")
        rows_in = rows.filter("kind = 1").drop("kind")
        near = (F.unix_micros("timestamp") - F.unix_micros("since")).between(0, room)
        first = rows_in.join(states, "prediction_id").filter(near).groupBy("prediction_id").agg(
            F.min(own).alias("first"), F.min("since").alias("since"), F.min("recorded").alias("recorded")
        )
        # of rows that are the same in every column one binds; no window holds more than such copies
        copy = F.row_number().over(Window.partitionBy("prediction_id", "timestamp", "seq", "image_sha256").orderBy("seq"))
        binds = F.col("first").eqNullSafe(own) & (F.col("copy") == 1)
        rows_in.withColumn("copy", copy).join(first, "prediction_id", "left").select(
            "seq", "timestamp", "prediction_id", F.when(binds, F.col("recorded")).otherwise(F.coalesce("image_sha256", F.lit(""))).alias("image_sha256"),
            F.when(binds, F.col("since")).alias("bound_at"),
        ).write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")
        news.agg(F.max(F.unix_millis("timestamp")).alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/seen/batch_id={batch_id}")

    fresh = told.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["prediction_id", "timestamp", "image_sha256"])
    started = (
        fresh.unionByName(asked).writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).foreachBatch(bind).start()
    )
    started.awaitTermination()
    return spark.read.schema(f"{BOUND_DDL}, batch_id bigint").parquet(f"{path}/data").drop("bound_at", "batch_id")


def _known(spark: SparkSession, path: str, batch_id: int, room: int) -> tuple[DataFrame, DataFrame]:
    """Predictions (``TOLD_DDL``) that batch ``batch_id`` still knows, and ``prediction_id, since`` of those that were used."""
    seen = _read(spark, f"{path}/seen", "latest bigint, batch_id bigint")
    before = seen.filter(F.col("batch_id") < batch_id) if seen is not None else None
    latest = before.agg(F.max("latest").alias("t")).first()["t"] if before is not None else None
    if latest is None:
        return spark.createDataFrame([], TOLD_DDL), spark.createDataFrame([], "prediction_id string, since timestamp")
    oldest = latest - 2 * (room // 1_000)  # the watermark is one delay behind, and a prediction stays for one more
    live = sorted(r["batch_id"] for r in before.filter(F.col("latest") >= oldest).select("batch_id").collect())
    alive = spark.read.schema(TOLD_DDL).parquet(*[f"{path}/told/batch_id={b}" for b in live]).filter(F.unix_millis("since") >= oldest)
    bound = spark.read.schema(f"{BOUND_DDL}, batch_id bigint").parquet(f"{path}/data").filter(F.col("batch_id").between(live[0], batch_id - 1))
    return alive, bound.filter(F.unix_millis("bound_at") >= oldest).select("prediction_id", F.col("bound_at").alias("since"))


def review_rates(stream: DataFrame, threshold: float, path: str, delay: str = "1 day") -> DataFrame:
    """Predictions, reviews and review rate per day in tumbling windows."""
    windows = stream.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("prediction_count"), F.count_if(F.col("confidence") < threshold).alias("review_count")
    )
    rates = windows.select(
        F.col("w.start").alias("day"), "prediction_count", "review_count", (F.col("review_count") / F.col("prediction_count")).alias("review_rate")
    )
    table = KeyedTable.like(rates.withColumn("batch_id", F.lit(0).cast("bigint")), f"{path}/days", ["day"], ["batch_id"])
    return keep(rates, table, path, "update")


def upserted(feed: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str], path: str) -> DataFrame:
    """Change feed -> keyed table that starts from ``existing``; the newest change of a key wins, in any batch."""
    table = KeyedTable.like(feed, f"{path}/table", keys, order, existing.columns)
    table.create(existing)
    return keep(feed, table, path)
