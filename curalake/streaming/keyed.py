"""Keyed tables that streams keep up to date: hashed buckets, versioned snapshots, commits by a pointer.

``data/version=v/bucket=b`` holds the whole content of bucket b as version v wrote it, ``pointers/version=v`` one row per
bucket with the version that has its content. A merge reads the buckets its keys fall into, keeps the newest row of every
key, writes these buckets as the next version and commits by writing the pointer: until that one file is there, readers
see the version before. A batch that was committed is not merged again, one that died half-way is overwritten. What a
merge costs follows from the buckets it touches, not from the table or the number of merges before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalake.operators.graph import KEYS, Graph

BUCKETS = 32
POINTER_DDL = "bucket int, data_version bigint"


def _read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """A parquet folder, or None before it has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@dataclass(frozen=True)
class KeyedTable:
    """One row per key; of several changes the one with the greatest ``order`` wins, then the greatest row.

    ``rows`` is the schema of keys and values. ``buckets`` is fixed for the life of a table; a bucket
    may be larger than a task. ``order`` are columns of the changes, with their types in ``rows`` too if they are values as well.
    """

    spark: SparkSession
    path: str
    rows: T.StructType
    keys: tuple[str, ...]
    order: T.StructType
    buckets: int = BUCKETS

    @classmethod
    def like(cls, df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None, buckets: int = BUCKETS) -> KeyedTable:
        """A table of ``columns`` of ``df`` (a batch or a stream); by default all that only order the changes are left out."""
        kept = columns or [c for c in df.columns if c not in order or c in keys]
        return cls(df.sparkSession, path, df.select(*kept).schema, tuple(keys), df.select(*order).schema, buckets)

    def _stored(self) -> T.StructType:
        """Every row with the generation (0: before any change) and the order of the change it came from."""
        return T.StructType([*self.rows.fields, T.StructField("_gen", T.IntegerType()), T.StructField("_at", self.order)])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _packed(self, changes: DataFrame, generation: int) -> DataFrame:
        at = F.struct(*[F.col(c) for c in self.order.names]) if generation and self.order.names else F.lit(None)
        return changes.select(*self.rows.names, F.lit(generation).alias("_gen"), at.cast(self.order).alias("_at"))

    def _newest(self, stored: DataFrame, *group: str) -> DataFrame:
        """The newest row per key, by an aggregate that combines before any shuffle."""
        rest = [c for c in stored.columns if c not in self.keys and c not in group]
        values = [F.col(c) for c in self.rows.names if c not in self.keys]
        newest = F.max_by(F.struct(*rest), F.struct("_gen", "_at", *values))
        return stored.groupBy(*group, *self.keys).agg(newest.alias("_row")).select(*group, *self.keys, "_row.*")

    def pointer(self, version: int | None = None) -> tuple[int, dict[int, int]]:
        """(version, bucket -> version with its content) of the last commit, or of the last one up to ``version``; (-1, {}) at first."""
        schema = T.StructType.fromDDL(f"{POINTER_DDL}, version bigint")
        pointers = _read(self.spark, f"{self.path}/pointers", schema)
        if pointers is None:
            return -1, {}
        if version is not None:
            pointers = pointers.filter(F.col("version") <= version)
        last = pointers.agg(F.max("version").alias("v")).first()["v"]
        if last is None:
            return -1, {}
        rows = pointers.filter(F.col("version") == last).collect()  # as many as there are buckets
        return last, {r["bucket"]: r["data_version"] for r in rows}

    def read(self, version: int | None = None) -> DataFrame:
        """Keys and values of the last commit (or the last up to ``version``)."""
        return self._content(self.pointer(version)[1]).select(*self.rows.names)

    def _content(self, where: dict[int, int]) -> DataFrame:
        if not where:
            return self.spark.createDataFrame([], self._stored())
        return self.spark.read.schema(self._stored()).parquet(*[f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(where.items())])

    def create(self, existing: DataFrame) -> None:
        """The first version (0), before any change; nothing happens if there is one."""
        if self.pointer()[0] < 0:
            self._commit(self._newest(self._packed(existing, 0)).withColumn("bucket", self._bucket()), range(self.buckets), {}, 0)

    def merge(self, changes: DataFrame, version: int) -> list[int]:
        """Merge one batch of changes; returns the buckets that were rewritten. A version up to the last commit is a replay."""
        last, where = self.pointer()
        if version <= last:
            return []
        batch = self._newest(self._packed(changes, 1)).withColumn("bucket", self._bucket()).persist()
        try:
            touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # at most ``buckets`` numbers
            if touched:
                old = self._content({b: where[b] for b in touched if b in where}).withColumn("bucket", self._bucket())
                self._commit(self._newest(old.unionByName(batch), "bucket"), touched, where, version)
        finally:
            batch.unpersist()
        return touched

    def _commit(self, rows: DataFrame, touched: Sequence[int], where: dict[int, int], version: int) -> None:
        # a large bucket is cut into several tasks and files, small ones share a task
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        written = self.spark.read.schema(T.StructType.fromDDL("bucket int")).parquet(f"{self.path}/data/version={version}") if version == 0 else None
        filled = {r["bucket"] for r in written.distinct().collect()} if written is not None else set(touched)
        now = where | {b: version for b in touched if b in filled}
        self.spark.createDataFrame(sorted(now.items()), POINTER_DDL).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointers/version={version}")


def keep(stream: DataFrame, table: KeyedTable, path: str, mode: str = "append") -> DataFrame:
    """Merge a stream into a keyed table, to the end of its input. The query's own batch numbers are the versions."""

    def write(batch: DataFrame, batch_id: int) -> None:
        names = [c for c in table.order.names if c == "batch_id"]
        table.merge(batch.withColumns({c: F.lit(batch_id).cast("bigint") for c in names}), batch_id + 1)

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    started.awaitTermination()
    return table.read()


@dataclass(frozen=True)
class GraphStore:
    """The graph's nine tables as keyed tables below one folder. A seed is visible once all nine have been merged."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _tables(self, graph: Graph) -> dict[str, KeyedTable]:
        frames = {f.name: getattr(graph, f.name).withColumn("_seed", F.lit(0).cast("bigint")) for f in fields(Graph)}
        return {n: KeyedTable.like(df, f"{self.path}/{n}", KEYS[n], ["_seed"], buckets=self.buckets) for n, df in frames.items()}

    def seeds(self) -> int:
        """Number of the last complete seed; 0 at first."""
        done = _read(self.spark, f"{self.path}/seeds", "one int, seed bigint")
        return (done.agg(F.max("seed").alias("s")).first()["s"] or 0) if done is not None else 0

    def seed(self, graph: Graph) -> int:
        """Merge a graph: its rows replace those with their keys, nothing is deleted. Returns the seed's number. After a seed that
        died half-way the same number is taken again, and the tables it had merged are not merged twice."""
        number = self.seeds() + 1
        for name, table in self._tables(graph).items():
            table.merge(getattr(graph, name).withColumn("_seed", F.lit(number).cast("bigint")), number)
        self.spark.sql("SELECT 1 AS one").write.mode("overwrite").parquet(f"{self.path}/seeds/seed={number}")
        return number

    def read(self, like: Graph) -> Graph:
        """The graph as of the last complete seed; ``like`` gives the columns."""
        number = self.seeds()
        return Graph(**{name: table.read(number) for name, table in self._tables(like).items()})
