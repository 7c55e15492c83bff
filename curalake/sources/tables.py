"""Readers and writers: manifests, logs, catalogs, annotations, images, splits."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalake import schemas as S
from curalake.operators.manifest import missing_columns_error, union_splits, with_destination
from curalake.operators.violations import GateError
from curalake.session import class_table, computed, settings


def scan_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, line_breaks: bool = False) -> DataFrame:
    """CSV with every column as text; types are never inferred.

    By default files are splittable and mixed CRLF and LF line ends are fine. Quoted
    values with ``line_breaks`` need one task per file.
    """
    reader = spark.read.options(header=True, escape='"', inferSchema=False, multiLine=line_breaks)
    if columns is not None:
        reader = reader.schema(S.all_strings(list(columns)))
    return reader.csv(path)


def scan_manifest(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, line_breaks: bool = False) -> DataFrame:
    """Manifest scan; without ``columns`` the header decides. An empty manifest is refused."""
    manifest = scan_csv(spark, path, columns, line_breaks)
    if manifest.isEmpty():
        raise GateError(f"manifest is empty: {path}")
    return manifest


def scan_csv_checked(spark: SparkSession, path: str | list[str], columns: Sequence[str], header: bool = True) -> DataFrame:
    """Every line of CSV files with the ``columns`` as text, ``record`` (the line as it stands), ``file`` and ``reason``.

    ``reason`` is null for a whole row, else ``unclosed_quote``, ``short_row`` or ``long_row``; such a row has null columns, so
    that no field is lost or shifted without a sign. Lines are read as text, so files are splittable; blank lines and, with
    ``header``, lines that equal the header are left out. Quoted line breaks need ``scan_csv`` with ``line_breaks``.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("record"), F.col("_metadata.file_path").alias("file"))
    lines = lines.filter(F.trim("record") != "")
    if header:
        lines = lines.filter(F.regexp_replace("record", '"', "") != ",".join(columns))
    plain = F.regexp_replace("record", r'"(?:[^"]|"")*"', "")
    fields = F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1
    reason = (
        F.when(F.instr(plain, '"') > 0, "unclosed_quote").when(fields < len(columns), "short_row").when(fields > len(columns), "long_row")
    )
    checked = computed(lines, reason=reason)
    row = F.when(F.col("reason").isNull(), F.from_csv("record", ", ".join(f"`{c}` string" for c in columns), {"escape": '"'}))
    return computed(checked, _row=row).select(*[F.col("_row")[c].alias(c) for c in columns], "record", "file", "reason")


def csv_violations(checked: DataFrame) -> DataFrame:
    """Damaged rows of ``scan_csv_checked`` as violations."""
    return checked.filter("reason IS NOT NULL").select(F.col("reason").alias("rule"), F.col("record").alias("subject"))


def write_rejects(checked: DataFrame, path: str) -> None:
    """Append the damaged rows of a scan, as they stand, to a reject table."""
    checked.filter("reason IS NOT NULL").select("file", "reason", "record", F.current_timestamp().alias("rejected_at")).write.mode("append").parquet(path)


def scan_splits(spark: SparkSession, folder: str) -> DataFrame:
    """``<split>_manifest.csv`` of every split, tagged."""
    return union_splits({s: scan_manifest(spark, f"{folder}/{s}_manifest.csv") for s in S.SPLITS})


def scan_annotations(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One JSON document per file; unreadable documents become rows with null fields."""
    if kind not in ("damage", "normal"):
        raise ValueError("kind must be 'damage' or 'normal'")
    raw = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    return parse_annotations(raw.select(F.col("_metadata.file_path").alias("annotation_path"), F.lit(kind).alias("source_kind"), F.col("value").alias("document")))


ANNOTATION_DDL = (
    "size struct<width:int,height:int>, objects array<struct<classTitle:string,geometryType:string,points:struct<exterior:array<array<double>>>>>"
)


#: A title or kind that is no text, and a polygon that is not a list of lists without text or further lists.
_ODD_TEXT = r'"(classTitle|geometryType)"\s*+:\s*+[^"]'
_ODD_POINTS = r'"exterior"\s*+:\s*+(?!\[(?:[\s,]*+\[[^\[\]"{]*+\])*+\s*+\])'


def parse_annotations(documents: DataFrame) -> DataFrame:
    """``annotation_path, source_kind, document`` -> typed ``size`` and ``objects``, in three tiers.

    A document whose titles are text and whose polygons hold no text is cast as a whole. One that ``parse_json`` does not take,
    or with other titles or escapes by number, goes to the typed parser, and is done if that takes it whole. Of what is left every value is cast on
    its own. Sizes may be text or decimals, an entry that is not an object has null fields, and a coordinate that is not a
    number is null, so that only its own point is lost. An unreadable document has neither size nor objects.
    The typed parser comes late since it raises an error inside for every value of another type.
    """
    number = "CASE WHEN schema_of_variant(x) RLIKE '^(BIGINT|DOUBLE|DECIMAL|BOOLEAN)' THEN try_variant_get(x, '$', 'double') END"
    slow = f"""transform(try_variant_get(o, '$.points.exterior', 'array<variant>'), p ->
        transform(try_variant_get(p, '$', 'array<variant>'), x -> {number}))"""
    # a polygon is cast at once, one with text but no keys after its text has become null
    flat = r"""try_parse_json(regexp_replace(to_json(try_variant_get(o, '$.points.exterior', 'variant')), r'"(?:[^"\\]|\\.)*+"', 'null'))"""
    exterior = f"""CASE WHEN contains(to_json(try_variant_get(o, '$.points.exterior', 'variant')), '{{') THEN {slow}
        ELSE try_variant_get({flat}, '$', 'array<array<double>>') END"""
    points = f"""transform(try_variant_get(_d, '$.objects', 'array<variant>'), o -> named_struct(
        'classTitle', try_variant_get(o, '$.classTitle', 'string'), 'geometryType', try_variant_get(o, '$.geometryType', 'string'),
        'points', named_struct('exterior', {exterior})))"""
    size = "named_struct('width', try_variant_get(_d, '$.size.width', 'int'), 'height', try_variant_get(_d, '$.size.height', 'int'))"
    typed = F.from_json("document", f"{ANNOTATION_DDL}, _damaged string", {"columnNameOfCorruptRecord": "_damaged", "allowNonNumericNumbers": "false"})
    first = computed(documents, _d=F.try_parse_json("document"))
    second = computed(first, _plain=F.col("_d").isNotNull() & ~F.contains("document", F.lit("\\u")) & ~F.col("document").rlike(_ODD_TEXT))
    cast = F.try_variant_get("_d", "$", f"struct<{ANNOTATION_DDL.replace('size struct', 'size:struct').replace('objects array', 'objects:array')}>")
    third = computed(
        second, _v=F.when(F.col("_plain") & ~F.col("document").rlike(_ODD_POINTS), cast), _t=F.when(~F.coalesce("_plain", F.lit(False)), typed),
    )
    whole = F.col("_t").isNotNull() & F.col("_t._damaged").isNull() & F.col("document").rlike(r"\A\s*\{")
    fourth = computed(third, _w=F.coalesce(whole, F.lit(False)))
    return fourth.select(
        "annotation_path", "source_kind",
        F.when(F.col("_v").isNotNull(), F.struct("_v.size.width", "_v.size.height")).when(F.col("_w"), F.struct("_t.size.width", "_t.size.height"))
        .otherwise(F.expr(size)).alias("size"),
        F.when(F.col("_v").isNotNull(), F.col("_v.objects")).when(F.col("_w"), F.col("_t.objects")).otherwise(F.expr(points)).alias("objects"),
    )


def list_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``path, length`` of matching files; the content column is pruned, so nothing is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")


def scan_content(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, actual_checksum`` of every file."""
    return spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=True).load(path).select(
        "path", "length", F.sha2("content", 256).alias("actual_checksum")
    )


def refresh_digests(spark: SparkSession, path: str, cache: str, pattern: str = "*", chunk: int = 10_000) -> DataFrame:
    """``path, length, actual_checksum, fresh`` of every file below ``path``; only files that are new or changed since the last
    scan are read.

    ``cache`` is a table of digests by path, length and modification time, to which a scan appends. A listing reads no content;
    what the cache does not know is then read by its path. Spark's own file index holds the paths of a scan on the driver, so
    they pass in chunks there without being more than the listing was. Files that are gone are left out.
    """
    keys = ["path", "length", "modificationTime"]
    ddl = "path string, length bigint, modificationTime timestamp, actual_checksum string, scan bigint"
    source = spark.read.format("binaryFile")
    # by default Spark lists with a task per folder, and per path of a list
    listing = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism)}
    with settings(spark, listing):
        listed = source.options(pathGlobFilter=pattern, recursiveFileLookup=True).load(path).select(*keys)
    try:
        known = spark.read.schema(ddl).parquet(cache)
        scan = (known.agg(F.max("scan").alias("s")).first()["s"] or 0) + 1
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known, scan = None, 1
    fresh = listed if known is None else listed.join(known.select(*keys), keys, "left_anti")
    # every partition of a local iterator is a job: rebalanced, the paths lie in a few
    found = fresh.select("path").hint("rebalance").toLocalIterator()
    paths = (re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in found)
    while some := list(islice(paths, chunk)):
        with settings(spark, listing):
            content = spark.read.format("binaryFile").load(some)
        digests = content.select(*keys, F.sha2("content", 256).alias("actual_checksum"), F.lit(scan).cast("bigint").alias("scan"))
        digests.write.mode("append").parquet(cache)
    try:
        known = spark.read.schema(ddl).parquet(cache)
    except AnalysisException:  # no file yet, and none before
        return listed.select("path", "length", F.lit(None).cast("string").alias("actual_checksum"), F.lit(False).alias("fresh")).limit(0)
    latest = known.groupBy(*keys).agg(F.max_by("actual_checksum", "scan").alias("actual_checksum"), F.min("scan").alias("scan"))
    return listed.join(latest, keys).select("path", "length", "actual_checksum", (F.col("scan") == scan).alias("fresh"))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; files that do not decode stay, with height -1."""
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)


def scan_class_names(spark: SparkSession, path: str) -> DataFrame:
    """Ordered JSON list of class names -> ``idx, class_name``."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("names")).first()
    return class_table(spark, row["names"] or [])


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CATALOG_DDL).json(path, multiLine=True, mode="FAILFAST")


def scan_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.HISTORY_DDL).json(path, multiLine=True).withColumn("run_id", F.col("_metadata.file_path"))


def scan_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.DECISIONS_DDL).json(path, multiLine=True)


def scan_feedback(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Feedback log as text. ``seq`` orders rows as they stand, for the recall order: by file path, start of the split
    in its file, and the row's number in its task, which reads a split from front to end.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"),
    )
    return scan_csv(spark, path, line_breaks=line_breaks).withColumn("seq", place)


def write_splits(df: DataFrame, path: str) -> None:
    """Split table, partitioned by split; an existing target is refused."""
    df.write.mode("errorifexists").partitionBy("dataset_split").parquet(path)


def write_split_directories(df: DataFrame, path: str) -> None:
    """``split=/class=`` directories with the safe destination name of every row."""
    with_destination(df).write.mode("errorifexists").partitionBy("dataset_split", "class_name").parquet(path)


def write_report(df: DataFrame, path: str, required: Sequence[str], form: str = "parquet") -> None:
    """Metrics, predictions or misclassifications, after a column check."""
    missing_columns_error(df, required)
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.option("header", True).csv(p)}[form](path)


def scan_report(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "parquet") -> DataFrame:
    """A report as it was written; a CSV with other columns, or a value of another type, fails the query."""
    reader = spark.read.schema(schema)
    if form == "parquet":
        return reader.parquet(path)
    strict = reader.option("mode", "FAILFAST")
    return strict.json(path) if form == "json" else strict.csv(path, header=True, enforceSchema=False)


def append_feedback(df: DataFrame, path: str) -> None:
    """Append-only feedback table with a UTC time stamp."""
    stamped = df.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp())) if "timestamp" in df.columns else df.withColumn("timestamp", F.current_timestamp())
    stamped.select(*S.FEEDBACK_COLUMNS).write.mode("append").parquet(path)
