"""Domain views over the test tables, so that every query grows with its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.functions.hashing import grid_difference_hash, let
from curalake.operators.graph import Catalog
from curalake.operators.sampling import stratified_split
from curalake.session import computed, spread


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _class(index: str) -> str:
    names = ",".join(f"'{c}'" for c in S.CLASS_NAMES)
    return f"get(array({names}), cast({index} as int))"


def word_grid(text: Column) -> Column:
    """8x9 grid of word counts: a word falls into one of 72 cells by its md5.

    Each word becomes one character and the cells are counted by removal, so the
    whole text is reduced inside one row without a shuffle.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    cell = lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("bigint") % 72
    letters = F.array_join(F.transform(words, lambda w: F.char(cell(w) + 48)), "")
    return let(letters, lambda t: F.transform(
        F.sequence(F.lit(0), F.lit(71)), lambda i: F.length(t) - F.length(F.replace(t, F.char(i + 48), F.lit(""))),
    ))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(table(spark, d, "documents"))


def _manifest(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(
        "doc_id", "concat('doc-', doc_id) AS image_id",
        "CASE lang WHEN 'en' THEN 'normal' WHEN 'fr' THEN 'scratch' WHEN 'de' THEN 'dent' ELSE 'rust' END AS class_name",
        "concat(lang, '/', doc_id, '.txt') AS file_path", "sha2(text, 256) AS checksum",
        "CASE doc_id % 6 WHEN 0 THEN 'Undamaged' WHEN 1 THEN 'No Damage' ELSE source END AS source_object_label",
        "source AS source_dataset", "concat('https://example.org/', source, '/', doc_id) AS source_url",
        "CASE WHEN doc_id % 97 = 0 THEN ' ' ELSE 'CC BY 4.0' END AS licence",
        "concat(source, '/', CASE WHEN doc_id % 20 < 5 THEN doc_id div 40 ELSE doc_id END) AS source_group",
        "n_chars AS short_side", "text",
    )


def hashed_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    return computed(_manifest(docs), perceptual_hash=grid_difference_hash(word_grid(F.col("text")))).drop("text")


def source_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A source manifest with blanks, bad checksums and assigned splits."""
    return manifest(spark, d).selectExpr(
        "image_id", "file_path", "class_name", "source_dataset AS source", "licence AS license",
        "CASE WHEN doc_id % 101 = 0 THEN substr(checksum, 2) ELSE checksum END AS checksum",
        "CASE WHEN doc_id % 211 = 0 THEN 'train' ELSE '' END AS dataset_split", "source_group",
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).selectExpr(
        "image_id", "file_path", "class_name", "source_object_label AS original_label", "source_dataset", "source_url", "licence",
        "source_group", "CASE doc_id % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN ' Accepted ' ELSE 'accepted' END AS review_status",
        "CASE WHEN doc_id % 2 = 0 THEN 'seen' ELSE '' END AS review_notes", "short_side",
    )


def split(spark: SparkSession, d: str) -> DataFrame:
    return stratified_split(manifest(spark, d).drop("text"))


def hashed_split(spark: SparkSession, d: str) -> DataFrame:
    # ranking reads its input twice, so the hashes, which need the whole texts, join afterwards
    hashes = hashed_manifest(spark, d).select("doc_id", "perceptual_hash")
    return split(spark, d).join(hashes, "doc_id")


#: A third of the users show images that have no feedback yet.
PREDICTED_IMAGE = "sha2(CASE WHEN user_id % 3 = 0 THEN concat('new-', user_id) ELSE cast(user_id AS string) END, 256) AS image_sha256"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id AS sample_index", "ts", "user_id % 4 AS true_idx",
        "CASE WHEN event_type = 'error' THEN (user_id + 1) % 4 ELSE user_id % 4 END AS pred_idx",
        "cast(event_id * 7919 % 1001 AS double) / 1000 AS confidence", PREDICTED_IMAGE,
    )


FEEDBACK = [
    "cast(ts AS timestamp) AS timestamp", "event_id AS seq", "concat('p-', event_id - event_id % 3) AS prediction_id",
    "CASE WHEN event_id % 91 = 0 THEN '' ELSE concat('img-', user_id, '.png') END AS image_filename",
    "CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 71 = 0 THEN upper(sha2(cast(user_id AS string), 256)) "
    "ELSE sha2(cast(user_id AS string), 256) END AS image_sha256",
    f"CASE WHEN event_id % 29 = 0 THEN 'unknown' WHEN event_id % 31 = 0 THEN 'paint' ELSE {_class('user_id % 4')} END AS predicted_class",
    "cast(event_id * 7919 % 1051 AS double) / 1000 AS confidence", "event_type <> 'error' AS is_correct",
    f"CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN CASE WHEN event_id % 67 = 0 THEN 'paint' ELSE {_class('(user_id + 1) % 4')} END "
    "WHEN event_type <> 'error' AND event_id % 73 = 0 THEN 'normal' END AS corrected_class",
    "CASE WHEN event_id % 83 = 0 THEN repeat('x', 501) WHEN event_id % 2 = 0 THEN 'ok' END AS comment",
]


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*FEEDBACK)


PREDICTION_LOG = ["cast(ts AS timestamp) AS predicted_at", "concat('p-', event_id) AS prediction_id", "sha2(concat('img-', user_id), 256) AS image_sha256"]


def prediction_log(spark: SparkSession, d: str) -> DataFrame:
    """Recorded predictions: the views of the event stream."""
    return table(spark, d, "events").filter("event_type = 'view'").selectExpr(*PREDICTION_LOG)


UPLOADS = [
    "event_id", "get(array('photo.JPG', 'a.png', 'b.gif', '', 'dir/c.jpeg', 'noext', '.png'), cast(event_id % 7 AS int)) AS filename",
    "get(array('image/jpeg', 'image/png', ' IMAGE/PNG ', 'text/plain'), cast(user_id % 4 AS int)) AS content_type",
    "CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 10485761 ELSE cast(round(value * 100) AS bigint) END AS size_bytes",
    "event_id % 17 <> 0 AS decodable", "event_id % 101 <> 0 AS model_available",
]


def uploads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*UPLOADS)


def logits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id", "slice(embedding, 1, 4) AS logits", "cast(label % 4 AS bigint) AS true_idx")


def history(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is a training run, a turn an epoch; the loss comes from the text's length."""
    return table(spark, d, "conversations").selectExpr(
        "conv_id AS run_id", "turn + 1 AS epoch", "CASE WHEN turn < 3 THEN 'head' ELSE 'all' END AS stage",
        "cast(length(text) % 97 AS double) / 100 AS loss",
    )


def annotation_documents(spark: SparkSession, d: str) -> DataFrame:
    """One JSON annotation per line item: two polygons, a third that is often malformed, odd sizes, broken text.

    Some have sizes as text or decimals, an entry that is no object, or a point without a number; the rest of them counts.
    """
    rows = spread(table(spark, d, "lineitem").drop("l_shipdate", "l_extendedprice", "l_discount")).selectExpr(
        "l_orderkey AS k", "l_partkey AS p",
        "concat('set/ann/', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '.jpg.json') AS annotation_path",
        "CASE WHEN l_orderkey % 10 = 0 THEN 'normal' ELSE 'damage' END AS source_kind",
        "CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE named_struct('width', CASE WHEN l_orderkey % 50 = 0 THEN 95 ELSE 800 END, 'height', 600) END AS size",
        "CASE WHEN l_orderkey % 10 = 0 THEN 'Front-Door' ELSE CASE l_returnflag WHEN 'R' THEN 'Scratch' WHEN 'A' THEN ' Dent ' ELSE 'Corrosion' END END AS t1",
        "cast(l_partkey % 600 AS double) AS x1", "cast(l_suppkey % 400 AS double) AS y1", "20 + l_quantity * 3 AS w1", "20 + l_tax * 1000 AS h1",
        "CASE WHEN l_orderkey % 10 = 0 THEN 'hood' ELSE CASE l_linestatus WHEN 'F' THEN 'Dent' ELSE 'Scratch' END END AS t2",
        "cast(l_suppkey % 500 AS double) AS x2", "cast(l_partkey % 300 AS double) AS y2",
        "cast(30 + l_linenumber * 20 AS double) AS w2", "cast(40 + l_linenumber * 10 AS double) AS h2",
        "cast((l_partkey + l_suppkey) % 700 AS double) AS x3", "cast(l_orderkey % 300 AS double) AS y3",
    )

    def polygon(title, kind, x, y, w, h, keep=4):
        corners = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
        return F.struct(
            title.alias("classTitle"), kind.alias("geometryType"),
            F.struct(F.slice(corners, F.lit(1), keep if isinstance(keep, Column) else F.lit(keep)).alias("exterior")).alias("points"),
        )

    c, kind = F.col, F.lit("polygon")
    odd = c("p") % 4
    objects = F.array(
        polygon(c("t1"), kind, c("x1"), c("y1"), c("w1"), c("h1")),
        polygon(c("t2"), kind, c("x2"), c("y2"), c("w2"), c("h2")),
        polygon(
            F.when(odd == 2, F.lit("  ")).otherwise(F.lit("Broken part")), F.when(odd == 0, F.lit("rectangle")).otherwise(kind),
            c("x3"), c("y3"), F.lit(50.0), F.lit(60.0), F.when(odd == 1, F.lit(2)).otherwise(F.lit(4)),
        ),
    )
    # the text is made once per row: an expression that names it in each branch would hold a copy of it for every path
    texts = computed(rows, text=F.to_json(F.struct(c("size"), objects.alias("objects"))))
    document = F.when(c("k") % 101 == 0, F.lit('{"size":'))
    for remainder, pattern, put in (
        (1, '"width":([0-9]+)', '"width":"$1"'), (2, '"height":([0-9]+)', '"height":$1.0'),
        (3, '"objects":\\[', '"objects":["note",'), (4, '"exterior":\\[', '"exterior":[["a",1],'),
    ):
        document = document.when(c("k") % 7 == remainder, F.regexp_replace("text", pattern, put))
    return texts.select("annotation_path", "source_kind", document.otherwise(c("text")).alias("document"))


def supplier_catalog(spark: SparkSession, d: str) -> Catalog:
    """A large catalog: suppliers as defects, the parts of their line items, per-part inventory."""
    items = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    suppliers = table(spark, d, "supplier").selectExpr("s_suppkey", "concat('sup-', s_suppkey) AS class_name", "s_name AS display_name")
    attributes = table(spark, d, "part").join(
        items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("latest")), "p_partkey"
    ).selectExpr(
        "p_partkey", "concat('P', p_partkey) AS part_id", "p_name AS part_name", "p_retailprice AS mock_price", "'INR' AS currency",
        "cast(p_size % 15 AS bigint) AS fake_stock_quantity",
        "CASE WHEN p_size % 15 = 0 THEN 'out_of_stock' WHEN p_size % 15 < 5 THEN 'low_stock' ELSE 'in_stock' END AS availability_status",
        "date_format(latest, 'yyyy-MM-dd') AS last_updated",
    )
    pairs = items.select("l_suppkey", "l_partkey").distinct()
    parts = pairs.join(attributes, pairs.l_partkey == attributes.p_partkey).selectExpr(
        "concat('sup-', l_suppkey) AS class_name", "part_id", "part_name", "mock_price", "currency", "fake_stock_quantity",
        "availability_status", "last_updated",
    )
    steps = suppliers.selectExpr("class_name", "display_name", "explode(sequence(1L, 2 + s_suppkey % 2)) AS position").selectExpr(
        "class_name", "position", "concat('step ', position, ' for ', display_name) AS instruction"
    )
    return Catalog(suppliers.selectExpr("'Car panel' AS object_type", "class_name", "display_name"), steps, parts)


def panel_catalog(spark: SparkSession, d: str) -> Catalog:
    """A small catalog of the four classes from the fixed-size dimension tables."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    parts = nation.filter("n_nationkey % 4 > 0").selectExpr(
        f"{_class('n_nationkey % 4')} AS class_name", "format_string('N%03d', n_nationkey) AS part_id", "n_name AS part_name",
        "n_regionkey * 10.5D AS mock_price", "'INR' AS currency", "cast(n_nationkey % 7 AS bigint) AS fake_stock_quantity",
        "CASE WHEN n_nationkey % 7 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS availability_status",
        "concat('2026-01-', lpad(cast(n_nationkey + 1 AS string), 2, '0')) AS last_updated",
    )
    steps = region.selectExpr(
        f"{_class('1 + r_regionkey % 3')} AS class_name", "cast(1 + r_regionkey div 3 AS bigint) AS position", "concat('inspect ', r_name) AS instruction"
    )
    defects = nation.selectExpr(f"{_class('n_nationkey % 4')} AS class_name").distinct().selectExpr(
        "'Car panel' AS object_type", "class_name", "initcap(class_name) AS display_name"
    )
    return Catalog(defects, steps, parts)


def catalog_documents(spark: SparkSession, d: str) -> DataFrame:
    """One small JSON catalog per part, some of them breaking a constraint."""
    return table(spark, d, "part").selectExpr("p_partkey AS catalog_id", """to_json(named_struct(
        'object_type', CASE WHEN p_partkey % 41 = 0 THEN '' ELSE 'Car panel' END,
        'inventory_last_updated', '2026-01-01',
        'confidence_threshold', CASE WHEN p_partkey % 43 = 0 THEN 1.5D ELSE 0.6D END,
        'unknown_message', 'review', 'defects', array(
            named_struct('class_name', p_type, 'display_name', CASE WHEN p_partkey % 47 = 0 THEN '' ELSE p_name END,
                'repair_steps', array('clean', 'polish'), 'parts', array(named_struct(
                    'part_id', concat('P', p_partkey), 'part_name', p_name,
                    'mock_price', CASE WHEN p_partkey % 50 = 0 THEN -1D ELSE p_retailprice END,
                    'currency', CASE WHEN p_partkey % 77 = 0 THEN 'IN' ELSE 'INR' END,
                    'fake_stock_quantity', CASE WHEN p_partkey % 61 = 0 THEN -p_size ELSE p_size END,
                    'availability_status', 'in_stock'))),
            named_struct('class_name', CASE WHEN p_partkey % 37 = 0 THEN p_type ELSE p_brand END, 'display_name', p_brand,
                'repair_steps', cast(array() AS array<string>), 'parts',
                cast(array() AS array<struct<part_id:string,part_name:string,mock_price:double,currency:string,fake_stock_quantity:int,availability_status:string>>))
        ))) AS document""")


def heldout(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rows (every tenth document) with freeze flags, some of them wrong."""
    return hashed_manifest(spark, d).filter("doc_id % 10 = 0").selectExpr(
        "*", "image_id AS filename", "class_name AS expected_class",
        "CASE WHEN doc_id % 130 = 0 THEN 'no' ELSE 'Yes' END AS excluded_from_training_validation",
        "CASE WHEN doc_id % 170 = 0 THEN '' ELSE 'yes' END AS selected_before_inference",
    )


def parted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Held-out and development rows without perceptual hashes, for exact comparisons."""
    rows = manifest(spark, d).drop("text")
    return rows.filter("doc_id % 10 = 0").withColumn("filename", F.col("image_id")), rows.filter("doc_id % 10 <> 0")


#: A line of a log; some lines are short, long, or have a quote that is never closed.
LOG_LINE = (
    "concat(event_id, ',', user_id, CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 107 = 0 THEN concat(',', event_type, ',\"never closed') "
    "ELSE concat(',', event_type, ',\"said \"\"', event_type, '\"\", twice\"') END, CASE WHEN event_id % 103 = 0 THEN ',extra,' ELSE '' END) AS line"
)


def document_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts in files of a thousand documents of one language and source, in order."""
    rows = table(spark, d, "documents").selectExpr("lang", "source", "doc_id div 1000 AS chunk", "doc_id", "coalesce(text, '') AS text")
    return rows.repartition("lang", "source", "chunk").sortWithinPartitions("lang", "source", "chunk", "doc_id").drop("doc_id")


def development(spark: SparkSession, d: str) -> DataFrame:
    return hashed_manifest(spark, d).filter("doc_id % 10 <> 0")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Landed listing pages: licence from the language tag, licence URL only for https sites."""
    return table(spark, d, "pages").selectExpr(
        "page_id", r"regexp_extract(html, '<title>([^<]*)</title>', 1) AS title",
        r"regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS licence", "regexp_extract(url, '^(https://[^/]+)', 1) AS licence_url",
        r"regexp_extract(html, '<h1>(.*?)</h1>', 1) AS artist_html", "url AS source_url",
    )


def images(spark: SparkSession, d: str) -> DataFrame:
    """Documents as images: the whole text as BGR pixels of a 10 pixel wide picture, padded to full rows."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).selectExpr(
        "doc_id", "cast(text AS binary) AS raw", "cast(ceil(octet_length(text) / 30) AS int) AS rows"
    ).selectExpr(
        "doc_id", "named_struct('origin', concat('doc-', doc_id), 'height', CASE WHEN doc_id % 13 = 0 THEN -1 ELSE rows END, "
        "'width', CASE WHEN doc_id % 13 = 0 THEN -1 ELSE 10 END, 'nChannels', 3, 'mode', 16, 'data', rpad(raw, rows * 30, X'20')) AS image"
    )
