"""The operators' production queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.llm import counting, extract, langid, linedup, minhash, mixing, negatives, packing, quality, shingles, urls, vptree, whitening


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A label belongs to the page with its number; a page of low quality or a toxic one is bad."""
    labels = _table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.url_verdicts(_table(spark, folder, "pages"), labels)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


def op3_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = vptree.usable_vectors(_table(spark, folder, "embeddings"))
    return vptree.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, folder, "documents"))


def op5_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingles.similar_components(_table(spark, folder, "documents"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linedup.drop_repeated_runs(_table(spark, folder, "documents").select("doc_id", "text"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.edited_counts(_table(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract.main_texts(_table(spark, folder, "pages"))


def op10_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.usable_rows(table.select("vec_id", label.alias("label"), "embedding"))
    return negatives.hard_negatives(rows, rows.filter("vec_id % 50 = 0"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"))


def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_url_filter, op2_language_id, op3_nearest_vectors, op4_quality_rules, op5_shingle_join, op6_line_dedup, op7_token_counts, op8_packing, op9_main_text,
        op10_poisson_mix, op11_hard_negatives, op12_whitening, op13_minhash,
    )
}
ORACLE: dict[str, str] = {
    "op10_poisson_mix": f"""
        WITH s AS (SELECT coalesce('=' || source, '') AS k, sum(greatest(coalesce(length(text), 0), 1)) AS size FROM documents GROUP BY 1),
        w AS (SELECT k, size, pow(size::DOUBLE, {mixing.POWER}) AS weight FROM s),
        r AS (SELECT k, weight / sum(weight) OVER () * sum(size) OVER () / size AS rate FROM w),
        cdf AS (SELECT k, sum(exp(n * ln(rate) - rate - lgamma(n + 1))) OVER (PARTITION BY k ORDER BY n) AS upto
            FROM (SELECT k, rate, unnest(range(ceil(rate + 12 * sqrt(rate) + 24)::BIGINT)) AS n FROM r)),
        d AS (SELECT *, ('0x' || md5('{mixing.SEED}:' || coalesce('=' || doc_id, ''))[1:13])::BIGINT / (1::BIGINT << 52)::DOUBLE AS u FROM documents),
        c AS (SELECT doc_id, count(*) AS copies FROM d JOIN cdf ON k = coalesce('=' || source, '') AND upto <= u GROUP BY 1),
        x AS (SELECT doc_id, unnest(range(1, copies + 1)) AS copy_no FROM c)
        SELECT documents.*, copy_no, md5('{mixing.SEED}:=' || doc_id || ':' || copy_no) AS shuffle_key FROM x JOIN documents USING (doc_id)""",
    "op11_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) for c in embedding] AS x
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or([c IS NULL OR NOT isfinite(c) for c in embedding])),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
            FROM r AS a JOIN r AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3""",
}
