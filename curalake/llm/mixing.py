"""Mixing sources to target weights by Poisson replication.

A source of size s and target share w has the rate w * total / s. Each document's count is the inverse Poisson
distribution with that mean at a uniform number hashed from (seed, doc_id): independent of partitions and retries,
unbiased per source, and a document's count only grows when its source's rate grows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import attach, free_name, null_key
from curalake.session import config_table

SEED = 20_240
#: Without given targets a source's share is its size to this power: large sources are thinned, small ones repeated.
POWER = 0.7


def uniform(key: Column, seed: int) -> Column:
    """A double in [0, 1) from the first 52 bits of md5(seed:key)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... until what is left is far below one in 2**52."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.exp(-rate)
    start = F.struct(F.array(first).alias("cdf"), (-rate).alias("log_p"), first.alias("upto"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        upto = acc["upto"] + F.exp(log_p)
        return F.struct(F.concat(acc["cdf"], F.array(upto)).alias("cdf"), log_p.alias("log_p"), upto.alias("upto"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, targets: Mapping[str, float] | None = None, power: float = POWER, epochs: float = 1.0) -> DataFrame:
    """``source_key, size, rate, cdf``. Size: code points of all texts, one at least for each row."""
    sizes = docs.groupBy(null_key(F.col("source")).alias("source_key")).agg(F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))).alias("size"))
    if targets is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        given = config_table(docs.sparkSession, [(f"={k}", float(v)) for k, v in targets.items()], "source_key string, weight double")
        weighed = sizes.join(given, "source_key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sums = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight")).withColumn("one", F.lit(1))
    rate = F.coalesce(F.col("weight") / F.when(F.col("all_weight") > 0, F.col("all_weight")) * epochs * F.col("all_size") / F.col("size"), F.lit(0.0))
    rated = weighed.withColumn("one", F.lit(1)).join(sums, "one").select("source_key", "size", rate.alias("rate"))
    return rated.withColumn("cdf", poisson_cdf(F.col("rate")))


def mix(docs: DataFrame, targets: Mapping[str, float] | None = None, seed: int = SEED, power: float = POWER, epochs: float = 1.0,
        copy: str = "copy_no", key: str = "shuffle_key") -> DataFrame:
    """Each row of ``docs`` as many times as its count says, in a global random order.

    Adds ``copy`` (from 1) and ``key``, an md5 of (seed, doc_id, copy): rows are dealt to partitions by its hash and
    sorted by it inside. Null sources form one source, null texts have size one, a null doc_id is hashed as its own
    value; repeated rows of one doc_id get the same count and are each repeated. A source that the targets leave
    out has weight zero. Where ``docs`` has a column ``copy`` or ``key`` already, underscores go before the new one's name.
    """
    copy, key, own, cdf, count = (free_name(docs, n) for n in (copy, key, "_source_key", "_cdf", "_copies"))
    rates = source_rates(docs.select("source", "text"), targets, power, epochs).select(F.col("source_key").alias(own), F.col("cdf").alias(cdf))
    identity = null_key(F.col("doc_id"))
    placed = attach(docs.withColumn(own, null_key(F.col("source"))), rates, [own], F.col("doc_id"))
    u = uniform(identity, seed)
    counted = placed.withColumn(count, F.size(F.filter(cdf, lambda c: c <= u)))
    copies = counted.filter(F.col(count) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count).cast("bigint"))))
    keyed = copies.select(*docs.columns, copy, F.md5(F.concat(F.lit(f"{seed}:"), identity, F.lit(":"), F.col(copy).cast("string"))).alias(key))
    return keyed.repartition(key).sortWithinPartitions(key)
