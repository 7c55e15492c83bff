"""Exact medians of large groups by radix selection over the ordered bits of their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits per digit; a window holds at most 2 ** DIGIT counts of a group, whatever the group's size and spread.
DIGIT = 16
_FRACTION = float(1 << 52)


def ordered_bits(value: Column) -> Column:
    """A double as a long of the same order: sign, exponent and fraction as its 64 bits hold them; zeros are equal, NaN is last.

    Exponent and fraction come from exact arithmetic: the logarithm's estimate of the exponent is off by one at most.
    """
    size = F.abs(value)
    guess = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(size)).cast("int")))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = F.greatest(F.lit(-1022), F.when(size < power(guess), guess - 1).when(size / power(guess) >= 2.0, guess + 1).otherwise(guess))
    finite = (exponent + 1022).cast("bigint") * F.lit(1 << 52) + (size / power(exponent) * _FRACTION).cast("bigint")
    bits = F.when(size == 0.0, F.lit(0)).when(size == float("inf"), F.lit(2047 << 52)).otherwise(finite)
    return F.when(F.isnan(value), F.lit((2047 << 52) + 1)).otherwise(F.when(value < 0, -bits).otherwise(bits))


def exact_median(df: DataFrame, group: Sequence[str], value: str, few: bool = False) -> DataFrame:
    """``(group.., median)`` with linear interpolation between the middle values; null values do not count.

    The built-in ``median`` keeps every distinct value of a group in one task. Here equal values are counted first. The
    first digit of their ordered bits is counted for all, and of each further digit only what lies under the digit that
    holds a middle rank, until all 64 bits are known. ``few`` says that the groups are few by construction, such as
    configured classes: then the ranks, two rows per group, are broadcast; else Spark chooses.
    """
    group = list(group)
    integral = isinstance(df.schema[value].dataType, T.IntegralType)
    key = F.col(value).cast("bigint") if integral else ordered_bits(F.col(value).cast("double"))
    counted = df.filter(F.col(value).isNotNull()).select(*group, key.alias("_k"), F.col(value).alias("_v"))
    counted = counted.groupBy(*group, "_k").agg(F.count(F.lit(1)).alias("_n"), F.max("_v").alias("_v"))
    prefix = lambda step: F.shiftright("_k", 64 - DIGIT * step) if DIGIT * step < 64 else F.col("_k")
    running = lambda *keys: F.sum("_n").over(W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, 0))

    # both middle ranks of a group, and the first digit that holds each
    sizes = counted.groupBy(*group, prefix(1).alias("_p")).agg(F.sum("_n").alias("_n"))
    placed = sizes.withColumns({"_upto": running(*group), "_total": F.sum("_n").over(W.partitionBy(*group))})
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("w"), F.floor((F.col("_total") + 1) / 2).alias("r")), F.struct(F.lit(1).alias("w"), F.floor((F.col("_total") + 2) / 2).alias("r"))))
    held = placed.select("*", ranks.alias("_m")).filter("_upto - _n < _m.r AND _m.r <= _upto")
    targets = held.select(*group, F.col("_m.w").alias("_which"), F.col("_p").alias("_under"), (F.col("_m.r") - F.col("_upto") + F.col("_n")).alias("_rank"))
    for step in range(2, 64 // DIGIT + 1):
        under = counted.withColumn("_under", prefix(step - 1)).join(F.broadcast(targets) if few else targets, [*group, "_under"])
        sizes = under.groupBy(*group, "_which", prefix(step).alias("_p")).agg(F.sum("_n").alias("_n"), F.max("_rank").alias("_rank"), F.max("_v").alias("_v"))
        held = sizes.withColumn("_upto", running(*group, "_which")).filter("_upto - _n < _rank AND _rank <= _upto")
        targets = held.select(*group, "_which", F.col("_p").alias("_under"), (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), F.col("_v").alias("_value"))
        targets = targets.drop("_value") if DIGIT * step < 64 else targets
    middle = lambda which: F.max(F.when(F.col("_which") == which, F.col("_value")))
    return targets.groupBy(*group).agg(((middle(0).cast("double") + middle(1).cast("double")) / 2.0).alias("median"))
