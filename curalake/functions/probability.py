"""Softmax and argmax over ``array<float|double>`` logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalake.functions.hashing import let


def softmax(logits: Column) -> Column:
    """Shifted by the maximum, so large logits do not overflow."""
    doubles = F.transform(logits, lambda x: x.cast("double"))
    scaled = let(doubles, lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top))))
    return let(scaled, lambda e: let(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total)))


def argmax(values: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")
