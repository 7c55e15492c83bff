"""Hashes, Hamming distance and order-free fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalake.functions.text import strip


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda is evaluated for every element; binding it
    to the variable of a one-element ``transform`` keeps it outside the loop.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_hex(col: Column, width: int) -> Column:
    """True for exactly ``width`` hex digits; ``\\A..\\z`` also refuses a trailing newline."""
    return F.coalesce(col.rlike(rf"\A[0-9a-fA-F]{{{width}}}\z"), F.lit(False))


def hash64(hex_hash: Column) -> Column:
    """16 hex digits as one signed BIGINT, built from two 32-bit halves."""
    text = F.lower(strip(hex_hash))
    high = F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(text, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def hex64(value: Column) -> Column:
    """Inverse of :func:`hash64`."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hamming(first: Column, second: Column) -> Column:
    """Bit distance of two BIGINT hashes."""
    return F.bit_count(first.bitwiseXOR(second)).cast("bigint")


def hex_hamming(first: Column, second: Column) -> Column:
    """Bit distance of two equal-width hex texts (up to 16 digits), else null."""
    a, b = F.lower(strip(first)), F.lower(strip(second))
    usable = (F.length(a) == F.length(b)) & a.rlike(r"\A[0-9a-f]{1,16}\z") & b.rlike(r"\A[0-9a-f]{1,16}\z")
    wide_a, wide_b = F.lpad(a, 16, "0"), F.lpad(b, 16, "0")
    return F.when(usable, hamming(hash64(wide_a), hash64(wide_b)))


def grid_difference_hash(grid: Column, size: int = 8) -> Column:
    """Difference hash of a row-major ``size x (size+1)`` grid, least significant bit first.

    Null for a grid that is missing or has another size.
    """
    def text(g: Column) -> Column:
        bits = F.transform(
            F.sequence(F.lit(size * size - 1), F.lit(0)),
            lambda i: F.when(F.get(g, _cell(i, size) + 1) > F.get(g, _cell(i, size)), F.lit("1")).otherwise(F.lit("0")),
        )
        digits = F.lpad(F.lower(F.conv(F.array_join(bits, ""), 2, 16)), (size * size + 3) // 4, "0")
        return F.when(F.size(g) == size * (size + 1), digits)

    return let(grid, text)


def _cell(bit: Column, size: int) -> Column:
    return ((bit - bit % size) / size).cast("int") * (size + 1) + bit % size


def seeded_key(seed: int, identity: Column) -> Column:
    """Reproducible pseudo-random order key: the md5 of ``seed:identity``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), identity))


def stable_id(class_name: Column, digest: Column) -> Column:
    """``class-<first 16 hex digits of a SHA-256>``."""
    return F.concat(class_name, F.lit("-"), F.substring(digest, 1, 16))


def row_digest(*columns: Column) -> Column:
    """SHA-256 of a row: lengths are part of the text, so shifted cells never collide."""
    parts = [
        F.when(c.isNull(), F.lit("-1:")).otherwise(
            F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
        )
        for c in columns
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)
