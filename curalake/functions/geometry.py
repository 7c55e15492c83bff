"""Boxes as ``struct<left,top,right,bottom>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalake.functions.hashing import let
from curalake.schemas import MINIMUM_CROP


def box(left: Column, top: Column, right: Column, bottom: Column, kind: str = "double") -> Column:
    return F.struct(
        left.cast(kind).alias("left"), top.cast(kind).alias("top"),
        right.cast(kind).alias("right"), bottom.cast(kind).alias("bottom"),
    )


def bounding_box(points: Column) -> Column:
    """Axis-aligned box of an ``array<array<double>>`` of points."""
    xs = F.transform(points, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(points, lambda p: F.get(p, F.lit(1)))
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def area(b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b["right"] - b["left"]) * F.greatest(zero, b["bottom"] - b["top"])


def covered_fraction(target: Column, other: Column) -> Column:
    """Intersection area over the target's area; a degenerate target counts as covered."""
    zero = F.lit(0.0)
    across = F.greatest(zero, F.least(target["right"], other["right"]) - F.greatest(target["left"], other["left"]))
    down = F.greatest(zero, F.least(target["bottom"], other["bottom"]) - F.greatest(target["top"], other["top"]))
    return let(area(target), lambda whole: F.when(whole <= 0, F.lit(1.0)).otherwise(across * down / whole))


def square_crop(b: Column, width: Column, height: Column, margin: float = 0.20, minimum: int = MINIMUM_CROP) -> Column:
    """Square box with context around ``b``, clamped to the image; null when it ends up too small."""
    wide, high = width.cast("double"), height.cast("double")
    wanted = F.greatest(b["right"] - b["left"], b["bottom"] - b["top"]) * F.lit(1.0 + 2.0 * margin)
    limit = F.lit(float(minimum))

    def place(side: Column) -> Column:
        left = F.greatest(F.lit(0.0), F.least((b["left"] + b["right"]) / 2.0 - side / 2.0, wide - side))
        top = F.greatest(F.lit(0.0), F.least((b["top"] + b["bottom"]) / 2.0 - side / 2.0, high - side))
        return F.struct(left.alias("left"), top.alias("top"), side.alias("side"))

    def rounded(p: Column) -> Column:
        return box(F.bround(p["left"]), F.bround(p["top"]), F.bround(p["left"] + p["side"]), F.bround(p["top"] + p["side"]), "int")

    def roomy(c: Column) -> Column:
        return F.when((c["right"] - c["left"] >= minimum) & (c["bottom"] - c["top"] >= minimum), c)

    side = F.least(F.greatest(wanted, limit), wide, high)
    return let(let(let(side, place), rounded), roomy)


def scaled_crop(b: Column, annotated_width: Column, annotated_height: Column, width: Column, height: Column) -> Column:
    """Crop box moved from annotation coordinates to the decoded image's size."""
    sx = width.cast("double") / annotated_width.cast("double")
    sy = height.cast("double") / annotated_height.cast("double")
    zero = F.lit(0)
    return box(
        F.greatest(zero, F.bround(b["left"] * sx).cast("int")),
        F.greatest(zero, F.bround(b["top"] * sy).cast("int")),
        F.least(width.cast("int"), F.bround(b["right"] * sx).cast("int")),
        F.least(height.cast("int"), F.bround(b["bottom"] * sy).cast("int")),
        "int",
    )


def crop_json(b: Column) -> Column:
    """Compact JSON array ``[left,top,right,bottom]``."""
    return F.to_json(F.array(b["left"], b["top"], b["right"], b["bottom"]))
