"""Polygon annotations -> at most one crop candidate per image.

An annotation is one row with its objects nested, so admission, overlap and the
choice of the largest object are array expressions: no shuffle and no self join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake import schemas as S
from curalake.functions.geometry import area, bounding_box, covered_fraction, square_crop
from curalake.functions.hashing import let
from curalake.functions.text import image_path, is_blank, strip
from curalake.session import computed


def usable_objects(objects: Column) -> Column:
    """Polygons with a title and at least three numeric points, with label and bounding box."""
    def numeric(points: Column) -> Column:
        return F.filter(points, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())

    polygons = F.filter(
        objects, lambda o: (o["geometryType"] == "polygon") & (strip(F.coalesce(o["classTitle"], F.lit(""))) != "") & (F.size(o["points"]["exterior"]) >= 3)
    )
    cleaned = F.transform(polygons, lambda o: F.struct(strip(o["classTitle"]).alias("title"), numeric(o["points"]["exterior"]).alias("points")))
    return F.transform(F.filter(cleaned, lambda o: F.size(o["points"]) >= 3), lambda o: F.struct(
        o["title"].alias("title"), F.lower(o["title"]).alias("label"), bounding_box(o["points"]).alias("box")
    ))


def admission(width: Column, height: Column, objects: Column) -> Column:
    """First reason why an annotation cannot give a candidate, or ``admitted``."""
    size = F.least(width, height)
    return (
        F.when(width.isNull() | height.isNull(), "missing_size").when(size < S.MINIMUM_CROP, "image_too_small")
        .when(F.coalesce(F.size(objects), F.lit(0)) < 1, "no_usable_object").otherwise("admitted")
    )


def mapped_class(label: Column) -> Column:
    """Damage label -> class, null for other labels."""
    result = F.lit(None).cast("string")
    for name, target in S.DAMAGE_LABELS.items():
        result = F.when(label == name, target).otherwise(result)
    return result


def worst_overlap(target: Column, objects: Column) -> Column:
    """Largest covered fraction of ``target`` by an object with a different label, 0 if there is none."""
    rivals = F.filter(objects, lambda o: o["label"] != target["label"])
    return F.coalesce(F.array_max(F.transform(rivals, lambda o: covered_fraction(target["box"], o["box"]))), F.lit(0.0))


def with_objects(annotations: DataFrame) -> DataFrame:
    """Adds ``usable`` (normalised objects) and ``status``; keeps unusable rows."""
    parsed = computed(annotations, usable=usable_objects(F.col("objects")))
    return parsed.withColumn("status", admission(F.col("size.width"), F.col("size.height"), F.col("usable")))


def scored_objects(annotations: DataFrame) -> DataFrame:
    """Admitted annotations with each object's class, area and overlap."""
    rows = with_objects(annotations).filter(F.col("status") == "admitted")
    is_damage = F.col("source_kind") == "damage"
    scored = F.transform("usable", lambda o: F.struct(
        o["title"].alias("title"), o["label"].alias("label"), o["box"].alias("box"), area(o["box"]).alias("area"),
        F.when(is_damage, worst_overlap(o, F.col("usable"))).otherwise(F.lit(0.0)).alias("overlap"),
        F.when(is_damage, mapped_class(o["label"])).when(o["label"].isin(S.PANEL_LABELS), "normal").alias("class_name"),
    ))
    return computed(rows, scored=scored)


def crop_candidates(annotations: DataFrame) -> DataFrame:
    """One candidate per annotation: its largest unambiguous object, the first on ties.

    Columns in: ``annotation_path, source_kind, size, objects``.
    """
    eligible = F.filter("scored", lambda o: o["class_name"].isNotNull() & (o["overlap"] <= S.MAXIMUM_OVERLAP))
    rows = computed(scored_objects(annotations), eligible=eligible)
    first = let(F.array_max(F.transform("eligible", lambda o: o["area"])), lambda top: F.get(
        F.filter("eligible", lambda o: o["area"] == top), F.lit(0)
    ))
    chosen = computed(rows.filter(F.size("eligible") > 0), chosen=first)
    cropped = computed(chosen, crop_box=square_crop(F.col("chosen.box"), F.col("size.width"), F.col("size.height")))
    path = image_path(F.col("annotation_path"))
    return cropped.filter("crop_box IS NOT NULL").select(
        F.col("chosen.class_name").alias("class_name"), F.col("chosen.title").alias("source_label"), "annotation_path",
        path.alias("image_path"), path.alias("source_group"), "crop_box",
        F.col("size.width").alias("annotation_width"), F.col("size.height").alias("annotation_height"),
        F.least(F.col("crop_box.right") - F.col("crop_box.left"), F.col("crop_box.bottom") - F.col("crop_box.top")).alias("short_side"),
    )


def licensed_candidates(listing: DataFrame, excluded: DataFrame | None, limit: int) -> DataFrame:
    """First ``limit`` new groups by page id that have a licence name and URL.

    ``listing``: ``page_id, title, licence, licence_url, ...``; one row per page is
    kept. The limit is the request size of an acquisition run.
    """
    complete = listing.filter(~is_blank(F.col("licence")) & ~is_blank(F.col("licence_url")))
    rows = complete.withColumn("source_group", F.concat(F.lit("commons-"), F.col("page_id").cast("string")))
    if excluded is not None:
        rows = rows.join(excluded.select("source_group").distinct(), "source_group", "left_anti")
    rest = [c for c in rows.columns if c != "page_id"]
    unique = rows.groupBy("page_id").agg(F.min(F.struct(*rest)).alias("_row")).select("page_id", "_row.*")
    return unique.orderBy("page_id").limit(limit).withColumn(
        "licence", F.concat(strip(F.col("licence")), F.lit(" ("), strip(F.col("licence_url")), F.lit(")"))
    )


def candidate_shortfall(candidates: DataFrame, limit: int) -> DataFrame:
    """``(rule, subject)``: one row if there are fewer candidates than the request size."""
    found = candidates.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < limit)
    return found.select(F.lit("candidate_shortfall").alias("rule"), F.format_string(f"%d of {int(limit)}", "n").alias("subject"))


def large_candidates(candidates: DataFrame, scan: DataFrame, minimum: int = S.MINIMUM_SHORT_SIDE) -> DataFrame:
    """Candidates whose scanned image decodes and has a short side of at least ``minimum``, with that ``short_side``.

    ``scan``: ``source_group, short_side`` per image, null where it does not decode (``images.decode_audit``).
    """
    sides = scan.groupBy("source_group").agg(F.min("short_side").alias("short_side")).filter(F.col("short_side") >= minimum)
    return candidates.drop("short_side").join(sides, "source_group")
