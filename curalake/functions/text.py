"""Text clean-up, names, paths and display labels."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from curalake.schemas import AVAILABILITY_LABELS, FALLBACK_SOURCE, GRAPH_SOURCE, SOURCE_LABELS


@F.pandas_udf(StringType())
def html_unescape(values: pd.Series) -> pd.Series:
    """Character references have no built-in; Arrow batches keep the UDF vectorised."""
    return values.map(html.unescape, na_action="ignore")


def strip(value: Column) -> Column:
    """Without leading and trailing white space of any kind, the information separators included."""
    return F.regexp_replace(value.cast("string"), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def plain_text(value: Column) -> Column:
    """Unescape first, then drop tags, so an escaped tag vanishes as well."""
    untagged = F.regexp_replace(html_unescape(value), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(untagged, r"(?U)[\s\x1c-\x1f]+", " "))


def folded(value: Column) -> Column:
    """Trimmed and lower-cased; null becomes empty."""
    return F.lower(strip(F.coalesce(value, F.lit(""))))


def is_blank(value: Column) -> Column:
    return strip(F.coalesce(value.cast("string"), F.lit(""))) == ""


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_directory(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def safe_name(image_id: Column, path: Column) -> Column:
    """Destination file name: sanitised id, two underscores, base name."""
    safe = F.regexp_replace(strip(F.coalesce(image_id, F.lit(""))), r"[^A-Za-z0-9_.-]+", "_")
    return F.when(safe == "", basename(path)).otherwise(F.concat(safe, F.lit("__"), basename(path)))


def quoted(value: Column, keep_slash: bool = True) -> Column:
    """Percent-encoding for URL paths: space is %20, ``~`` stays, ``*`` is encoded."""
    text = F.url_encode(value)
    text = F.replace(F.replace(F.replace(text, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(text, F.lit("%2F"), F.lit("/")) if keep_slash else text


def raw_url(base: str, repository: Column, revision: Column, path: Column) -> Column:
    return F.concat(
        F.lit(base), quoted(repository), F.lit("/resolve/"), quoted(revision, keep_slash=False), F.lit("/"), quoted(path)
    )


def image_path(annotation_path: Column) -> Column:
    """First ``/ann/`` becomes ``/img/`` and ``.json`` is dropped; other paths give null."""
    usable = annotation_path.contains("/ann/") & annotation_path.endswith(".json")
    return F.when(usable, F.regexp_replace(annotation_path, r"\A(.*?)/ann/((?s:.*))\.json\z", "$1/img/$2"))


def file_size_label(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", size / F.lit(1024.0)))
        .otherwise(F.format_string("%.1f MB", size / F.lit(1024.0 * 1024.0)))
    )


def title_case(value: Column) -> Column:
    """Underscores become spaces and each word's first ASCII letter is raised, the rest kept."""
    pieces = F.split(F.replace(value, F.lit("_"), F.lit(" ")), r"(?<=\W)(?=\w)")
    raised = F.transform(
        pieces,
        lambda w: F.when(w.rlike(r"\A\w"), F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))).otherwise(w),
    )
    return F.array_join(raised, "")


def availability_label(value: Column) -> Column:
    key = F.lower(strip(value))
    label = F.lit(None).cast("string")
    for name, text in AVAILABILITY_LABELS.items():
        label = F.when(key == name, text).otherwise(label)
    return F.coalesce(label, title_case(key))


def source_label(value: Column) -> Column:
    return F.when(value == GRAPH_SOURCE, SOURCE_LABELS[GRAPH_SOURCE]).otherwise(SOURCE_LABELS[FALLBACK_SOURCE])
