"""The defect knowledge graph as node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake.functions.text import folded, is_blank
from curalake.session import class_table

@dataclass(frozen=True)
class Catalog:
    """A catalog in relational form."""

    defects: DataFrame  # object_type, class_name, display_name; all three may have ``seq``, the order of submission
    steps: DataFrame  # class_name, position, instruction
    parts: DataFrame  # class_name, part_id, part_name, mock_price, currency, fake_stock_quantity, availability_status, last_updated


@dataclass(frozen=True)
class Graph:
    """Five node tables and four edge tables, each with its unique key first."""

    object_type: DataFrame  # name
    defect: DataFrame  # class_name, display_name
    repair_step: DataFrame  # step_id, instruction
    part: DataFrame  # part_id, part_name
    inventory: DataFrame  # inventory_id, price, stock, status, last_updated
    can_have: DataFrame  # object_type, class_name
    has_repair_step: DataFrame  # class_name, step_id, position
    may_require: DataFrame  # class_name, part_id
    has_inventory: DataFrame  # part_id, inventory_id


KEYS = {
    "object_type": ["name"], "defect": ["class_name"], "repair_step": ["step_id"], "part": ["part_id"],
    "inventory": ["inventory_id"], "can_have": ["object_type", "class_name"],
    "has_repair_step": ["class_name", "step_id"], "may_require": ["class_name", "part_id"],
    "has_inventory": ["part_id", "inventory_id"],
}


def flatten_catalog(nested: DataFrame) -> Catalog:
    """Nested catalog rows (``schemas.CATALOG_DDL``) -> defects, steps, parts."""
    entries = nested.select("object_type", "inventory_last_updated", F.posexplode("defects").alias("seq", "entry"))
    entries = entries.select("object_type", "inventory_last_updated", "seq", "entry.*")
    steps = entries.select("class_name", "seq", F.posexplode("repair_steps").alias("position", "instruction"))
    return Catalog(
        defects=entries.select("object_type", "class_name", "display_name", "seq"),
        steps=steps.withColumn("position", (F.col("position") + 1).cast("bigint")),
        parts=entries.select("class_name", F.col("inventory_last_updated").alias("last_updated"), "seq", F.posexplode("parts").alias("place", "part")).select(
            "class_name", "last_updated", "part.*", F.struct("last_updated", "seq", "place").alias("seq")),
    )


def step_id(class_name: Column, position: Column) -> Column:
    """``class-step-01``; longer positions keep all digits."""
    return F.format_string("%s-step-%02d", class_name, position)


def _latest(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key; among repeated submissions the last one (``seq``) wins, and without ``seq`` the greatest row."""
    rest = [c for c in df.columns if c not in key and c != "seq"]
    if not rest:
        return df.select(*key).distinct()
    row = F.struct(*rest)
    packed = df.groupBy(*key).agg((F.max_by(row, F.struct("seq", row)) if "seq" in df.columns else F.max(row)).alias("_row"))
    return packed.select(*key, "_row.*")


def graph_from_catalog(catalog: Catalog) -> Graph:
    seq = lambda df: [c for c in ("seq",) if c in df.columns]
    steps = catalog.steps.withColumn("step_id", step_id(F.col("class_name"), F.col("position")))
    inventory = catalog.parts.select(
        *seq(catalog.parts),
        F.col("part_id").alias("inventory_id"), "mock_price", "currency", "fake_stock_quantity", "availability_status",
        "last_updated", F.lit(True).alias("is_simulated"),
    )
    tables = {
        "object_type": catalog.defects.select(F.col("object_type").alias("name")),
        "defect": catalog.defects.select("class_name", "display_name", *seq(catalog.defects)),
        "repair_step": steps.select("step_id", "instruction", *seq(steps)),
        "part": catalog.parts.select("part_id", "part_name", *seq(catalog.parts)),
        "inventory": inventory,
        "can_have": catalog.defects.select("object_type", "class_name"),
        "has_repair_step": steps.select("class_name", "step_id", "position"),
        "may_require": catalog.parts.select("class_name", "part_id"),
        "has_inventory": catalog.parts.select("part_id", F.col("part_id").alias("inventory_id")),
    }
    return Graph(**{name: _latest(df, KEYS[name]) for name, df in tables.items()})


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Merge without deletes: an incoming row replaces the row with its key, later ones win.

    One partially aggregated shuffle instead of an anti join plus a union.
    """
    values = [c for c in existing.columns if c not in key]
    version = F.struct(*[F.col(c) for c in order], F.struct(*values)) if values or order else F.struct(F.lit(0))
    # an existing row has generation 0 and a null order, which sorts lowest
    old = existing.select(*key, F.lit(0).alias("_gen"), F.struct(*values).alias("_row"))
    old = old.withColumn("_version", F.lit(None).cast(incoming.select(version.alias("v")).schema["v"].dataType))
    new = incoming.select(*key, F.lit(1).alias("_gen"), F.struct(*values).alias("_row"), version.alias("_version"))
    merged = old.unionByName(new).groupBy(*key).agg(F.max_by("_row", F.struct("_gen", "_version")).alias("_row"))
    return merged.select(*key, "_row.*") if values else merged.select(*key)


def upsert_graph(existing: Graph, incoming: Graph) -> Graph:
    return Graph(**{
        f.name: upsert(getattr(existing, f.name), getattr(incoming, f.name), KEYS[f.name]) for f in fields(Graph)
    })


def graph_nodes(graph: Graph) -> DataFrame:
    """All nodes as ``(label, node_key, text)``."""
    parts = [
        ("ObjectType", graph.object_type, "name", "name"), ("Defect", graph.defect, "class_name", "display_name"),
        ("RepairStep", graph.repair_step, "step_id", "instruction"), ("Part", graph.part, "part_id", "part_name"),
        ("InventoryRecord", graph.inventory, "inventory_id", "availability_status"),
    ]
    return _stack([df.select(F.lit(n).alias("label"), F.col(k).alias("node_key"), F.col(t).alias("text")) for n, df, k, t in parts])


def graph_edges(graph: Graph) -> DataFrame:
    """All edges as ``(label, from_key, to_key, position)``."""
    none = F.lit(None).cast("bigint")
    parts = [
        ("CAN_HAVE", graph.can_have, "object_type", "class_name", none),
        ("HAS_REPAIR_STEP", graph.has_repair_step, "class_name", "step_id", F.col("position")),
        ("MAY_REQUIRE", graph.may_require, "class_name", "part_id", none),
        ("HAS_INVENTORY", graph.has_inventory, "part_id", "inventory_id", none),
    ]
    return _stack([
        df.select(F.lit(n).alias("label"), F.col(a).alias("from_key"), F.col(b).alias("to_key"), p.cast("bigint").alias("position"))
        for n, df, a, b, p in parts
    ])


def _stack(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for df in frames[1:]:
        result = result.unionByName(df)
    return result


def seed_summary(catalog: Catalog) -> DataFrame:
    """Submitted rows per node label (not distinct nodes)."""
    count = lambda df, label: df.agg(F.count(F.lit(1)).alias("submitted")).select(F.lit(label).alias("label"), "submitted")
    objects = catalog.defects.agg(F.count_distinct("object_type").alias("submitted")).select(F.lit("ObjectType").alias("label"), "submitted")
    return _stack([
        objects, count(catalog.defects, "Defect"), count(catalog.steps, "RepairStep"),
        count(catalog.parts, "Part"), count(catalog.parts, "InventoryRecord"),
    ])


def defect_lookup(keys: DataFrame, defects: DataFrame, fold_stored: bool = True) -> DataFrame:
    """Look classes up by trimmed, case-folded name.

    The catalog folds both sides; the graph folds only the argument (``fold_stored=False``).
    """
    stored = F.lower("class_name") if fold_stored else F.col("class_name")
    table = defects.select(stored.alias("_key"), F.col("class_name").alias("found_class"), "display_name")
    return keys.withColumn("_key", folded(F.col("class_name"))).join(table, "_key", "left").drop("_key")


def parts_for_defect(graph: Graph, keys: DataFrame | None = None) -> DataFrame:
    """Defect -> part -> inventory record; rows, so that a class may have any number of parts."""
    edges = graph.may_require if keys is None else graph.may_require.join(keys.select("class_name").distinct(), "class_name", "left_semi")
    return edges.join(graph.part, "part_id").join(graph.has_inventory, "part_id").join(graph.inventory, "inventory_id").select(
        "class_name", "part_id", "part_name", "mock_price", "currency", "fake_stock_quantity", "availability_status", "last_updated"
    )


def repair_steps_for_defect(graph: Graph, keys: DataFrame | None = None) -> DataFrame:
    edges = graph.has_repair_step if keys is None else graph.has_repair_step.join(keys.select("class_name").distinct(), "class_name", "left_semi")
    return edges.join(graph.repair_step, "step_id").select("class_name", "position", "step_id", "instruction")


def inventory_last_updated(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.max("last_updated").alias("inventory_last_updated"))


def knowledge_records(catalog: Catalog) -> DataFrame:
    """One row per class: its name, its numbers of steps and parts, and the date of the whole inventory.

    The steps and parts themselves stay rows keyed by class (``catalog.steps``, ``catalog.parts``), of any number.
    """
    count = lambda df, name: df.groupBy("class_name").agg(F.count(F.lit(1)).alias(name))
    date = catalog.parts.agg(F.max("last_updated")).scalar()
    joined = catalog.defects.select("class_name", "display_name").join(count(catalog.steps, "step_count"), "class_name", "left")
    return joined.join(count(catalog.parts, "part_count"), "class_name", "left").select(
        "class_name", "display_name", F.coalesce("step_count", F.lit(0)).alias("step_count"), F.coalesce("part_count", F.lit(0)).alias("part_count"),
        date.alias("inventory_last_updated"),
    )


def graph_completeness(graph: Graph, class_names: Sequence[str], normal: str = "normal") -> DataFrame:
    """Per class: in configuration and graph, 2-3 steps and a part, or neither for the normal class."""
    steps = graph.has_repair_step.groupBy("class_name").agg(F.count(F.lit(1)).alias("s"))
    parts = graph.may_require.groupBy("class_name").agg(F.count(F.lit(1)).alias("p"))
    expected = class_table(graph.defect.sparkSession, class_names).select("class_name", F.lit(True).alias("expected"))
    known = graph.defect.select("class_name", F.lit(True).alias("present"))
    s, p = F.coalesce("s", F.lit(0)), F.coalesce("p", F.lit(0))
    problem = (
        F.when(F.col("expected").isNull(), "unexpected_class").when(F.col("present").isNull(), "missing_class")
        .when((F.col("class_name") == normal) & (s + p > 0), "normal_has_guidance")
        .when((F.col("class_name") != normal) & (~s.between(2, 3) | (p < 1)), "incomplete_guidance").otherwise("ok")
    )
    return known.join(expected, "class_name", "full").join(steps, "class_name", "left").join(parts, "class_name", "left").select(
        "class_name", s.alias("step_count"), p.alias("part_count"), problem.alias("status")
    )


def catalog_violations(catalogs: DataFrame, subject: str = "catalog_id") -> DataFrame:
    """Typed constraints of nested catalogs: ranges, lengths, blanks, unique classes."""
    top = F.array(*_broken({
        "object_type_empty": is_blank(F.col("object_type")), "date_empty": is_blank(F.col("inventory_last_updated")),
        "threshold_range": ~F.coalesce(F.col("confidence_threshold").between(0.0, 1.0), F.lit(False)),
        "message_empty": is_blank(F.col("unknown_message")), "no_defects": F.coalesce(F.size("defects"), F.lit(0)) < 1,
        "duplicate_class": F.size(F.array_distinct("defects.class_name")) < F.size("defects"),
    }))
    per_defect = F.flatten(F.transform("defects", lambda d: F.array(*_broken({
        "class_empty": F.coalesce(F.length(d["class_name"]), F.lit(0)) < 1,
        "display_name_empty": F.coalesce(F.length(d["display_name"]), F.lit(0)) < 1,
    }))))
    per_part = F.flatten(F.transform(F.flatten("defects.parts"), lambda p: F.array(*_broken({
        "part_id_empty": F.coalesce(F.length(p["part_id"]), F.lit(0)) < 1,
        "part_name_empty": F.coalesce(F.length(p["part_name"]), F.lit(0)) < 1,
        "price_negative": ~F.coalesce(p["mock_price"] >= 0, F.lit(False)),
        "currency_length": F.coalesce(F.length(p["currency"]), F.lit(0)) != 3,
        "stock_negative": ~F.coalesce(p["fake_stock_quantity"] >= 0, F.lit(False)),
        "availability_empty": F.coalesce(F.length(p["availability_status"]), F.lit(0)) < 1,
    }))))
    empty = F.array().cast("array<string>")
    rules = F.filter(F.concat(top, F.coalesce(per_defect, empty), F.coalesce(per_part, empty)), lambda r: r.isNotNull())
    return catalogs.select(F.col(subject).cast("string").alias("subject"), F.explode(rules).alias("rule"))


def _broken(rules: dict[str, Column]) -> list[Column]:
    return [F.when(F.coalesce(b, F.lit(False)), F.lit(r)) for r, b in rules.items()]
