"""Long-format facts: properties, quantities, materials, classifications, and their inheritance from types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inherited(instance: DataFrame, of_types: DataFrame, type_of: DataFrame, keys: list[str]) -> DataFrame:
    """instance facts and those of each item's type whose (guid, keys) the item does not state itself.

    Only rows of types are suppressed; repeated rows on either side all stay. An item's keys and a type's facts travel as
    one array each, so an item is one row in both joins.
    """
    more = [c for c in instance.columns if c != "guid"]
    handed = of_types.groupBy(F.col("guid").alias("_type")).agg(F.collect_list(F.struct(*more)).alias("_facts"))
    stated = instance.groupBy("guid").agg(F.collect_set(F.struct(*keys)).alias("_stated"))
    rows = type_of.select("guid", F.col("type_guid").alias("_type")).join(handed, "_type").select("guid", "_facts").join(stated, "guid", "left")
    same = lambda f: F.exists("_stated", lambda s: F.coalesce(reduce(Column.__and__, [s[k] == f[k] for k in keys]), F.lit(False)))
    fresh = F.filter("_facts", lambda f: ~F.coalesce(same(f), F.lit(False)))
    return instance.unionByName(rows.select("guid", F.explode(fresh).alias("_f")).select("guid", "_f.*").select(*instance.columns))


def unit_fallback(quantities: DataFrame, units: DataFrame) -> DataFrame:
    """quantities with unit_step_id filled from units(quantity_type, project_unit) where they name none."""
    fallback = units.select("quantity_type", F.col("project_unit").alias("_unit"))
    return quantities.join(fallback, "quantity_type", "left").withColumn("unit_step_id", F.coalesce("unit_step_id", "_unit")).drop("_unit").select(*quantities.columns)


def materials(assignments: DataFrame, direct: DataFrame, members: DataFrame) -> DataFrame:
    """(guid, role, layer_index, material_name, layer_thickness_mm) from assignments(guid, container).

    A container is looked for among direct(container, material_name) and then members(container, role,
    layer_index, material_name, thickness_mm), of which the first role by list, constituent, profile, layer
    counts; a container found nowhere gives one row of role unknown.
    """
    order = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(("list", "constituent", "profile", "layer"))], F.lit(9))
    ranked = members.withColumn("_rank", order)
    best = ranked.groupBy("container").agg(F.min("_rank").alias("_best"))
    mine = ranked.join(best, "container").where("_rank = _best").select("container", "role", "layer_index", "material_name", "thickness_mm")
    one = direct.select("container", F.lit("direct").alias("role"), F.lit(-1).alias("layer_index"), "material_name", F.lit(None).cast("double").alias("thickness_mm"))
    known = one.union(mine.join(one.select("container"), "container", "left_anti").select(one.columns))
    joined = assignments.join(known, "container", "left")
    return joined.select("guid", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("layer_index", F.lit(-1)).cast("int").alias("layer_index"), "material_name", F.col("thickness_mm").alias("layer_thickness_mm"))


def filter_facts(facts: DataFrame, guid: str | None = None, limit: int = 200, **equal: str | None) -> DataFrame:
    """Rows of a fact table that match each given value, at most `limit` of them by value order."""
    for name, value in {"guid": guid, **equal}.items():
        if value is not None:
            facts = facts.where(F.col(name) == value)
    return facts.orderBy(*facts.columns).limit(limit)


def storey_counts(psets: DataFrame, wanted: list[tuple[str, str, str]], products: DataFrame, storeys: DataFrame) -> DataFrame:
    """(storey_guid, n) of the products that have each (pset, property, value) of wanted."""
    hit = None
    for pset, prop, value in wanted:
        own = psets.where((F.col("pset_name") == pset) & (F.col("prop_name") == prop) & (F.col("value") == value)).select("guid").distinct()
        hit = own if hit is None else hit.join(own, "guid", "left_semi")
    return products.join(hit, "guid", "left_semi").join(storeys, "guid").groupBy("storey_guid").agg(F.count("*").alias("n"))


def format_number(x: Column) -> Column:
    """Whole numbers below 1e15 without decimals, others in the shortest plain notation."""
    text = x.cast("string")
    plain = F.regexp_replace(F.format_string("%.17f", x), r"(\.\d*?)0+$", "$1")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).when(text.contains("E"), F.regexp_replace(plain, r"\.$", "")).otherwise(text)


def format_bounded(low: Column, high: Column, at: Column) -> Column:
    """lo..hi@set with what is known; null if nothing is."""
    span = F.when(low.isNotNull() | high.isNotNull(), F.concat(F.coalesce(low, F.lit("")), F.lit(".."), F.coalesce(high, F.lit(""))))
    return F.when(span.isNull() & at.isNull(), F.lit(None)).otherwise(F.concat(F.coalesce(span, F.lit("")), F.when(at.isNotNull(), F.concat(F.lit("@"), at)).otherwise(F.lit(""))))


def join_values(values: Column) -> Column:
    """The values that are not null, joined by a comma and a blank; null without any."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.array_join(known, ", "))


def join_table(keys: Column, values: Column) -> Column:
    """key=>value pairs up to the shorter list, ? for a null."""
    n = F.least(F.size(keys), F.size(values))
    pair = lambda k, v: F.concat(F.coalesce(k, F.lit("?")), F.lit("=>"), F.coalesce(v, F.lit("?")))
    return F.when(n > 0, F.array_join(F.zip_with(F.slice(keys, 1, n), F.slice(values, 1, n), pair), ", "))
