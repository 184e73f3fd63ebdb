"""Aggregates over products and facts: counts, type summaries, differences, floors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_counts(products: DataFrame) -> DataFrame:
    return products.groupBy("entity").agg(F.count("*").alias("n"))


def distinct_text(column: Column) -> Column:
    """The distinct non-null values, sorted and joined by a bar."""
    return F.array_join(F.sort_array(F.collect_set(column)), "|")


def type_summary(products: DataFrame, sample_guids: int = 3) -> DataFrame:
    """(entity, n, predefined_types, object_types, sample_guids), the first guids by step_id."""
    place = Window.partitionBy("entity").orderBy("step_id", "guid")
    # Only the first few rows of each entity are gathered; rank() over the window is limited by Spark per partition.
    first = products.select("entity", "step_id", "guid").withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample_guids)
    sample = first.groupBy("entity").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "guid"))), lambda s: s["guid"]), "|").alias("sample_guids"))
    whole = products.groupBy("entity").agg(F.count("*").alias("n"), distinct_text(F.col("predefined_type")).alias("predefined_types"), distinct_text(F.col("object_type")).alias("object_types"))
    return whole.join(sample, "entity")


def type_bank(products: DataFrame, materials: DataFrame, classifications: DataFrame) -> DataFrame:
    """(entity, n, materials, classifications): distinct material names and system:identification texts."""
    of = products.select("guid", "entity")
    m = materials.where("material_name IS NOT NULL").join(of, "guid").groupBy("entity").agg(distinct_text(F.col("material_name")).alias("materials"))
    c = classifications.join(of, "guid").groupBy("entity").agg(distinct_text(F.concat_ws(":", "system_name", "identification")).alias("classifications"))
    return entity_counts(products).join(m, "entity", "left").join(c, "entity", "left").select("entity", "n", F.coalesce("materials", F.lit("")).alias("materials"), F.coalesce("classifications", F.lit("")).alias("classifications"))


WATCHED = ("entity", "name", "predefined_type", "object_type", "tag", "storey_name", "storey_guid")


def added(left: DataFrame, right: DataFrame, key: str = "guid") -> DataFrame:
    """Rows of right whose key left lacks."""
    return right.join(left.select(key), key, "left_anti")


def removed(left: DataFrame, right: DataFrame, key: str = "guid") -> DataFrame:
    return added(right, left, key)


def changed(left: DataFrame, right: DataFrame, fields: tuple[str, ...] = WATCHED, key: str = "guid") -> DataFrame:
    """(key, field, before, after) for each watched field that differs; two nulls are equal."""
    l = left.select(key, *[F.col(f).alias(f"l_{f}") for f in fields])  # noqa: E741
    r = right.select(key, *[F.col(f).alias(f"r_{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").cast("string").alias("before"), F.col(f"r_{f}").cast("string").alias("after")) for f in fields])
    differing = F.filter(each, lambda x: ~x["before"].eqNullSafe(x["after"]))
    return l.join(r, key).select(key, F.explode(differing).alias("x")).select(key, "x.*")


def count_deltas(left: DataFrame, right: DataFrame, by: str = "entity") -> DataFrame:
    """(by, n_left, n_right, delta) where the counts differ."""
    l, r = left.groupBy(by).agg(F.count("*").alias("n_left")), right.groupBy(by).agg(F.count("*").alias("n_right"))  # noqa: E741
    both = l.join(r, by, "full_outer").select(by, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.withColumn("delta", F.col("n_right") - F.col("n_left")).where("delta <> 0")


def drop_leading_zero(name: Column) -> Column:
    """Each token's number without leading zeros: digits alone, or letters and then digits."""
    bare = lambda t: F.regexp_replace(t, r"^(\p{L}*)0+(\d+)$", "$1$2")
    return F.array_join(F.transform(F.filter(F.split(F.trim(name), r"\s+"), lambda t: t != ""), bare), " ")


def cluster_elevations(storeys: DataFrame, tolerance: float = 100.0, group: str = "model_name") -> DataFrame:
    """storeys with cluster, a number within each group, by a greedy pass over rising elevations.

    A storey joins the running cluster if it is within tolerance of the cluster's mean so far, else
    it opens the next one. Equal elevations go by name and guid. One group's storeys (a building's, a few
    hundred) are folded as an array.
    """
    row = F.struct("elevation_mm", "storey_name", "storey_guid", *[c for c in storeys.columns if c not in (group, "elevation_mm", "storey_name", "storey_guid")])
    gathered = storeys.groupBy(group).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).alias("cluster"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        e = r["elevation_mm"]
        stays = (acc["n"] > 0) & (F.abs(e - acc["total"] / acc["n"]) <= tolerance)
        cluster = F.when(stays | (acc["n"] == 0), acc["cluster"]).otherwise(acc["cluster"] + 1)
        return F.struct(cluster.alias("cluster"), F.when(stays, acc["total"] + e).otherwise(e).alias("total"), F.when(stays, acc["n"] + 1).otherwise(1).alias("n"), F.concat(acc["out"], F.array(cluster)).alias("out"))

    numbered = gathered.withColumn("clusters", F.aggregate("rows", start, step, lambda acc: acc["out"]))
    return numbered.select(group, F.explode(F.arrays_zip("rows", "clusters")).alias("z")).select(group, "z.rows.*", F.col("z.clusters").alias("cluster"))


def floor_labels(clustered: DataFrame, group: str = "model_name", prefix: str = "", overrides: dict[str, str] | None = None, final: tuple[str, ...] = (), drop_zeros: bool = True) -> DataFrame:
    """(group, cluster, elevation_mm, n, most_common, label) of each cluster.

    The most common name wins, ties going to the lowest elevation and then the name. An override for any member's
    name, raw or cleaned, decides the label; else the cleaned name, with the prefix unless it
    has it already or is a final label.
    """
    clean = drop_leading_zero(F.col("storey_name")) if drop_zeros else F.col("storey_name")
    table = overrides or {}
    given = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("storey_name")) if table else F.lit(None).cast("string")
    also = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("clean")) if table else F.lit(None).cast("string")
    rows = clustered.withColumn("clean", clean).withColumn("override", F.coalesce(given, also))
    names = rows.groupBy(group, "cluster", "storey_name").agg(F.count("*").alias("c"), F.min(F.struct("elevation_mm", "storey_name")).alias("first"), F.first("clean").alias("clean"))
    best = names.groupBy(group, "cluster").agg(F.min_by(F.struct("storey_name", "clean"), F.struct((-F.col("c")).alias("c"), F.col("first.elevation_mm"), F.col("storey_name"))).alias("best"))
    whole = rows.groupBy(group, "cluster").agg(F.avg("elevation_mm").alias("elevation_mm"), F.count("*").alias("n"), F.min(F.when(F.col("override").isNotNull(), F.struct("elevation_mm", "storey_name", "override")))["override"].alias("override"))
    label = F.coalesce("override", F.when(F.col("best.clean").isin(*final) if final else F.lit(False), F.col("best.clean")).when(F.col("best.clean").startswith(prefix) if prefix else F.lit(False), F.col("best.clean")).otherwise(F.concat(F.lit(prefix), F.col("best.clean"))))
    return whole.join(best, [group, "cluster"]).select(group, "cluster", "elevation_mm", "n", F.col("best.storey_name").alias("most_common"), label.alias("label"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
