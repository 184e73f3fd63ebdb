"""Counts and checks about a model's meshes, facts and clashes, and their writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import clash, geometry


def chain_contains(chain: Column, tag: str) -> Column:
    """True if a tag is a link of a provenance chain such as a|b|c."""
    return F.array_contains(F.split(chain, r"\|"), tag)


def chain_count(chain: Column, tag: str) -> Column:
    """How often a tag is a link of a chain."""
    return F.size(F.filter(F.split(chain, r"\|"), lambda x: x == tag))


def is_synthetic_cutter(chain: Column) -> Column:
    """True for chains of stand-in geometry: a cutter that is a half-space slab."""
    links = F.split(chain, r"\|")
    return F.array_contains(links, "boolean_cutter") & F.exists(links, lambda x: x.startswith("halfspace"))


def strip_synthetic(fragments: DataFrame) -> DataFrame:
    """fragments(source, ..) without stand-in cutters, before they are merged: nothing has to be renumbered."""
    return fragments.where(~is_synthetic_cutter(F.col("source")))


def is_unhandled_property(kind: Column, handled: list[str]) -> Column:
    """True for simple property types that have no reader."""
    return kind.rlike("^IFCPROPERTY.*VALUE$") & ~kind.isin(*handled)


def dtype_name(kind: Column) -> Column:
    """Spark's type names as a reader of tables expects them."""
    return F.when(kind.isin("string"), "str").when(kind.isin("bigint", "int", "smallint", "tinyint"), "int").when(kind.isin("double", "float") | kind.startswith("decimal"), "float").when(kind == "boolean", "bool").otherwise(kind)


def global_shift(origins: DataFrame, scale: float, limit_m: float = 10_000.0) -> DataFrame:
    """One row (x, y, z) to take off all coordinates: the first origin, rounded, where one lies over limit_m from zero; else 0.

    origins(ord, x, y, z) are placements in file units.
    """
    far = F.max(F.greatest(*[F.abs(F.col(c)) for c in "xyz"])) * scale > limit_m
    return origins.agg(far.alias("far"), F.min_by(F.struct("x", "y", "z"), "ord").alias("o")).select(*[F.when(F.col("far"), F.round(F.col(f"o.{c}"))).otherwise(0.0).alias(c) for c in "xyz"])


def mesh_errors(meshes: DataFrame) -> DataFrame:
    """(guid, error) of meshes(guid, vertices, indices) that are none: the first fault of each."""
    n = F.size("vertices") / 3
    error = (
        F.when(F.size("vertices") % 3 != 0, "vertices_not_in_threes").when(F.size("indices") % 3 != 0, "indices_not_in_threes").when(F.size("indices") == 0, "no_triangles")
        .when(F.exists("indices", lambda i: (i < 0) | (i >= n)), "index_out_of_range").when(F.exists("vertices", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "not_finite")
    )
    return meshes.select("guid", error.alias("error")).where("error IS NOT NULL")


def coherent(tris: DataFrame, most: float = 0.02) -> DataFrame:
    """(guid, coherent): at most that share of a mesh's undirected edges is not used once in each direction."""
    edge = lambda p, q: F.struct(F.col(p).alias("p"), F.col(q).alias("q"))
    edges = tris.select("guid", F.explode(F.array(edge("ia", "ib"), edge("ib", "ic"), edge("ic", "ia"))).alias("e")).where("e.p <> e.q")
    per = edges.groupBy("guid", F.least("e.p", "e.q").alias("lo"), F.greatest("e.p", "e.q").alias("hi")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("e.p") < F.col("e.q"), 1).otherwise(-1)).alias("s"))
    return per.groupBy("guid").agg((F.avg(F.when((F.col("n") == 2) & (F.col("s") == 0), 0.0).otherwise(1.0)) <= most).alias("coherent"))


def product_stats(meshes: DataFrame) -> DataFrame:
    """(guid, entity, triangle_count, area, volume, min_x .. max_z, aabb_volume) of meshes(guid, entity, vertices, indices)."""
    took = geometry.take_off(geometry.triangles(meshes)).select("guid", "triangle_count", "area", "volume")
    return meshes.select("guid", "entity").join(took, "guid").join(geometry.bounds(meshes), "guid")


def file_stats(stats: DataFrame) -> DataFrame:
    """One row: products, triangles, area and the box of all, from product_stats()."""
    return stats.agg(F.count("*").alias("products"), F.sum("triangle_count").alias("triangles"), F.sum("area").alias("area"), *[f(f"{m}_{x}").alias(f"{m}_{x}") for m, f in (("min", F.min), ("max", F.max)) for x in "xyz"])


def entity_stats(stats: DataFrame) -> DataFrame:
    """(entity, products, triangles) from product_stats()."""
    return stats.groupBy("entity").agg(F.count("*").alias("products"), F.sum("triangle_count").alias("triangles"))


def top(rows: DataFrame, by: str, n: int, key: str = "guid") -> DataFrame:
    """The n rows of the largest value, ties by key."""
    return rows.orderBy(F.desc(by), key).limit(n)


def write_csv(stats: DataFrame, path: str) -> None:
    """Statistics as CSV with a header; numbers with three decimals."""
    shown = [F.format_string("%.3f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in stats.dtypes]
    stats.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def semantic_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table; one count each."""
    return reduce(DataFrame.union, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()])


def clash_report(instances: DataFrame, meshes: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row: instances without a box, box pairs, pairs apart by more than the tolerance, hard and clearance clashes."""
    sides = [f"{m}_{x}" for m in ("min", "max") for x in "xyz"]
    bare = reduce(lambda a, b: a | b, [F.col(s).isNull() for s in sides])
    pairs = clash.broad_phase(instances, tolerance).agg(F.count("*").alias("box_pairs"))
    found = clash.clash(instances, meshes, tolerance).agg(F.count_if(F.col("kind") == "hard").alias("hard"), F.count_if(F.col("kind") == "clearance").alias("clearance"))
    whole = instances.agg(F.count_if(bare).alias("geometryless_skipped")).crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(found))  # one row each
    return whole.withColumn("narrow_phase_residuals", F.col("box_pairs") - F.col("hard") - F.col("clearance"))


def sidecars(products: DataFrame, tables: dict[str, DataFrame], by: str) -> DataFrame:
    """(by, n, json): a document for each value of a column with its products and their facts, ordered by guid.

    Products are dealt out one a row before they are gathered, so only finished texts meet.
    """
    from .substrate import nest

    nested = nest(products, tables)
    text = F.to_json(F.struct(*[c for c in nested.columns if c != by]))
    rows = nested.select(by, "guid", text.alias("text"))
    grouped = rows.groupBy(by).agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("guid", "text"))), lambda s: s["text"]).alias("texts"))
    return grouped.select(by, "n", F.concat(F.lit("["), F.array_join("texts", ","), F.lit("]")).alias("json"))


def ladder(tris: DataFrame) -> DataFrame:
    """(guid, tri, upto): the cumulative share of a mesh's area at each triangle."""
    area = F.col("mag") / 2
    whole = Window.partitionBy("guid")
    return tris.select("guid", "tri", (F.sum(area).over(whole.orderBy("tri").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum(area).over(whole)).alias("upto"))
