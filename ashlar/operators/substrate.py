"""The two-table nested layout: shared representations, and instances with their facts as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .meshes import merged

#: Instances joined to the shape they share.
VIEW = "SELECT i.*, r.* EXCEPT (rep_id) FROM {instances} i LEFT JOIN {representations} r ON i.rep_id = r.rep_id"


def nest(instances: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """instances(guid, ..) with an array of structs for each fact table(guid, ..), sorted, empty where none is."""
    out = instances
    for name, facts in tables.items():
        fields = [c for c in facts.columns if c != "guid"]
        row = F.struct(*fields)
        grouped = facts.groupBy("guid").agg(F.sort_array(F.collect_list(row)).alias(name))
        out = out.join(grouped, "guid", "left")
        kind = grouped.schema[name].dataType.simpleString()
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def representations(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep_id, source_kind, mesh_source, vertices, indices, segments) once a shape, and (guid, rep_id).

    A product of one item has the item's shape, which all products with that item share; one of several has a
    composite shape of its own, with every fragment of every item in it.
    """
    shaped = fragments.where(F.size("indices") > 0)
    items = shaped.groupBy("guid").agg(F.count_distinct("item_id").alias("n"), F.min("item_id").alias("item_id"))
    of = items.select("guid", F.when(F.col("n") == 1, F.concat(F.lit("item:"), F.col("item_id").cast("string"))).otherwise(F.concat(F.lit("product:"), "guid")).alias("rep_id"))
    # One product stands for all that share a shape; equal shapes have equal fragments.
    holders = of.groupBy("rep_id").agg(F.min("guid").alias("guid"))
    whole = merged(shaped.join(holders, "guid")).join(holders, "guid")
    kind = F.when(F.col("rep_id").startswith("item:"), "shared").otherwise("composite").alias("source_kind")
    return whole.select("rep_id", kind, F.array_join(F.array_distinct(F.transform("segments", lambda s: s["source"])), ";").alias("mesh_source"), "vertices", "indices", "segments"), of


def write_bundle(instances: DataFrame, shapes: DataFrame, path: str) -> None:
    """Both tables under a folder, as zstd Parquet."""
    instances.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/instances")
    shapes.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/representations")


def read_view(spark, path: str) -> DataFrame:
    """The view over a bundle: every instance with its shape, or nulls."""
    return spark.sql(VIEW, instances=spark.read.parquet(f"{path}/instances"), representations=spark.read.parquet(f"{path}/representations"))
