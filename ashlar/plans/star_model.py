"""The relational driver tables seen as a building model, so that every operator runs on them.

Region, nation and supplier become site, building and storey; customers, orders and line items become
products; parts become type objects. MODEL_SQL states the same tables for DuckDB.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.durable import durable

SEGMENTS = {"AUTOMOBILE": "IfcWall", "BUILDING": "IfcSlab", "FURNITURE": "IfcFurniture", "HOUSEHOLD": "IfcDoor", "MACHINERY": "IfcPipeSegment"}
PRIORITIES = {"1-URGENT": "IfcWallStandardCase", "2-HIGH": "IfcBeam", "3-MEDIUM": "IfcSpace", "4-NOT SPECIFIED": "IfcBuildingElementProxy", "5-LOW": "IfcElementAssembly"}
FLAGS = {"AF": "IfcPipeFitting", "AO": "IfcDuctFitting", "NF": "IfcCovering", "NO": "IfcOpeningElement", "RF": "IfcPlate", "RO": "IfcSensor"}
PRODUCT_COLUMNS = ["guid", "step_id", "entity", "name", "predefined_type", "object_type", "tag", "type_guid"]


def _mapped(value: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def _text(value: str | Column) -> Column:
    return F.col(value).cast("string") if isinstance(value, str) else value.cast("string")


class StarModel:
    """Lazy canonical tables over a folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._lines: DataFrame | None = None

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        """lineitem with one row a key: the last by part, supplier, quantity, price and date."""
        return self._lines if self._lines is not None else self._guided(self._last(self.raw("lineitem").columns))

    def _last(self, columns: list[str]) -> DataFrame:
        """lines() with some columns, keys included, and no guid; only what is asked for, or decides on it, is shuffled."""
        keys, order = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
        more = [c for c in columns if c not in keys]
        rows = self.raw("lineitem")
        if not more:
            return rows.select(*keys).distinct()
        # The first columns of the order decide alone where no others are asked for.
        deciding = next((order[:n] for n in range(1, len(order)) if set(more) <= set(order[:n])), order)
        last = Window.partitionBy(*keys).orderBy(*map(F.desc, deciding))
        return rows.select(*dict.fromkeys([*columns, *deciding])).withColumn("_place", F.row_number().over(last)).where("_place = 1").select(*columns)

    @staticmethod
    def _guided(rows: DataFrame) -> DataFrame:
        return rows.withColumn("guid", F.concat(F.lit("L"), _text("l_orderkey"), F.lit("-"), _text("l_linenumber")))

    def staged(self, *columns: str) -> StarModel:
        """This model with lines() written once, for queries that read it several times; with columns, the keys and those only."""
        used = columns or ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
        self._lines = self._guided(durable(self._last(["l_orderkey", "l_linenumber", *used])))
        return self

    def staged_keys(self) -> StarModel:
        """staged() without any column but the keys."""
        self._lines = self._guided(durable(self._last(["l_orderkey", "l_linenumber"])))
        return self

    def products(self) -> DataFrame:
        return self.other_products().unionByName(self.line_products())

    def other_products(self) -> DataFrame:
        """products() other than lines, whose ids begin with L."""
        null = F.lit(None).cast("string")
        c = self.raw("customer").select(
            F.concat(F.lit("C"), _text("c_custkey")).alias("guid"), (F.col("c_custkey") + 1_000_000_000).alias("step_id"), _mapped(F.col("c_mktsegment"), SEGMENTS).alias("entity"), F.col("c_name").alias("name"),
            null.alias("predefined_type"), F.col("c_mktsegment").alias("object_type"), _text("c_custkey").alias("tag"), null.alias("type_guid"),
        )
        o = self.raw("orders").select(
            F.concat(F.lit("O"), _text("o_orderkey")).alias("guid"), (F.col("o_orderkey") + 2_000_000_000).alias("step_id"), _mapped(F.col("o_orderpriority"), PRIORITIES).alias("entity"), F.concat(F.lit("Order "), _text("o_orderkey")).alias("name"),
            F.col("o_orderstatus").alias("predefined_type"), F.col("o_orderpriority").alias("object_type"), _text("o_custkey").alias("tag"), null.alias("type_guid"),
        )
        return c.unionByName(o)

    def product_guids(self) -> DataFrame:
        """(guid) of products(), from keys alone."""
        of = lambda name, letter, key: self.raw(name).select(F.concat(F.lit(letter), _text(key)).alias("guid"))
        return of("customer", "C", "c_custkey").union(of("orders", "O", "o_orderkey")).union(self.lines().select("guid"))

    def line_products(self) -> DataFrame:
        return self.lines().select(
            "guid", (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 3_000_000_000).alias("step_id"), _mapped(F.concat("l_returnflag", "l_linestatus"), FLAGS).alias("entity"),
            F.concat(F.lit("Line "), _text("l_linenumber")).alias("name"), F.col("l_linestatus").alias("predefined_type"), F.col("l_returnflag").alias("object_type"), _text("l_suppkey").alias("tag"), F.concat(F.lit("T"), _text("l_partkey")).alias("type_guid"),
        )

    def storeys(self) -> DataFrame:
        return self.raw("supplier").select(F.concat(F.lit("S"), _text("s_suppkey")).alias("guid"), F.col("s_name").alias("name"), F.round("s_acctbal").alias("elevation"), F.concat(F.lit("N"), _text("s_nationkey")).alias("building_guid"))

    def storey_building(self) -> DataFrame:
        return self.storeys().select(F.col("guid").alias("storey_guid"), "building_guid")

    def aggregates(self) -> DataFrame:
        def edge(df: DataFrame, child: Column, parent: Column, kind: str) -> DataFrame:
            return df.select(child.alias("child_guid"), parent.alias("parent_guid"), F.lit(kind).alias("parent_kind"))

        key = lambda letter, name: F.concat(F.lit(letter), _text(name))
        parts = [
            edge(self.raw("region"), key("R", "r_regionkey"), F.lit("P0"), "project"),
            edge(self.raw("nation"), key("N", "n_nationkey"), key("R", "n_regionkey"), "site"),
            edge(self.raw("supplier"), key("S", "s_suppkey"), key("N", "s_nationkey"), "building"),
            edge(self.raw("orders"), key("O", "o_orderkey"), key("C", "o_custkey"), "product"),
            edge(self.lines(), F.col("guid"), key("O", "l_orderkey"), "product"),
        ]
        return reduce(DataFrame.unionByName, parts)

    def contained_in(self) -> DataFrame:
        storeys = self.raw("supplier").count()
        even = F.col("c_custkey") % 2 == 0
        return self.raw("customer").select(
            F.concat(F.lit("C"), _text("c_custkey")).alias("product_guid"),
            F.when(even, F.concat(F.lit("S"), _text(F.col("c_custkey") % storeys))).otherwise(F.concat(F.lit("N"), _text("c_nationkey"))).alias("container_guid"),
            F.when(even, "storey").otherwise("building").alias("container_kind"),
        )

    def voids(self) -> DataFrame:
        return self.lines().where("l_returnflag = 'N' AND l_linestatus = 'O'").select(F.col("guid").alias("opening_guid"), F.concat(F.lit("O"), _text("l_orderkey")).alias("host_guid"))

    def types(self) -> DataFrame:
        return self.raw("part").select(F.concat(F.lit("T"), _text("p_partkey")).alias("guid"), F.lit("IfcTypeProduct").alias("entity"), F.col("p_name").alias("name"), (F.col("p_partkey") + 4_000_000_000).alias("step_id"))

    def type_of(self) -> DataFrame:
        return self.lines().select("guid", F.concat(F.lit("T"), _text("l_partkey")).alias("type_guid"))

    def instance_psets(self) -> DataFrame:
        """Flags of line items; those with return flag A also state their own Grade."""
        flags = self.lines().select("guid", F.expr("stack(3, 'ReturnFlag', l_returnflag, 'IsExternal', IF(l_linestatus = 'O', 'True', 'False'), 'Grade', IF(l_returnflag = 'A', concat('own-', l_linestatus), NULL)) AS (prop_name, value)"))
        return flags.where("value IS NOT NULL").select("guid", F.lit("Pset_Common").alias("pset_name"), "prop_name", "value", F.lit("IfcLabel").alias("value_type"), F.lit("instance").alias("source"))

    def type_psets(self) -> DataFrame:
        rows = self.raw("part").select(F.concat(F.lit("T"), _text("p_partkey")).alias("guid"), F.expr("stack(3, 'Grade', p_type, 'Brand', p_brand, 'LoadBearing', IF(p_size > 25, 'True', 'False')) AS (prop_name, value)"))
        return rows.select("guid", F.lit("Pset_Common").alias("pset_name"), "prop_name", "value", F.lit("IfcLabel").alias("value_type"), F.lit("type").alias("source"))

    def instance_quantities(self) -> DataFrame:
        rows = self.lines().select("guid", F.expr("stack(3, 'Count', l_quantity, 'Area', l_extendedprice, 'Ratio', IF(l_discount > 0.05D, l_discount, NULL)) AS (quantity_name, value)"))
        return rows.where("value IS NOT NULL").select("guid", F.lit("Qto_Base").alias("qto_name"), "quantity_name", "value", F.when(F.col("quantity_name") == "Count", "Count").when(F.col("quantity_name") == "Area", "Area").otherwise("Length").alias("quantity_type"), F.when(F.col("quantity_name") == "Ratio", F.lit(7)).cast("long").alias("unit_step_id"), F.lit("instance").alias("source"))

    def type_quantities(self) -> DataFrame:
        rows = self.raw("part").select(F.concat(F.lit("T"), _text("p_partkey")).alias("guid"), F.expr("stack(2, 'Ratio', CAST(p_size AS DOUBLE) / 100, 'Price', p_retailprice) AS (quantity_name, value)"))
        return rows.select("guid", F.lit("Qto_Base").alias("qto_name"), "quantity_name", "value", F.when(F.col("quantity_name") == "Ratio", "Length").otherwise("Volume").alias("quantity_type"), F.lit(None).cast("long").alias("unit_step_id"), F.lit("type").alias("source"))


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


#: The canonical tables for DuckDB, as common table expressions to put before a query.
MODEL_SQL = f"""WITH RECURSIVE lines AS (
  SELECT *, concat('L', l_orderkey, '-', l_linenumber) AS guid FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_shipdate DESC) = 1
), products AS (
  SELECT concat('C', c_custkey) AS guid, CAST(c_custkey + 1000000000 AS BIGINT) AS step_id, {_case("c_mktsegment", SEGMENTS)} AS entity, c_name AS name, CAST(NULL AS VARCHAR) AS predefined_type, c_mktsegment AS object_type, CAST(c_custkey AS VARCHAR) AS tag, CAST(NULL AS VARCHAR) AS type_guid FROM customer
  UNION ALL SELECT concat('O', o_orderkey), CAST(o_orderkey + 2000000000 AS BIGINT), {_case("o_orderpriority", PRIORITIES)}, concat('Order ', o_orderkey), o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR), NULL FROM orders
  UNION ALL SELECT guid, CAST(l_orderkey * 10 + l_linenumber + 3000000000 AS BIGINT), {_case("l_returnflag || l_linestatus", FLAGS)}, concat('Line ', l_linenumber), l_linestatus, l_returnflag, CAST(l_suppkey AS VARCHAR), concat('T', l_partkey) FROM lines
), storeys AS (SELECT concat('S', s_suppkey) AS guid, s_name AS name, round(s_acctbal) AS elevation, concat('N', s_nationkey) AS building_guid FROM supplier
), aggregates AS (
  SELECT concat('R', r_regionkey) AS child_guid, 'P0' AS parent_guid, 'project' AS parent_kind FROM region
  UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey), 'site' FROM nation
  UNION ALL SELECT concat('S', s_suppkey), concat('N', s_nationkey), 'building' FROM supplier
  UNION ALL SELECT concat('O', o_orderkey), concat('C', o_custkey), 'product' FROM orders
  UNION ALL SELECT guid, concat('O', l_orderkey), 'product' FROM lines
), contained_in AS (
  SELECT concat('C', c_custkey) AS product_guid, CASE WHEN c_custkey % 2 = 0 THEN concat('S', c_custkey % (SELECT count(*) FROM supplier)) ELSE concat('N', c_nationkey) END AS container_guid, CASE WHEN c_custkey % 2 = 0 THEN 'storey' ELSE 'building' END AS container_kind FROM customer
), voids AS (SELECT guid AS opening_guid, concat('O', l_orderkey) AS host_guid FROM lines WHERE l_returnflag = 'N' AND l_linestatus = 'O'
), types AS (SELECT concat('T', p_partkey) AS guid, p_name AS name, CAST(p_partkey + 4000000000 AS BIGINT) AS step_id FROM part
), ups AS (
  SELECT child_guid AS child, parent_guid AS parent FROM aggregates UNION ALL SELECT product_guid, container_guid FROM contained_in
), instance_psets AS (
  SELECT guid, 'Pset_Common' AS pset_name, 'ReturnFlag' AS prop_name, l_returnflag AS value FROM lines
  UNION ALL SELECT guid, 'Pset_Common', 'IsExternal', CASE WHEN l_linestatus = 'O' THEN 'True' ELSE 'False' END FROM lines
  UNION ALL SELECT guid, 'Pset_Common', 'Grade', concat('own-', l_linestatus) FROM lines WHERE l_returnflag = 'A'
), type_psets AS (
  SELECT concat('T', p_partkey) AS guid, 'Pset_Common' AS pset_name, 'Grade' AS prop_name, p_type AS value FROM part
  UNION ALL SELECT concat('T', p_partkey), 'Pset_Common', 'Brand', p_brand FROM part
  UNION ALL SELECT concat('T', p_partkey), 'Pset_Common', 'LoadBearing', CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END FROM part
), psets AS (
  SELECT guid, pset_name, prop_name, value, 'instance' AS source FROM instance_psets
  UNION ALL SELECT l.guid, t.pset_name, t.prop_name, t.value, 'type' FROM lines l JOIN type_psets t ON t.guid = concat('T', l.l_partkey)
  WHERE NOT EXISTS (SELECT 1 FROM instance_psets i WHERE i.guid = l.guid AND i.pset_name = t.pset_name AND i.prop_name = t.prop_name)
), instance_quantities AS (
  SELECT guid, 'Qto_Base' AS qto_name, 'Count' AS quantity_name, l_quantity AS value, 'Count' AS quantity_type, CAST(NULL AS BIGINT) AS unit_step_id FROM lines
  UNION ALL SELECT guid, 'Qto_Base', 'Area', l_extendedprice, 'Area', NULL FROM lines
  UNION ALL SELECT guid, 'Qto_Base', 'Ratio', l_discount, 'Length', 7 FROM lines WHERE l_discount > 0.05
), type_quantities AS (
  SELECT concat('T', p_partkey) AS guid, 'Qto_Base' AS qto_name, 'Ratio' AS quantity_name, CAST(p_size AS DOUBLE) / 100 AS value, 'Length' AS quantity_type, CAST(NULL AS BIGINT) AS unit_step_id FROM part
  UNION ALL SELECT concat('T', p_partkey), 'Qto_Base', 'Price', p_retailprice, 'Volume', NULL FROM part
), quantities AS (
  SELECT guid, qto_name, quantity_name, value, quantity_type, unit_step_id, 'instance' AS source FROM instance_quantities
  UNION ALL SELECT l.guid, t.qto_name, t.quantity_name, t.value, t.quantity_type, t.unit_step_id, 'type' FROM lines l JOIN type_quantities t ON t.guid = concat('T', l.l_partkey)
  WHERE NOT EXISTS (SELECT 1 FROM instance_quantities i WHERE i.guid = l.guid AND i.qto_name = t.qto_name AND i.quantity_name = t.quantity_name)
)
"""
