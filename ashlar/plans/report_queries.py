"""Schema classes, floor rules, statistics and checks on the driver tables, with DuckDB SQL beside each query."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes
from ..operators import geometry, reports, rules
from ..operators.durable import shared_dir
from ..sources import step
from . import queries as q
from . import shape_model
from .star_model import MODEL_SQL, StarModel

# Entity, schema as a header may state it, and the mode it must have.
MODES = """
IfcWall IFC4 measure
IfcWallElementedCase IFC4 measure
IfcFlowSegment IFC2X3 linear
IfcConveyorSegment IFC4X3 linear
IfcKerb IFC4X3_ADD2 measure
IfcPavement ifc4x3 measure
IfcCourse IFC4X3_TC1 measure
IfcBuiltElement IFC4X3 measure
IfcBuildingElement IFC4_ADD2 measure
IfcKerb IFC4 skip
IfcBurner IFC4 count
IfcEngine IFC4 count
IfcValve IFC4 count
IfcDoor IFC2X3 count
IfcSpace IFC2X3 skip
IfcOpeningElement IFC4 skip
IfcPipeSegment IFC4 linear
IfcSensor IFC4 count
IfcNoSuchThing IFC4 skip
""".split("\n")[1:-1]
_MODES = [m.split() for m in MODES]


def q_mode_by_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of several schemas: how many have each mode."""
    part = StarModel(spark, sf_dir).raw("part").select((F.col("p_partkey") % len(_MODES)).cast("int").alias("i"))
    named = part.select(*[F.element_at(F.array(*[F.lit(m[k]) for m in _MODES]), F.col("i") + 1).alias(n) for k, n in ((0, "entity"), (1, "schema_name"))])
    schemas = sorted({m[1] for m in _MODES})
    mode = F.coalesce(*[F.when(F.col("schema_name") == s, classes.mode_column(F.col("entity"), s)) for s in schemas])
    return named.withColumn("mode", mode).groupBy("entity", "schema_name", "mode").agg(F.count("*").alias("n"))


def q_subtypes_by_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many classes lie below some classes in each schema, from the closure table."""
    heads = ("IfcWall", "IfcFlowSegment", "IfcDoor", "IfcDeepFoundation")
    return classes.closure(spark).where(F.col("ancestor").isin(*heads)).groupBy("schema", "ancestor").agg(F.count("*").alias("n")).withColumnRenamed("schema", "schema_name")


def _storeys(m: StarModel) -> DataFrame:
    return m.storeys().select(F.col("building_guid").alias("model_name"), F.col("name").alias("storey_name"), F.col("elevation").alias("elevation_mm"), F.col("guid").alias("storey_guid"))


def q_floors_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors labelled by a rule that is read from a project file, with an override for one storey's whole floor."""
    path = f"{shared_dir(spark)}/ashlar-rules/{uuid.uuid4().hex}.yaml"
    files, inner = step.store(path)
    files.create_dir(inner.rpartition("/")[0], recursive=True)
    with files.open_output_stream(inner) as f:
        f.write(b"prefix: 'C - '\noverrides:\n  Supplier#000000003: Roof\nidempotent_labels: [Roof]\napply_drop_leading_zero: false\n")
    return rules.federated_floors(_storeys(StarModel(spark, sf_dir)), 500.0, rules.rule_from_yaml(path)).select("model_name", "storey_guid", "cluster", "label")


def q_floors_own_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors labelled by a registered callable that sees each floor's members."""
    rules.register_rule("counted", lambda c: f"{len(c.names)} x {c.most_common_name}")
    return rules.federated_floors(_storeys(StarModel(spark, sf_dir)), 500.0, "counted").select("model_name", "storey_guid", "cluster", "label")


def q_tag_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance chains made of order fields: which hold a tag, how often, and which are stand-ins."""
    orders = StarModel(spark, sf_dir).raw("orders")
    chain = F.concat_ws("|", F.when(F.col("o_orderstatus") == "F", "boolean_cutter").otherwise("boolean_base"), F.when(F.col("o_orderkey") % 3 == 0, "halfspace_agree").otherwise("block"), F.when(F.col("o_orderkey") % 2 == 0, "block"))
    rows = orders.withColumn("chain", chain)
    return rows.select("o_orderkey", reports.chain_contains(F.col("chain"), "block").alias("has_block"), reports.chain_count(F.col("chain"), "block").alias("n_blocks"), reports.is_synthetic_cutter(F.col("chain")).alias("synthetic"))


def q_table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column types of the canonical tables under the names readers expect; no job runs."""
    m = StarModel(spark, sf_dir)
    rows = [(name, c, t) for name, t_ in (("storeys", m.storeys()), ("voids", m.voids()), ("type_quantities", m.type_quantities())) for c, t in t_.dtypes]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string").withColumn("kind", reports.dtype_name(F.col("kind")))


def q_global_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift of each nation's orders as placements: totals over 300000 lie beyond 10 km at a scale of 1/25."""
    orders = StarModel(spark, sf_dir).raw("orders")
    parts = [reports.global_shift(orders.where(f"o_orderkey % 4 = {k}").select(F.col("o_orderkey").alias("ord"), (F.col("o_totalprice") + 0.25).alias("x"), F.col("o_custkey").cast("double").alias("y"), F.lit(0.0).alias("z")), scale).withColumn("k", F.lit(k)) for k, scale in enumerate((0.04, 0.01, 1.0, 0.001))]
    return reduce(DataFrame.unionByName, parts).select("k", "x", "y", "z")


def _faulty(m: StarModel) -> DataFrame:
    """Meshes with a fault of each kind by vec_id."""
    v, i, k = F.col("vertices"), F.col("indices"), F.col("vec_id") % 6
    vertices = F.when(k == 1, F.slice(v, 1, 59)).when(k == 5, F.concat(F.slice(v, 1, 59), F.array(F.lit(float("nan"))))).otherwise(v)
    indices = F.when(k == 2, F.slice(i, 1, 53)).when(k == 3, F.array().cast("array<bigint>")).when(k == 4, F.concat(F.slice(i, 1, 53), F.array(F.lit(20).cast("bigint")))).otherwise(i)
    return q._meshes(m).select("guid", vertices.alias("vertices"), indices.alias("indices"))


def q_mesh_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mesh_errors(_faulty(StarModel(spark, sf_dir)))


def q_mesh_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of triangles are not coherent, closed boxes are."""
    m = StarModel(spark, sf_dir)
    corners, indices = geometry.box_mesh(1.0, 2.0, 3.0)
    boxes = m.raw("embeddings").select(F.concat(F.lit("K"), F.col("vec_id").cast("string")).alias("guid"), F.array(*map(F.lit, corners)).alias("vertices"), F.array(*[F.lit(i).cast("bigint") for i in indices]).alias("indices"))
    return reports.coherent(geometry.triangles(q._meshes(m).drop("vec_id").union(boxes)))


def _stats(m: StarModel) -> DataFrame:
    meshes = q._meshes(m).withColumn("entity", F.element_at(F.array(*map(F.lit, q._CLASSES)), (F.col("vec_id") % 10 + 1).cast("int")))
    return reports.product_stats(meshes.drop("vec_id"))


def q_entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.entity_stats(_stats(StarModel(spark, sf_dir)))


def q_top_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top(_stats(StarModel(spark, sf_dir)), "area", 20).select("guid", F.round("area", 4).alias("area"))


def q_stats_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics written as CSV and read again as text."""
    path = f"{shared_dir(spark)}/ashlar-csv/{uuid.uuid4().hex}"
    reports.write_csv(_stats(StarModel(spark, sf_dir)).select("guid", "entity", "triangle_count", "area"), path)
    return spark.read.option("header", True).csv(path)


def q_area_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cumulative share of area at each triangle of each mesh."""
    return reports.ladder(geometry.triangles(q._meshes(StarModel(spark, sf_dir)))).select("guid", F.col("tri").cast("int").alias("tri"), F.round("upto", 6).alias("upto"))


def q_semantic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = StarModel(spark, sf_dir).staged()
    return reports.semantic_stats({"psets": q._psets(m), "quantities": q._quantities(m), "materials": q._materials(m)})


def q_clash_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a clash run; every tenth box has no geometry."""
    boxes, meshes = q._box_meshes(StarModel(spark, sf_dir))
    bare = F.col("id") % 10 == 7
    return reports.clash_report(boxes.withColumn("min_x", F.when(~bare, F.col("min_x"))), meshes, 0.02)


def q_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each kind of customer product with its orders as facts: products, length of the array, first guid."""
    m = StarModel(spark, sf_dir)
    products = m.raw("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("guid"), F.col("c_mktsegment").alias("segment"))
    orders = m.raw("orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("guid"), "o_orderkey", "o_orderstatus")
    made = reports.sidecars(products, {"orders": orders}, "segment")
    found = F.from_json("json", "array<struct<guid:string,orders:array<struct<o_orderkey:bigint,o_orderstatus:string>>>>")
    return made.select("segment", "n", F.size(found).cast("long").alias("n_json"), found[0]["guid"].alias("first_guid"), F.aggregate(found, F.lit(0).cast("long"), lambda a, p: a + F.size(p["orders"])).alias("n_orders"))


def q_shape_point_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meshes of requested products only, in feet and with the model's own options: their boxes in the product's frame."""
    t = shape_model.tables(spark, sf_dir)
    from ..operators import meshes

    wanted = ["B" + str(k).zfill(21) for k in range(0, 40, 2)]
    made = meshes.product_meshes(t, "local", guids=wanted).where("source = 'block' OR source = 'brep'")
    return geometry.bounds(meshes.scaled(made, 1 / 0.3048)).select("guid", F.round("max_x", 4).alias("max_x"), F.round("max_z", 4).alias("max_z"))


_PICK = "list_extract([" + ", ".join(f"'{m[0]} {m[1]} {m[2]}'" for m in _MODES) + f"], CAST(p_partkey % {len(_MODES)} AS INTEGER) + 1)"
_FAULTS = "list_extract([NULL, 'vertices_not_in_threes', 'indices_not_in_threes', 'no_triangles', 'index_out_of_range', 'not_finite'], CAST(vec_id % 6 AS INTEGER) + 1)"
_ENTITY = "list_extract([" + ", ".join(f"'{c}'" for c in q._CLASSES) + "], CAST(CAST(substr(guid, 2) AS BIGINT) % 10 AS INTEGER) + 1)"
_FORM = lambda *names: ", ".join(str(shape_model.FORMS.index(n)) for n in names)
QUERIES = {f.__name__: f for f in (
    q_mode_by_schema, q_subtypes_by_schema, q_floors_from_file, q_floors_own_rule, q_tag_chains, q_table_types, q_global_shift, q_mesh_errors, q_mesh_coherence, q_entity_stats, q_top_area, q_stats_csv, q_area_ladder, q_semantic_stats, q_clash_report, q_sidecars, q_shape_point_scan,
)}
SQL = {
    "q_mode_by_schema": f"SELECT split_part(x, ' ', 1) AS entity, split_part(x, ' ', 2) AS schema_name, split_part(x, ' ', 3) AS mode, count(*) AS n FROM (SELECT {_PICK} AS x FROM part) GROUP BY ALL",
    "q_subtypes_by_schema": "SELECT * FROM (VALUES ('IFC4', 'IfcWall', 3::BIGINT), ('IFC4X3', 'IfcWall', 3), ('IFC2X3', 'IfcWall', 2), ('IFC4', 'IfcFlowSegment', 5), ('IFC4X3', 'IfcFlowSegment', 6), ('IFC2X3', 'IfcFlowSegment', 1), ('IFC4', 'IfcDoor', 2), ('IFC4X3', 'IfcDoor', 2), ('IFC2X3', 'IfcDoor', 1), ('IFC4X3', 'IfcDeepFoundation', 3)) t(schema_name, ancestor, n)",
    "q_floors_from_file": MODEL_SQL + q._FLOOR_SQL + ", best AS (SELECT model_name, cluster, arg_min(storey_name, k) AS name, bool_or(storey_name = 'Supplier#000000003') AS roof FROM f GROUP BY ALL) SELECT model_name, storey_guid, CAST(cluster AS INTEGER) AS cluster, CASE WHEN roof THEN 'Roof' ELSE concat('C - ', name) END AS label FROM f JOIN best USING (model_name, cluster)",
    "q_floors_own_rule": MODEL_SQL + q._FLOOR_SQL + ", best AS (SELECT model_name, cluster, arg_min(storey_name, k) AS name, count(*) AS c FROM f GROUP BY ALL) SELECT model_name, storey_guid, CAST(cluster AS INTEGER) AS cluster, concat(c, ' x ', name) AS label FROM f JOIN best USING (model_name, cluster)",
    "q_tag_chains": "SELECT o_orderkey, o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 AS has_block, CAST((CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_blocks, o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS synthetic FROM orders",
    "q_table_types": "SELECT * FROM (VALUES ('storeys', 'guid', 'str'), ('storeys', 'name', 'str'), ('storeys', 'elevation', 'float'), ('storeys', 'building_guid', 'str'), ('voids', 'opening_guid', 'str'), ('voids', 'host_guid', 'str'), ('type_quantities', 'guid', 'str'), ('type_quantities', 'qto_name', 'str'), ('type_quantities', 'quantity_name', 'str'), ('type_quantities', 'value', 'float'), ('type_quantities', 'quantity_type', 'str'), ('type_quantities', 'unit_step_id', 'int'), ('type_quantities', 'source', 'str')) t(table_name, column_name, kind)",
    "q_global_shift": "SELECT CAST(k AS INTEGER) AS k, CASE WHEN far THEN round(x) ELSE 0 END AS x, CASE WHEN far THEN y ELSE 0 END AS y, CAST(0 AS DOUBLE) AS z FROM (SELECT o_orderkey % 4 AS k, max(greatest(o_totalprice + 0.25, o_custkey)) * list_extract([0.04, 0.01, 1.0, 0.001], CAST(o_orderkey % 4 AS INTEGER) + 1) > 10000 AS far, arg_min(o_totalprice + 0.25, o_orderkey) AS x, CAST(arg_min(o_custkey, o_orderkey) AS DOUBLE) AS y FROM orders GROUP BY o_orderkey % 4)",
    "q_mesh_errors": f"SELECT guid, error FROM (SELECT concat('M', vec_id) AS guid, {_FAULTS} AS error FROM embeddings) WHERE error IS NOT NULL",
    "q_mesh_coherence": "SELECT concat('M', vec_id) AS guid, false AS coherent FROM embeddings UNION ALL SELECT concat('K', vec_id), true FROM embeddings",
    "q_entity_stats": f"SELECT {_ENTITY} AS entity, count(*) AS products, CAST(18 * count(*) AS BIGINT) AS triangles FROM (SELECT concat('M', vec_id) AS guid FROM embeddings) GROUP BY ALL",
    "q_top_area": q._TRIS_SQL + "SELECT guid, round(area, 4) AS area FROM (SELECT guid, sum(mag / 2) AS area FROM tri GROUP BY guid ORDER BY area DESC, guid LIMIT 20)",
    "q_stats_csv": q._TRIS_SQL + f"SELECT guid, {_ENTITY} AS entity, '18' AS triangle_count, format('{{:.3f}}', sum(mag / 2)) AS area FROM tri GROUP BY guid",
    "q_area_ladder": q._TRIS_SQL + "SELECT guid, CAST(t AS INTEGER) AS tri, round(sum(mag) OVER (PARTITION BY guid ORDER BY t) / sum(mag) OVER (PARTITION BY guid), 6) AS upto FROM tri",
    "q_semantic_stats": MODEL_SQL + q._MATERIALS_SQL + "SELECT 'psets' AS name, count(*) AS n FROM psets UNION ALL SELECT 'quantities', count(*) FROM quantities UNION ALL SELECT 'materials', count(*) FROM materials",
    "q_clash_report": q._BOX_SQL.replace("TOL", "0.02").replace("FROM embeddings", "FROM embeddings WHERE vec_id % 10 <> 7") + f""", m AS (SELECT id_a, id_b, ca, cb, {q._APART_SQL} FROM pairs JOIN b a ON a.id = id_a JOIN b ON b.id = id_b), d AS (
  SELECT *, CASE WHEN greatest(gx, gy, gz) > 0 THEN sqrt(power(greatest(gx, 0), 2) + power(greatest(gy, 0), 2) + power(greatest(gz, 0), 2)) ELSE greatest(0, least(inax, inay, inaz), least(inbx, inby, inbz)) END AS distance FROM m)
SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 7) AS geometryless_skipped, count(*) AS box_pairs, count(*) FILTER (WHERE distance = 0) AS hard, count(*) FILTER (WHERE distance > 0 AND distance <= 0.02) AS clearance, count(*) FILTER (WHERE distance > 0.02) AS narrow_phase_residuals FROM d""",
    "q_sidecars": "SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS n, count(DISTINCT c_custkey) AS n_json, min(concat('C', c_custkey)) AS first_guid, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "q_shape_point_scan": shape_model._PARTS + f"SELECT guid, round(k * a / 0.3048, 4) AS max_x, round(k * 3 / 0.3048, 4) AS max_z FROM (SELECT *, CASE form WHEN {_FORM('mapped')} THEN 2.0 ELSE 1.0 END AS k FROM p WHERE p_partkey < 40 AND p_partkey % 2 = 0 AND form IN ({_FORM('block', 'mapped', 'brep')}))",
}
