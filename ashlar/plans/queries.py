"""The engine's operators applied to the driver tables, one query each, with DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classes
from ..functions import step_text as step
from ..functions import units
from ..operators import clash, facts, geometry, graph, summaries
from .star_model import MODEL_SQL, StarModel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, model: bool = True) -> Callable[[Callable], Callable]:
    """Registers a function of a StarModel under its name, with its SQL."""

    def register(f: Callable[[StarModel], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(StarModel(spark, sf_dir))
        if sql:
            SQL[f.__name__] = (MODEL_SQL if model else "") + sql
        return f

    return register


MODES = {e: classes.mode_of(e) for e in ("IfcWall IfcSlab IfcFurniture IfcDoor IfcPipeSegment IfcWallStandardCase IfcBeam IfcSpace IfcBuildingElementProxy IfcElementAssembly IfcPipeFitting IfcDuctFitting IfcCovering IfcOpeningElement IfcPlate IfcSensor").split()}
_MODE = "CASE entity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODES.items()) + " ELSE 'skip' END"


# --- counts, filters, look-ups


@query("SELECT entity, count(*) AS n FROM products GROUP BY entity")
def q_entity_counts(m: StarModel) -> DataFrame:
    return summaries.entity_counts(m.products())


@query("""SELECT p.entity, n, predefined_types, object_types, sample_guids FROM (
  SELECT entity, count(*) AS n, coalesce(array_to_string(list_sort(list(DISTINCT predefined_type) FILTER (WHERE predefined_type IS NOT NULL)), '|'), '') AS predefined_types, coalesce(array_to_string(list_sort(list(DISTINCT object_type)), '|'), '') AS object_types FROM products GROUP BY entity) p
JOIN (SELECT entity, string_agg(guid, '|' ORDER BY step_id, guid) AS sample_guids FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY step_id, guid) AS k FROM products) WHERE k <= 3 GROUP BY entity) s ON s.entity = p.entity""")
def q_type_summary(m: StarModel) -> DataFrame:
    return summaries.type_summary(m.products())


def _materials(m: StarModel) -> DataFrame:
    part = m.raw("part").select(F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("container"), F.split("p_name", " ").alias("words"), (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 4).alias("k"), "p_size")
    direct = part.where("k = 0").select("container", F.col("words")[0].alias("material_name"))
    members = part.where("k IN (1, 2)").select("container", F.when(F.col("k") == 1, "list").otherwise("layer").alias("role"), F.when(F.col("k") == 2, F.col("p_size").cast("double")).alias("thickness_mm"), F.posexplode("words").alias("layer_index", "material_name"))
    used = m.lines().select("guid", F.concat(F.lit("M"), F.col("l_partkey").cast("string")).alias("container"))
    return facts.materials(used, direct, members)


_MATERIALS_SQL = """, part_words AS (SELECT concat('M', p_partkey) AS container, string_split(p_name, ' ') AS words, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 4 AS k, p_size FROM part
), container_rows AS (
  SELECT container, 'direct' AS role, -1 AS layer_index, words[1] AS material_name, CAST(NULL AS DOUBLE) AS thickness FROM part_words WHERE k = 0
  UNION ALL SELECT container, CASE k WHEN 1 THEN 'list' ELSE 'layer' END, i - 1, words[i], CASE k WHEN 2 THEN CAST(p_size AS DOUBLE) END FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM part_words WHERE k IN (1, 2))
), materials AS (
  SELECT guid, coalesce(role, 'unknown') AS role, CAST(coalesce(layer_index, -1) AS INTEGER) AS layer_index, material_name, thickness AS layer_thickness_mm FROM lines LEFT JOIN container_rows ON container = concat('M', l_partkey)
)
"""


@query(_MATERIALS_SQL + "SELECT * FROM materials")
def q_materials_resolved(m: StarModel) -> DataFrame:
    return _materials(m)


def _class_links(m: StarModel) -> DataFrame:
    part = m.raw("part").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("B:"), "p_brand").alias("next"))
    brand = m.raw("part").groupBy("p_brand").agg(F.min("p_type").alias("t")).select(F.concat(F.lit("B:"), "p_brand").alias("id"), F.concat(F.lit("Y:"), "t").alias("next"))
    kind = m.raw("part").select("p_type").distinct().select(F.concat(F.lit("Y:"), "p_type").alias("id"), F.when(F.col("p_type") == "LARGE", F.concat(F.lit("Y:"), "p_type")).otherwise(F.lit("ROOT")).alias("next"))
    return part.union(brand).union(kind)


_CLASS_SQL = """, links AS (
  SELECT concat('T', p_partkey) AS id, concat('B:', p_brand) AS next FROM part
  UNION ALL SELECT concat('B:', p_brand), concat('Y:', min(p_type)) FROM part GROUP BY p_brand
  UNION ALL SELECT DISTINCT concat('Y:', p_type), CASE p_type WHEN 'LARGE' THEN concat('Y:', p_type) ELSE 'ROOT' END FROM part
), walk AS (
  SELECT id, next, 1 AS depth FROM links UNION ALL SELECT w.id, l.next, w.depth + 1 FROM walk w JOIN links l ON l.id = w.next WHERE w.depth < 32 AND w.next <> 'ROOT'
), chains AS (SELECT l.id, w.next AS end_id, w.depth FROM (SELECT DISTINCT id FROM links) l LEFT JOIN walk w ON w.id = l.id AND w.next = 'ROOT')
"""


@query(_CLASS_SQL + "SELECT id, end_id, depth FROM chains")
def q_classification_chain(m: StarModel) -> DataFrame:
    return graph.chain_end(_class_links(m), m.spark.sql("SELECT 'ROOT' AS id"))


@query(_MATERIALS_SQL + """, bank AS (SELECT entity, count(*) AS n FROM products GROUP BY entity)
SELECT b.entity, b.n, coalesce(mt.materials, '') AS materials, coalesce(c.classifications, '') AS classifications FROM bank b
LEFT JOIN (SELECT entity, array_to_string(list_sort(list(DISTINCT material_name)), '|') AS materials FROM materials JOIN products USING (guid) WHERE material_name IS NOT NULL GROUP BY entity) mt USING (entity)
LEFT JOIN (SELECT entity, array_to_string(list_sort(list(DISTINCT concat('brand:', p_brand))), '|') AS classifications FROM lines l JOIN products p USING (guid) JOIN part ON p_partkey = l_partkey GROUP BY entity) c USING (entity)""")
def q_type_bank(m: StarModel) -> DataFrame:
    brands = m.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.lit("brand").alias("system_name"), F.col("p_brand").alias("identification"))
    classifications = m.lines().select("guid", "l_partkey").join(brands, "l_partkey").drop("l_partkey")
    return summaries.type_bank(m.products(), _materials(m), classifications)


@query(f"SELECT {_MODE} AS mode, entity, count(*) AS n FROM products WHERE {_MODE} <> 'skip' GROUP BY ALL")
def q_filter_mode(m: StarModel) -> DataFrame:
    return m.products().withColumn("mode", classes.mode_column(F.col("entity"))).where("mode <> 'skip'").groupBy("mode", "entity").agg(F.count("*").alias("n"))


@query("SELECT guid, entity, name FROM products WHERE entity IN (" + ", ".join(f"'{s}'" for s in ("IfcWall", "IfcWallStandardCase", "IfcWallElementedCase")) + ")")
def q_by_type_subtypes(m: StarModel) -> DataFrame:
    return m.products().where(F.col("entity").isin(*classes.subtypes("ifcwall"))).select("guid", "entity", "name")


@query("SELECT guid, entity, name, object_type FROM products WHERE guid = 'O17'")
def q_point_lookup(m: StarModel) -> DataFrame:
    return m.products().where("guid = 'O17'").orderBy("step_id").limit(1).select("guid", "entity", "name", "object_type")


_WALK = """, hops AS (
  SELECT coalesce(c.product_guid, a.child_guid) AS guid, coalesce(c.container_guid, a.parent_guid) AS hop FROM aggregates a FULL JOIN contained_in c ON c.product_guid = a.child_guid
), walk AS (SELECT guid, guid AS at, 0 AS depth FROM products UNION ALL SELECT w.guid, h.hop, w.depth + 1 FROM walk w JOIN hops h ON h.guid = w.at WHERE w.depth < 16
), found AS (SELECT w.guid, arg_min(w.at, w.depth) AS storey_guid FROM walk w WHERE w.at IN (SELECT guid FROM storeys) GROUP BY w.guid
), product_storey AS (SELECT p.guid, f.storey_guid FROM products p LEFT JOIN found f USING (guid))
"""


def _storey_of(m: StarModel) -> DataFrame:
    return graph.storey_of(m.products(), m.aggregates(), m.contained_in(), m.storeys())


@query(_WALK + "SELECT guid, storey_guid FROM product_storey")
def q_storey_of(m: StarModel) -> DataFrame:
    m.staged()
    return _storey_of(m)


@query("""SELECT guid, coalesce(c.container_guid, a.parent_guid) AS above FROM products p LEFT JOIN aggregates a ON a.child_guid = p.guid LEFT JOIN contained_in c ON c.product_guid = p.guid""")
def q_parent(m: StarModel) -> DataFrame:
    up = graph.parents(m.aggregates(), m.contained_in()).withColumnRenamed("parent_guid", "above")
    return m.products().select("guid").join(up, "guid", "left")


@query("SELECT parent_guid, child_guid, via FROM (SELECT container_guid AS parent_guid, product_guid AS child_guid, 'contained' AS via FROM contained_in UNION ALL SELECT parent_guid, child_guid, 'aggregated' FROM aggregates)")
def q_children(m: StarModel) -> DataFrame:
    return graph.children(m.aggregates(), m.contained_in())


_REACH = ", reach AS (SELECT child, parent, 1 AS depth FROM ups UNION ALL SELECT r.child, u.parent, r.depth + 1 FROM reach r JOIN ups u ON u.child = r.parent)\n"


@query(_REACH + "SELECT child AS guid, parent AS ancestor_guid, CAST(depth AS INTEGER) AS depth FROM reach")
def q_ancestors(m: StarModel) -> DataFrame:
    m.staged_keys()
    return graph.ancestors(graph.parents(m.aggregates(), m.contained_in()))


@query(_REACH + "SELECT parent AS guid, child AS descendant_guid, CAST(depth AS INTEGER) AS depth FROM reach")
def q_descendants(m: StarModel) -> DataFrame:
    m.staged_keys()
    return graph.descendants(graph.children(m.aggregates(), m.contained_in()))


@query(_REACH + "SELECT parent AS guid, count(*) AS n, CAST(max(depth) AS INTEGER) AS deepest FROM reach WHERE child IN (SELECT guid FROM products) GROUP BY parent")
def q_products_in(m: StarModel) -> DataFrame:
    m.staged_keys()
    down = graph.descendants(graph.children(m.aggregates(), m.contained_in()), m.product_guids())
    return down.groupBy("guid").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query(_REACH + "SELECT p.guid, f.building_guid FROM products p LEFT JOIN (SELECT child, arg_min(parent, depth) AS building_guid FROM reach WHERE parent LIKE 'N%' GROUP BY child) f ON f.child = p.guid")
def q_building_of(m: StarModel) -> DataFrame:
    m.staged()
    buildings = m.raw("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("guid"))
    return graph.building_of(m.products(), m.aggregates(), m.contained_in(), m.storey_building(), buildings)


@query(_WALK + f"""SELECT p.guid, p.entity, p.name, {_MODE.replace("entity", "p.entity", 1)} AS mode, ps.storey_guid, s.name AS storey_name, p.type_guid, t.name AS type_name,
  CASE WHEN t.guid IS NOT NULL THEN 'ifctype' WHEN p.object_type IS NOT NULL THEN 'objecttype' ELSE 'none' END AS type_source
FROM products p JOIN product_storey ps ON ps.guid = p.guid LEFT JOIN storeys s ON s.guid = ps.storey_guid LEFT JOIN types t ON t.guid = p.type_guid""")
def q_products_denorm(m: StarModel) -> DataFrame:
    m.staged("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    named = m.storeys().select(F.col("guid").alias("storey_guid"), F.col("name").alias("storey_name"))
    whole = _linked(m).join(_storey_of(m), "guid").join(named, "storey_guid", "left")
    return whole.select("guid", "entity", "name", classes.mode_column(F.col("entity")).alias("mode"), "storey_guid", "storey_name", "type_guid", "type_name", "type_source")


def _linked(m: StarModel) -> DataFrame:
    types = m.types().select(F.col("guid").alias("type_guid"), F.col("name").alias("type_name"), F.lit(True).alias("has"))
    source = F.when(F.col("has"), "ifctype").when(F.col("object_type").isNotNull(), "objecttype").otherwise("none")
    return m.products().join(types, "type_guid", "left").withColumn("type_source", source).drop("has")


@query("""SELECT p.guid, p.type_guid, coalesce(t.name, p.object_type) AS type_name, CASE WHEN t.guid IS NOT NULL THEN 'ifctype' WHEN p.object_type IS NOT NULL THEN 'objecttype' ELSE 'none' END AS type_source FROM products p LEFT JOIN types t ON t.guid = p.type_guid""")
def q_type_linkage(m: StarModel) -> DataFrame:
    return _linked(m).select("guid", "type_guid", F.coalesce("type_name", "object_type").alias("type_name"), "type_source")


@query(_WALK + "SELECT p.guid, p.step_id, p.name, ps.storey_guid, s.name AS storey_name FROM products p JOIN product_storey ps ON ps.guid = p.guid LEFT JOIN storeys s ON s.guid = ps.storey_guid WHERE p.entity = 'IfcSpace'")
def q_spaces_enriched(m: StarModel) -> DataFrame:
    m.staged()
    spaces = m.products().where("entity = 'IfcSpace'")
    found = graph.storey_of(spaces, m.aggregates(), m.contained_in(), m.storeys())
    named = m.storeys().select(F.col("guid").alias("storey_guid"), F.col("name").alias("storey_name"))
    return spaces.join(found, "guid").join(named, "storey_guid", "left").select("guid", "step_id", "name", "storey_guid", "storey_name")


@query("SELECT child_guid, parent_guid, parent_kind FROM aggregates")
def q_aggregates_edges(m: StarModel) -> DataFrame:
    return m.aggregates()


@query("SELECT product_guid, container_guid, container_kind FROM contained_in")
def q_contained_in(m: StarModel) -> DataFrame:
    return m.contained_in()


@query("SELECT guid AS storey_guid, building_guid FROM storeys")
def q_storey_building(m: StarModel) -> DataFrame:
    return m.storey_building()


@query("""SELECT concat('L', l_orderkey, '-', l_linenumber) AS opening_guid, concat('O', l_orderkey) AS host_guid FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_shipdate DESC) AS k FROM lineitem)
WHERE k = 1 AND l_returnflag = 'N' AND l_linestatus = 'O' AND l_orderkey IN (SELECT o_orderkey FROM orders)""", model=False)
def q_voids(m: StarModel) -> DataFrame:
    known = m.products().select("guid")
    return m.voids().join(known.withColumnRenamed("guid", "opening_guid"), "opening_guid", "left_semi").join(known.withColumnRenamed("guid", "host_guid"), "host_guid", "left_semi").select("opening_guid", "host_guid")


# --- facts

_PSET_KEYS, _QTO_KEYS = ["pset_name", "prop_name"], ["qto_name", "quantity_name"]


def _psets(m: StarModel) -> DataFrame:
    return facts.inherited(m.instance_psets(), m.type_psets(), m.type_of(), _PSET_KEYS)


def _quantities(m: StarModel) -> DataFrame:
    return facts.inherited(m.instance_quantities(), m.type_quantities(), m.type_of(), _QTO_KEYS)


@query("SELECT guid, pset_name, prop_name, value, source FROM psets")
def q_psets_effective(m: StarModel) -> DataFrame:
    return _psets(m).drop("value_type")


@query("SELECT guid, quantity_name, value, quantity_type, source FROM quantities")
def q_quantities_effective(m: StarModel) -> DataFrame:
    return _quantities(m).select("guid", "quantity_name", "value", "quantity_type", "source")


@query("SELECT quantity_type, coalesce(unit_step_id, CASE quantity_type WHEN 'Length' THEN 1 WHEN 'Area' THEN 2 WHEN 'Volume' THEN 3 END) AS unit_step_id, count(*) AS n FROM quantities GROUP BY ALL")
def q_unit_fallback(m: StarModel) -> DataFrame:
    units = m.spark.sql("SELECT * FROM VALUES ('Length', 1L), ('Area', 2L), ('Volume', 3L) AS t(quantity_type, project_unit)")
    return facts.unit_fallback(_quantities(m), units).groupBy("quantity_type", "unit_step_id").agg(F.count("*").alias("n"))


_FILTER_SQL = _WALK + """SELECT storey_guid, count(*) AS n FROM products p JOIN product_storey ps USING (guid)
WHERE p.guid IN (SELECT guid FROM psets WHERE prop_name = 'IsExternal' AND value = 'True') AND p.guid IN (SELECT guid FROM psets WHERE prop_name = 'LoadBearing' AND value = 'True') GROUP BY storey_guid"""


@query(_FILTER_SQL)
def q_pset_filter_by_storey(m: StarModel) -> DataFrame:
    m.staged()
    wanted = [("Pset_Common", "IsExternal", "True"), ("Pset_Common", "LoadBearing", "True")]
    hits = m.products()
    return facts.storey_counts(_psets(m), wanted, hits, _storey_of(m))


@query("""SELECT * FROM (SELECT guid, pset_name, prop_name, value, source FROM psets WHERE prop_name = 'Grade' ORDER BY guid, pset_name, prop_name, value, source LIMIT 200)""")
def q_pset_lookup(m: StarModel) -> DataFrame:
    return facts.filter_facts(_psets(m).drop("value_type"), prop_name="Grade", limit=200)


@query("""SELECT concat('R', r_regionkey) AS root, concat(r_name, '.', n_name, '.', s_name) AS path, CAST(s_suppkey AS VARCHAR) AS value FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""", model=False)
def q_complex_flatten(m: StarModel) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    null = F.lit(None).cast("string")
    nodes = m.raw("region").select(key("R", "r_regionkey").alias("id"), null.alias("parent"), F.col("r_name").alias("name"), null.alias("value"))
    nodes = nodes.union(m.raw("nation").select(key("N", "n_nationkey"), key("R", "n_regionkey"), "n_name", null))
    nodes = nodes.union(m.raw("supplier").select(key("S", "s_suppkey"), key("N", "s_nationkey"), "s_name", F.col("s_suppkey").cast("string")))
    return graph.flatten(nodes)


# --- STEP text


def _records(m: StarModel) -> DataFrame:
    """The products as STEP record bodies, made in SQL."""
    text = lambda c: F.concat(F.lit("'"), F.replace(F.coalesce(c, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))
    body = F.concat_ws(",", text(F.col("guid")), F.lit("$"), text(F.concat("name", F.lit("'s, (a;b)"))), F.lit("$"), text(F.col("object_type")), F.concat(F.lit("(#"), F.col("step_id").cast("string"), F.lit(",#2)")), F.lit("1.5"), F.concat(F.lit("."), F.coalesce("predefined_type", F.lit("NOTDEFINED")), F.lit(".")), F.lit("$"))
    return m.products().select("step_id", F.upper("entity").alias("type"), body.alias("args"))


@query("SELECT step_id, entity, guid, concat(name, '''s, (a;b)') AS name, coalesce(object_type, '') AS object_type, coalesce(predefined_type, 'NOTDEFINED') AS predefined_type, CAST(9 AS INTEGER) AS n_fields FROM products")
def q_step_parse(m: StarModel) -> DataFrame:
    rows = _records(m).withColumn("f", step.split_fields("args"))
    return rows.select("step_id", classes.canonical(F.col("type")).alias("entity"), step.string(F.col("f")[0]).alias("guid"), step.string(F.col("f")[2]).alias("name"), step.string(F.col("f")[4]).alias("object_type"), step.last_enum(F.col("f")).alias("predefined_type"), F.size("f").alias("n_fields"))


@query("SELECT step_id, step_id AS first_ref, CAST(2 AS INTEGER) AS n_refs FROM products")
def q_step_refs(m: StarModel) -> DataFrame:
    return _records(m).withColumn("r", step.all_refs(F.col("args"))).select("step_id", F.col("r")[0].alias("first_ref"), F.size("r").alias("n_refs"))


@query("SELECT doc_id, md5(replace(text, 'e', '''') || '\\') AS digest, length(text) + 1 AS n FROM documents", model=False)
def q_step_decode(m: StarModel) -> DataFrame:
    source = F.concat(F.replace("text", F.lit("e"), F.lit("'")), F.lit("\\"))
    coded = F.replace(F.replace(F.replace(source, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("é"), F.lit("\\X2\\00E9\\X0\\"))
    decoded = step.decode_string(F.replace(coded, F.lit("ü"), F.lit("\\X\\FC")))
    return m.raw("documents").select("doc_id", F.md5(decoded.cast("binary")).alias("digest"), F.char_length(decoded).cast("long").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS quantity,
  concat(CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) ELSE CAST(l_extendedprice AS VARCHAR) END, '..@', l_returnflag) AS bounded, concat(l_returnflag, ', ', l_linestatus) AS joined, concat(l_returnflag, '=>', l_linestatus) AS tabled FROM lines""")
def q_value_format(m: StarModel) -> DataFrame:
    null = F.lit(None).cast("string")
    return m.lines().select(
        "l_orderkey", "l_linenumber", facts.format_number(F.col("l_quantity")).alias("quantity"), facts.format_bounded(facts.format_number(F.col("l_extendedprice")), null, F.col("l_returnflag")).alias("bounded"),
        facts.join_values(F.array(F.col("l_returnflag"), null, F.col("l_linestatus"))).alias("joined"), facts.join_table(F.array(F.col("l_returnflag")), F.array(F.col("l_linestatus"), null)).alias("tabled"),
    )


@query("""SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 0.01 WHEN 2 THEN 1000.0 ELSE 1.0 END AS DOUBLE) * p_size AS metres FROM part""", model=False)
def q_unit_scale(m: StarModel) -> DataFrame:
    prefix = F.element_at(F.array(F.lit("MILLI"), F.lit("CENTI"), F.lit("KILO"), F.lit(None)), (F.col("p_size") % 4 + 1).cast("int"))
    table = F.create_map(*[x for p in ("MILLI", "CENTI", "KILO") for x in (F.lit(p), F.lit(units.length_scale(p)))])
    return m.raw("part").select("p_partkey", (F.coalesce(F.element_at(table, F.coalesce(prefix, F.lit("NONE"))), F.lit(1.0)) * F.col("p_size")).alias("metres"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS predefined_type FROM orders", model=False)
def q_predefined_type(m: StarModel) -> DataFrame:
    fields = F.array(F.lit("'g'"), F.concat(F.lit("."), F.col("o_orderstatus"), F.lit(".")), F.when(F.col("o_orderstatus") == "P", "#1").otherwise("$"), F.lit("*"))
    return m.raw("orders").select("o_orderkey", step.last_enum(fields).alias("predefined_type"))


@query("SELECT s_suppkey, s_acctbal AS elevation FROM supplier", model=False)
def q_elevation_pick(m: StarModel) -> DataFrame:
    fields = F.array(F.lit("'g'"), F.lit("7."), F.col("s_acctbal").cast("string"), F.lit(".ELEMENT."), F.lit("$"))
    return m.raw("supplier").select("s_suppkey", step.last_number(fields).alias("elevation"))


# --- geometry


def _meshes(m: StarModel) -> DataFrame:
    vertices = F.transform(F.slice("embedding", 1, 60), lambda x: x.cast("double"))
    indices = F.array(*[F.lit(i + k).cast("bigint") for i in range(18) for k in range(3)])
    return m.raw("embeddings").select(F.concat(F.lit("M"), F.col("vec_id").cast("string")).alias("guid"), "vec_id", vertices.alias("vertices"), indices.alias("indices"))


_TRIS_SQL = """WITH e AS (SELECT vec_id, concat('M', vec_id) AS guid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), c AS (SELECT guid, v, unnest(range(0, 18)) AS t FROM e
), k AS (SELECT guid, t, v[3*t+1] - v[1] AS ax, v[3*t+2] - v[2] AS ay, v[3*t+3] - v[3] AS az, v[3*t+4] - v[1] AS bx, v[3*t+5] - v[2] AS by_, v[3*t+6] - v[3] AS bz, v[3*t+7] - v[1] AS cx, v[3*t+8] - v[2] AS cy, v[3*t+9] - v[3] AS cz FROM c
), n AS (SELECT *, (by_-ay)*(cz-az) - (bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) AS nz FROM k
), tri AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS mag FROM n)
"""


@query(_TRIS_SQL + "SELECT guid, count(*) AS triangle_count, round(sum((ax*(by_*cz - bz*cy) + ay*(bz*cx - bx*cz) + az*(bx*cy - by_*cx)) / 6), 4) + 0.0 AS volume, round(sum(mag / 2), 4) AS area FROM tri GROUP BY guid", model=False)
def q_mesh_qto(m: StarModel) -> DataFrame:
    return geometry.take_off(geometry.triangles(_meshes(m))).select("guid", "triangle_count", (F.round("volume", 4) + 0.0).alias("volume"), F.round("area", 4).alias("area"))


@query(_TRIS_SQL + """SELECT guid, round(sum(CASE WHEN nz/mag > 0.94 THEN mag/2 ELSE 0 END), 4) AS area_top, round(sum(CASE WHEN nz/mag < -0.94 THEN mag/2 ELSE 0 END), 4) AS area_bottom,
  round(sum(CASE WHEN abs(nz/mag) < 0.342 THEN mag/2 ELSE 0 END), 4) AS area_side, round(sum(CASE WHEN abs(nz/mag) BETWEEN 0.342 AND 0.94 THEN mag/2 ELSE 0 END), 4) AS area_inclined FROM tri GROUP BY guid""", model=False)
def q_mesh_orientation(m: StarModel) -> DataFrame:
    rows = geometry.take_off(geometry.triangles(_meshes(m)))
    return rows.select("guid", *[F.round(c, 4).alias(c) for c in ("area_top", "area_bottom", "area_side", "area_inclined")])


@query(_TRIS_SQL + """, s AS (SELECT guid, CAST(round(nx/mag*10) AS INTEGER) AS qx, CAST(round(ny/mag*10) AS INTEGER) AS qy, CAST(round(nz/mag*10) AS INTEGER) AS qz, sum(mag/2) AS area FROM tri GROUP BY ALL HAVING sum(mag/2) > 1e-6)
SELECT guid, CAST(row_number() OVER (PARTITION BY guid ORDER BY area DESC, qx, qy, qz) - 1 AS INTEGER) AS surface_index, round(area, 4) AS area, qx, qy, qz FROM s""", model=False)
def q_mesh_surfaces(m: StarModel) -> DataFrame:
    return geometry.surfaces(geometry.triangles(_meshes(m))).select("guid", F.col("surface_index").cast("int").alias("surface_index"), F.round("area", 4).alias("area"), "qx", "qy", "qz")


_BOUNDS_SQL = _TRIS_SQL + """, b AS (SELECT guid, vec_id, list_min(x) AS x0, list_max(x) AS x1, list_min(y) AS y0, list_max(y) AS y1, list_min(z) AS z0, list_max(z) AS z1 FROM (
  SELECT guid, vec_id, list_transform(range(0, 20), lambda i: v[3*i+1]) AS x, list_transform(range(0, 20), lambda i: v[3*i+2]) AS y, list_transform(range(0, 20), lambda i: v[3*i+3]) AS z FROM e))
"""


@query(_BOUNDS_SQL + """, q AS (SELECT guid, sum((ax*(by_*cz - bz*cy) + ay*(bz*cx - bx*cz) + az*(bx*cy - by_*cx)) / 6) AS volume FROM tri GROUP BY guid)
SELECT guid, CASE WHEN (x1-x0)*(y1-y0)*(z1-z0) <= 0 THEN 'degenerate' ELSE 'open_shell' END AS mesh_quality FROM b JOIN q USING (guid)
UNION ALL SELECT concat('K', vec_id), 'closed' FROM e""", model=False)
def q_mesh_quality(m: StarModel) -> DataFrame:
    corners, indices = geometry.box_mesh(1.0, 1.0, 1.0)
    sides = [F.abs(F.col("embedding")[k].cast("double")) + 0.1 for k in range(3)]
    boxes = m.raw("embeddings").select(F.concat(F.lit("K"), F.col("vec_id").cast("string")).alias("guid"), F.array(*[F.lit(c) * sides[i % 3] for i, c in enumerate(corners)]).alias("vertices"), F.array(*[F.lit(i).cast("bigint") for i in indices]).alias("indices"))
    return geometry.quality(_meshes(m).drop("vec_id").union(boxes))


_DRIFT_SQL = _BOUNDS_SQL + """, d AS (SELECT guid, sqrt(power((x0+x1)/2 - vec_id % 7, 2) + power((y0+y1)/2, 2) + power((z0+z1)/2, 2)) AS dist, greatest(x1-x0, y1-y0, z1-z0, 1e-6) AS ext FROM b
), s AS (SELECT guid, dist, dist/ext AS ratio, CASE WHEN dist < 0.01 OR dist/ext <= 2 THEN 'ok' WHEN dist/ext <= 10 THEN 'warn' ELSE 'error' END AS severity FROM d)
"""


def _drift(m: StarModel) -> DataFrame:
    boxes = geometry.bounds(_meshes(m)).join(_meshes(m).select("guid", (F.col("vec_id") % 7).cast("double").alias("placement_x")), "guid")
    return geometry.drift(boxes.withColumns({"placement_y": F.lit(0.0), "placement_z": F.lit(0.0)}))


@query(_DRIFT_SQL + "SELECT guid, round(dist, 4) AS drift_distance, round(ratio, 4) AS drift_ratio, severity FROM s", model=False)
def q_drift(m: StarModel) -> DataFrame:
    return _drift(m).select("guid", F.round("drift_distance", 4).alias("drift_distance"), F.round("drift_ratio", 4).alias("drift_ratio"), "severity")


@query(_DRIFT_SQL + "SELECT v AS severity, (SELECT count(*) FROM s WHERE severity = v) AS n FROM (SELECT unnest(['ok', 'info', 'warn', 'error']) AS v)", model=False)
def q_drift_hist(m: StarModel) -> DataFrame:
    return geometry.severity_histogram(geometry.demoted(_drift(m)))


@query(_DRIFT_SQL + "SELECT guid, severity, round(dist, 4) AS drift_distance FROM (SELECT * FROM s WHERE severity <> 'ok' ORDER BY dist DESC, guid LIMIT 50)", model=False)
def q_drift_top(m: StarModel) -> DataFrame:
    return _drift(m).where("severity <> 'ok'").orderBy(F.desc("drift_distance"), "guid").limit(50).select("guid", "severity", F.round("drift_distance", 4).alias("drift_distance"))


@query(_BOUNDS_SQL + """SELECT count(*) AS products, CAST(sum(18) AS BIGINT) AS triangles, round(min(x0), 4) AS min_x, round(max(x1), 4) AS max_x, round(min(z0), 4) AS min_z, round(max(z1), 4) AS max_z, round((SELECT sum(mag/2) FROM tri), 2) AS area FROM b""", model=False)
def q_file_stats(m: StarModel) -> DataFrame:
    box = geometry.bounds(_meshes(m)).agg(F.count("*").alias("products"), *[F.round(f(f"{p}_{x}"), 4).alias(f"{p}_{x}") for p, f in (("min", F.min), ("max", F.max)) for x in "xz"])
    area = geometry.take_off(geometry.triangles(_meshes(m))).agg(F.sum("triangle_count").alias("triangles"), F.round(F.sum("area"), 2).alias("area"))
    return box.crossJoin(F.broadcast(area))  # one row each


@query("SELECT l_suppkey, n FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 20)", model=False)
def q_topk_complex(m: StarModel) -> DataFrame:
    return m.raw("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(20)


@query("""SELECT 'products' AS part, count(*) AS n FROM products UNION ALL SELECT 'storeys', count(*) FROM storeys UNION ALL SELECT 'aggregates', count(*) FROM aggregates UNION ALL SELECT 'contained_in', count(*) FROM contained_in UNION ALL SELECT 'psets', count(*) FROM psets UNION ALL SELECT 'quantities', count(*) FROM quantities
UNION ALL SELECT concat('type:', entity), n FROM (SELECT entity, count(*) AS n FROM products GROUP BY entity ORDER BY n DESC, entity LIMIT 20)""")
def q_summary(m: StarModel) -> DataFrame:
    m.staged()
    shape = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    parts = [("products", m.products()), ("storeys", m.storeys()), ("aggregates", m.aggregates()), ("contained_in", m.contained_in()), ("psets", _psets(m)), ("quantities", _quantities(m))]
    top = summaries.entity_counts(m.products()).orderBy(F.desc("n"), "entity").limit(20).select(F.concat(F.lit("type:"), "entity").alias("part"), "n")
    return summaries.union_all([shape(n, d) for n, d in parts] + [top])


# --- substrate


def _representation(m: StarModel) -> DataFrame:
    """Each line product's shape: its part, unless the flag says it has none."""
    return m.lines().select("guid", F.when(F.col("l_returnflag") != "R", F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("rep_id"), "l_partkey")


@query("""SELECT entity, count(*) AS instance_count, count(DISTINCT rep_id) AS representation_count, CAST(sum(triangle_count) AS BIGINT) AS triangles
FROM products p JOIN (SELECT guid, CASE WHEN l_returnflag <> 'R' THEN concat('P', l_partkey) END AS rep_id FROM lines) USING (guid) JOIN (SELECT concat('P', p_partkey) AS rep_id, CAST(p_size AS BIGINT) * 4 AS triangle_count FROM part) r USING (rep_id) GROUP BY entity""")
def q_rep_sharing(m: StarModel) -> DataFrame:
    shapes = m.raw("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("rep_id"), (F.col("p_size").cast("long") * 4).alias("triangle_count"))
    rows = m.line_products().select("guid", "entity").join(_representation(m), "guid").join(shapes, "rep_id")
    return rows.groupBy("entity").agg(F.count("*").alias("instance_count"), F.count_distinct("rep_id").alias("representation_count"), F.sum("triangle_count").alias("triangles"))


@query("""SELECT p.guid, p.entity, r.rep_id, s.triangle_count FROM products p JOIN (SELECT guid, CASE WHEN l_returnflag <> 'R' THEN concat('P', l_partkey) END AS rep_id FROM lines) r ON r.guid = p.guid
LEFT JOIN (SELECT concat('P', p_partkey) AS rep_id, CAST(p_size AS BIGINT) * 4 AS triangle_count FROM part) s ON s.rep_id = r.rep_id""")
def q_view_products(m: StarModel) -> DataFrame:
    shapes = m.raw("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("rep_id"), (F.col("p_size").cast("long") * 4).alias("triangle_count"))
    return m.line_products().select("guid", "entity").join(_representation(m).drop("l_partkey"), "guid").join(shapes, "rep_id", "left").select("guid", "entity", "rep_id", "triangle_count")


@query("SELECT p.guid, (SELECT count(*) FROM psets s WHERE s.guid = p.guid) AS n_psets, (SELECT string_agg(prop_name, '|' ORDER BY prop_name, value) FROM psets s WHERE s.guid = p.guid) AS props, (SELECT count(*) FROM quantities q WHERE q.guid = p.guid) AS n_quantities FROM lines p")
def q_substrate_nested(m: StarModel) -> DataFrame:
    from ..operators.substrate import nest

    m.staged()
    nested = nest(m.lines().select("guid"), {"psets": _psets(m).select("guid", "prop_name", "value"), "quantities": _quantities(m).select("guid", "quantity_name", "value")})
    return nested.select("guid", F.size("psets").cast("long").alias("n_psets"), F.array_join(F.transform("psets", lambda p: p["prop_name"]), "|").alias("props"), F.size("quantities").cast("long").alias("n_quantities"))


# --- clash


_CLASSES = ("IfcWall", "IfcPipeSegment", "IfcPipeFitting", "IfcCovering", "IfcSpace", "IfcDuctSegment", "IfcDuctFitting", "IfcWallStandardCase", "IfcBeam", "IfcGrid")


def _boxes(m: StarModel) -> DataFrame:
    v = F.col("vec_id")
    middle = [0.25 * (v % 10), 0.25 * (F.floor(v / 10) % 10), 0.25 * F.floor(v / 100)]
    half = [F.abs(F.col("embedding")[k].cast("double")) + 0.02 for k in range(3)]
    entity = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("label") % 10 + 1).cast("int"))
    return m.raw("embeddings").select(v.alias("id"), entity.alias("entity"), *[(c - h).alias(f"min_{x}") for x, c, h in zip("xyz", middle, half, strict=True)], *[(c + h).alias(f"max_{x}") for x, c, h in zip("xyz", middle, half, strict=True)])


_BOX_SQL = "WITH b AS (SELECT vec_id AS id, [" + ", ".join(f"'{c}'" for c in _CLASSES) + "][label % 10 + 1] AS entity, 0.25 * (vec_id % 10) AS x, 0.25 * ((vec_id // 10) % 10) AS y, 0.25 * (vec_id // 100) AS z, abs(CAST(embedding[1] AS DOUBLE)) + 0.02 AS hx, abs(CAST(embedding[2] AS DOUBLE)) + 0.02 AS hy, abs(CAST(embedding[3] AS DOUBLE)) + 0.02 AS hz FROM embeddings), pairs AS (SELECT a.id AS id_a, b.id AS id_b, regexp_replace(regexp_replace(a.entity, '^Ifc', ''), '(StandardCase|ElementedCase)$', '') AS ca, regexp_replace(regexp_replace(b.entity, '^Ifc', ''), '(StandardCase|ElementedCase)$', '') AS cb FROM b a JOIN b ON a.id < b.id AND " + " AND ".join(f"a.{x} - a.h{x} - TOL <= b.{x} + b.h{x} + TOL AND b.{x} - b.h{x} - TOL <= a.{x} + a.h{x} + TOL" for x in "xyz") + ")\n"


@query(_BOX_SQL.replace("TOL", "0.0") + "SELECT id_a, id_b FROM pairs", model=False)
def q_clash_broad(m: StarModel) -> DataFrame:
    return clash.broad_phase(_boxes(m))


@query(_BOX_SQL.replace("TOL", "0.02") + "SELECT id_a, id_b FROM pairs", model=False)
def q_clash_tolerance(m: StarModel) -> DataFrame:
    return clash.broad_phase(_boxes(m), 0.02)


@query(_BOX_SQL.replace("TOL", "0.0") + """, k AS (SELECT *, CASE WHEN ca IN ('Grid', 'Annotation', 'Space', 'OpeningElement', 'VirtualElement') OR cb IN ('Grid', 'Annotation', 'Space', 'OpeningElement', 'VirtualElement') THEN 'non_physical' WHEN ca = 'Covering' OR cb = 'Covering' THEN 'insulation'
  WHEN (ca, cb) IN (('PipeSegment', 'PipeFitting'), ('PipeFitting', 'PipeSegment'), ('DuctSegment', 'DuctFitting'), ('DuctFitting', 'DuctSegment')) THEN 'connection' ELSE 'clash' END AS category FROM pairs)
SELECT category, ca AS class_a, cb AS class_b, count(*) AS n FROM k WHERE NOT (ca = cb AND ca = 'Wall') GROUP BY ALL""", model=False)
def q_clash_categories(m: StarModel) -> DataFrame:
    named = _boxes(m).select("id", clash.substrate_class(F.col("entity")).alias("class"))
    side = lambda s: named.select(F.col("id").alias(f"id_{s}"), F.col("class").alias(f"class_{s}"))
    pairs = clash.broad_phase(_boxes(m)).join(side("a"), "id_a").join(side("b"), "id_b")
    kept = clash.class_filter(pairs, exclude_self=["Wall"])
    return kept.withColumn("category", clash.category(F.col("class_a"), F.col("class_b"))).groupBy("category", "class_a", "class_b").agg(F.count("*").alias("n"))


_APART_SQL = ", ".join(f"greatest(a.{x} - a.h{x} - (b.{x} + b.h{x}), b.{x} - b.h{x} - (a.{x} + a.h{x})) AS g{x}, least(b.{x} + b.h{x} - (a.{x} + a.h{x}), a.{x} - a.h{x} - (b.{x} - b.h{x})) AS ina{x}, least(a.{x} + a.h{x} - (b.{x} + b.h{x}), b.{x} - b.h{x} - (a.{x} - a.h{x})) AS inb{x}" for x in "xyz")


@query(_BOX_SQL.replace("TOL", "0.02") + f""", m AS (SELECT id_a, id_b, ca, cb, {_APART_SQL} FROM pairs JOIN b a ON a.id = id_a JOIN b ON b.id = id_b), d AS (
  SELECT *, CASE WHEN greatest(gx, gy, gz) > 0 THEN sqrt(power(greatest(gx, 0), 2) + power(greatest(gy, 0), 2) + power(greatest(gz, 0), 2)) ELSE greatest(0, least(inax, inay, inaz), least(inbx, inby, inbz)) END AS distance FROM m
) SELECT id_a, id_b, ca AS class_a, cb AS class_b, CASE WHEN distance = 0 THEN 'hard' ELSE 'clearance' END AS kind, round(distance, 4) + 0.0 AS min_distance_m FROM d WHERE distance <= 0.02""", model=False)
def q_clash_narrow(m: StarModel) -> DataFrame:
    """Boxes as meshes: the distance between two skins is that between the boxes, or how deep one lies within the other."""
    return clash.clash(*_box_meshes(m), tolerance=0.02).select("id_a", "id_b", "class_a", "class_b", "kind", (F.round("min_distance_m", 4) + 0.0).alias("min_distance_m"))


def _box_meshes(m: StarModel) -> tuple[DataFrame, DataFrame]:
    corners, indices = geometry.box_mesh(1.0, 1.0, 1.0)
    b = _boxes(m).withColumn("guid", F.concat(F.lit("M"), F.col("id").cast("string")))
    vertices = F.array(*[F.col(f"min_{x}") + (F.col(f"max_{x}") - F.col(f"min_{x}")) * c for c, x in zip(corners, "xyz" * 8, strict=True)])
    return b, b.select("id", vertices.alias("vertices"), F.array(*[F.lit(i).cast("bigint") for i in indices]).alias("indices"))


# --- floors


def _floors(m: StarModel) -> DataFrame:
    rows = m.storeys().select(F.col("building_guid").alias("model_name"), F.col("name").alias("storey_name"), F.col("elevation").alias("elevation_mm"), F.col("guid").alias("storey_guid"))
    return summaries.cluster_elevations(rows, 500.0)


_FLOOR_SQL = """, o AS (SELECT building_guid AS model_name, name AS storey_name, elevation AS e, guid AS storey_guid, row_number() OVER (PARTITION BY building_guid ORDER BY elevation, name, guid) AS k FROM storeys
), f AS (SELECT model_name, storey_name, storey_guid, e, k, 0 AS cluster, e AS total, 1 AS n FROM o WHERE k = 1
  UNION ALL SELECT o.model_name, o.storey_name, o.storey_guid, o.e, o.k, CASE WHEN abs(o.e - f.total / f.n) <= 500 THEN f.cluster ELSE f.cluster + 1 END, CASE WHEN abs(o.e - f.total / f.n) <= 500 THEN f.total + o.e ELSE o.e END, CASE WHEN abs(o.e - f.total / f.n) <= 500 THEN f.n + 1 ELSE 1 END FROM f JOIN o ON o.model_name = f.model_name AND o.k = f.k + 1)
"""


@query(_FLOOR_SQL + "SELECT model_name, storey_guid, e AS elevation_mm, CAST(cluster AS INTEGER) AS cluster FROM f")
def q_floors(m: StarModel) -> DataFrame:
    return _floors(m).select("model_name", "storey_guid", "elevation_mm", "cluster")


@query(_FLOOR_SQL + """SELECT model_name, CAST(cluster AS INTEGER) AS cluster, round(avg(e), 4) AS elevation_mm, count(*) AS n, arg_min(storey_name, k) AS most_common, concat('C - ', arg_min(storey_name, k)) AS label FROM f GROUP BY model_name, cluster""")
def q_floors_rule(m: StarModel) -> DataFrame:
    return summaries.floor_labels(_floors(m), prefix="C - ").withColumn("elevation_mm", F.round("elevation_mm", 4))


# --- differences


def _versions(m: StarModel) -> tuple[DataFrame, DataFrame]:
    """Line products as two models: the first row of each key without flag R, the last row without flag A."""
    keys = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*keys)
    guid = F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    old = m.raw("lineitem").withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("guid", guid)
    shape = [F.concat("l_returnflag", "l_linestatus").alias("entity"), F.col("l_suppkey").cast("string").alias("tag"), F.col("l_linestatus").alias("predefined_type")]
    return old.where("l_returnflag <> 'R'").select("guid", *shape), m.lines().where("l_returnflag <> 'A'").select("guid", *shape)


_DIFF_SQL = """, old AS (SELECT concat('L', l_orderkey, '-', l_linenumber) AS guid, l_returnflag || l_linestatus AS entity, CAST(l_suppkey AS VARCHAR) AS tag, l_linestatus AS predefined_type FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k FROM lineitem) WHERE k = 1 AND l_returnflag <> 'R'
), fresh AS (SELECT guid, l_returnflag || l_linestatus AS entity, CAST(l_suppkey AS VARCHAR) AS tag, l_linestatus AS predefined_type FROM lines WHERE l_returnflag <> 'A')
"""


@query(_DIFF_SQL + "SELECT guid, entity FROM fresh WHERE guid NOT IN (SELECT guid FROM old)")
def q_diff_added(m: StarModel) -> DataFrame:
    return summaries.added(*_versions(m)).select("guid", "entity")


@query(_DIFF_SQL + "SELECT guid, entity FROM old WHERE guid NOT IN (SELECT guid FROM fresh)")
def q_diff_removed(m: StarModel) -> DataFrame:
    return summaries.removed(*_versions(m)).select("guid", "entity")


@query(_DIFF_SQL + " UNION ALL ".join(f"SELECT o.guid, '{f}' AS field, o.{f} AS before, n.{f} AS after FROM old o JOIN fresh n USING (guid) WHERE o.{f} IS DISTINCT FROM n.{f}" for f in ("entity", "tag", "predefined_type")))
def q_diff_changed(m: StarModel) -> DataFrame:
    return summaries.changed(*_versions(m), fields=("entity", "tag", "predefined_type"))


@query(_DIFF_SQL + "SELECT entity, coalesce(a, 0) AS n_left, coalesce(b, 0) AS n_right, coalesce(b, 0) - coalesce(a, 0) AS delta FROM (SELECT entity, count(*) AS a FROM old GROUP BY entity) FULL JOIN (SELECT entity, count(*) AS b FROM fresh GROUP BY entity) USING (entity) WHERE coalesce(a, 0) <> coalesce(b, 0)")
def q_type_deltas(m: StarModel) -> DataFrame:
    return summaries.count_deltas(*_versions(m))


# --- reachability


def _refs(m: StarModel) -> DataFrame:
    """Forward references: line to part and supplier, order to customer, and so up to regions."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    pairs = [
        m.lines().select(F.col("guid").alias("src"), key("T", "l_partkey").alias("dst")),
        m.lines().select("guid", key("S", "l_suppkey")),
        m.raw("orders").select(key("O", "o_orderkey"), key("C", "o_custkey")),
        m.raw("customer").select(key("C", "c_custkey"), key("N", "c_nationkey")),
        m.raw("supplier").select(key("S", "s_suppkey"), key("N", "s_nationkey")),
        m.raw("nation").select(key("N", "n_nationkey"), key("R", "n_regionkey")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.union(p)
    return out


_REFS_SQL = """, refs AS (SELECT guid AS src, concat('T', l_partkey) AS dst FROM lines UNION ALL SELECT guid, concat('S', l_suppkey) FROM lines UNION ALL SELECT concat('O', o_orderkey), concat('C', o_custkey) FROM orders UNION ALL SELECT concat('C', c_custkey), concat('N', c_nationkey) FROM customer
  UNION ALL SELECT concat('S', s_suppkey), concat('N', s_nationkey) FROM supplier UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey) FROM nation)
"""


@query(_REFS_SQL + ", reached AS (SELECT guid AS node FROM products WHERE entity = 'IfcSensor' UNION SELECT dst FROM reached JOIN refs ON src = node) SELECT node FROM reached")
def q_closure(m: StarModel) -> DataFrame:
    m.staged()
    starts = m.products().where("entity = 'IfcSensor'").select(F.col("guid").alias("node"))
    return graph.reachable(starts, _refs(m))


@query("""SELECT o_orderkey AS rel_id, string_agg(guid, '|' ORDER BY guid) AS kept, count(*) AS n FROM orders JOIN (SELECT guid, l_orderkey FROM lines WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q_subset_rels(m: StarModel) -> DataFrame:
    from ..operators.subset import prune_anchors

    rels = m.lines().select(F.col("l_orderkey").alias("rel_id"), F.col("guid").alias("anchor"))
    kept = m.lines().where("l_returnflag = 'R'").select(F.col("guid").alias("node"))
    return prune_anchors(rels, kept).groupBy("rel_id").agg(F.array_join(F.sort_array(F.collect_list("anchor")), "|").alias("kept"), F.count("*").alias("n"))


_DEAD_SQL = ", ".join(f"dead{k} AS (SELECT dst AS node FROM refs GROUP BY dst HAVING bool_and(src IN (SELECT node FROM dead{k - 1}) OR src IN (SELECT node FROM dead0)))" for k in (1, 2, 3, 4))


@query(_REFS_SQL + ", dead0 AS (SELECT guid AS node FROM products WHERE guid LIKE 'O%' AND object_type <> '5-LOW'), " + _DEAD_SQL + " SELECT node FROM dead4")
def q_orphan_gc(m: StarModel) -> DataFrame:
    m.staged("l_partkey", "l_suppkey")
    from ..operators.subset import orphans

    gone = m.other_products().where("guid LIKE 'O%' AND object_type <> '5-LOW'").select(F.col("guid").alias("node"))
    return orphans(_refs(m), gone)


@query("SELECT guid, CASE WHEN l_returnflag = 'A' AND p_size > 40 THEN l_extendedprice ELSE l_quantity END AS value, l_returnflag = 'A' AND p_size > 40 AS routed FROM lines JOIN part ON p_partkey = l_partkey")
def q_hybrid_routing(m: StarModel) -> DataFrame:
    flagged = m.lines().join(m.raw("part"), F.col("p_partkey") == F.col("l_partkey")).where("l_returnflag = 'A' AND p_size > 40").select("guid", F.col("l_extendedprice").alias("outside"))
    return m.lines().select("guid", "l_quantity").join(flagged, "guid", "left").select("guid", F.coalesce("outside", "l_quantity").alias("value"), F.col("outside").isNotNull().alias("routed"))


@query(_BOUNDS_SQL + """, counted AS (SELECT guid, CAST(ceil(1000 * sum(mag / 2)) AS BIGINT) AS n FROM tri GROUP BY guid)
SELECT guid, n, n AS n_inside, n AS n_fair FROM counted""", model=False)
def q_point_cloud(m: StarModel) -> DataFrame:
    """Points a mesh at the default density, those inside its box, and those on triangles that got their share to within one."""
    tris = geometry.triangles(_meshes(m))
    cloud = geometry.point_cloud(tris)
    share = tris.select("guid", "tri", "mag", *[F.least(*[F.col(f"{c}{x}") for c in "abc"]).alias(f"low_{x}") for x in "xyz"], *[F.greatest(*[F.col(f"{c}{x}") for c in "abc"]).alias(f"high_{x}") for x in "xyz"])
    # ceil() over a mesh adds less than one point to it, so a triangle's ladder is at most that much denser.
    whole = tris.groupBy("guid").agg((F.sum("mag") / 2).alias("area"))
    got = cloud.join(share, ["guid", "tri"]).withColumn("inside", F.forall(F.array(*[(F.col(x) >= F.col(f"low_{x}") - 1e-9) & (F.col(x) <= F.col(f"high_{x}") + 1e-9) for x in "xyz"]), lambda ok: ok))
    per = got.groupBy("guid", "tri").agg(F.count("*").alias("n"), F.count_if("inside").alias("inside"), F.first("mag").alias("mag")).join(whole, "guid")
    fair = F.abs(F.col("n") - F.ceil(F.col("area") * 1000) * F.col("mag") / 2 / F.col("area")) <= 1 + 1e-6
    return per.groupBy("guid").agg(F.sum("n").alias("n"), F.sum("inside").alias("n_inside"), F.coalesce(F.sum(F.when(fair, F.col("n"))), F.lit(0).cast("long")).alias("n_fair"))
