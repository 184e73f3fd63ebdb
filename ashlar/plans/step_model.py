"""The driver tables written out as one STEP file, read back through the source and run through every table operator.

Sites, buildings and storeys come from regions, nations and suppliers; products from customers and orders; type objects
from parts. The SQL beside each query states its rows straight from the driver tables, so a green query means that
writing, scanning, lexing, resolving and joining all agree.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classes, step_text
from ..operators import subset
from ..operators.durable import durable, shared_dir
from ..operators.index import Tables
from ..sources import step

#: Step ids of a kind start here; each kind has room for its keys.
ROOM = 100_000_000
KINDS = (
    "site building storey customer order part agg_sites agg_buildings agg_storeys agg_orders in_storey in_building typed pset single bounded listed table part_set part_prop set_of quantity quantity_value quantity_of "
    "void material layer layers usage constituent constituents profile profiles list material_of system reference class_of class_direct complex nested"
).split()
BASE = {kind: ROOM * (i + 1) for i, kind in enumerate(KINDS)}
#: Kinds with two records a key have twice the room, after the others.
BASE |= {kind: ROOM * (len(KINDS) + 1 + 2 * i) for i, kind in enumerate(("single", "part_prop", "quantity_value"))}
CUSTOMERS = {"AUTOMOBILE": "IfcWall", "BUILDING": "IfcSlab", "FURNITURE": "IfcFurniture", "HOUSEHOLD": "IfcElementAssembly", "MACHINERY": "IfcPipeSegment"}
ORDERS = {"1-URGENT": "IfcWallStandardCase", "2-HIGH": "IfcOpeningElement", "3-MEDIUM": "IfcSpace", "4-NOT SPECIFIED": "IfcBeam", "5-LOW": "IfcWindow"}
MATERIAL_KINDS = ("direct", "list", "layer", "constituent", "profile", "unknown")
HEAD = (
    "ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION(('ViewDefinition [CoordinationView]','a ''quoted'' part'),'2;1');\nFILE_NAME('star \\X2\\00E9\\X0\\.ifc','2024-01-02T03:04:05',('A','B'),('Org'),'pre','Origin; (x)','auth');\n"
    "FILE_SCHEMA(('IFC4'));\nENDSEC;\n/* DATA; in a comment */\nDATA;"
)


def _id(kind: str, key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("long") + BASE[kind]


def _ref(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit("#"), _id(kind, key).cast("string"))


def _text(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def guid(letter: str, key: Column | str) -> Column:
    """A 22-character id."""
    return F.concat(F.lit(letter), F.lpad((F.col(key) if isinstance(key, str) else key).cast("string"), 21, "0"))


def _guid_sql(letter: str, key: str) -> str:
    return f"concat('{letter}', lpad(CAST({key} AS VARCHAR), 21, '0'))"


def _cents(name: str) -> Column:
    """An amount with two decimals. A negative one that rounds to zero keeps its sign, as formatting a double does and a decimal cannot."""
    text = F.col(name).cast("decimal(12,2)").cast("string")
    return F.when((F.col(name) <= 0) & F.startswith(F.col(name).cast("string"), F.lit("-")) & (text == "0.00"), "-0.00").otherwise(text)


def _mapped(value: Column, names: dict[str, str]) -> Column:
    return F.upper(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, raw): every record of the model, in file order; some sites stand twice, the later one counts."""
    read = lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    region, nation, supplier, customer, orders, part = (read(n) for n in ("region", "nation", "supplier", "customer", "orders", "part"))
    out: list[DataFrame] = []

    def put(df: DataFrame, kind: str, key: Column | str, name: str | Column, *fields: Column | str, early: bool = False) -> None:
        """One record a row: fields are STEP text, plain strings as they are."""
        body = F.concat_ws(",", *[F.lit(f) if isinstance(f, str) else f for f in fields])
        at = _id(kind, key)
        out.append(df.select((F.lit(0).cast("long") + F.col(key) if early else at).alias("ord"), F.concat(F.lit("#"), at.cast("string"), F.lit("="), F.lit(name) if isinstance(name, str) else name, F.lit("("), body, F.lit(");")).alias("raw")))

    refs = lambda df, by, kind, key: df.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda k: _ref(kind, k)), ",").alias("refs"))
    listed = F.concat(F.lit("("), F.col("refs"), F.lit(")"))
    g = lambda letter, key: _text(guid(letter, key))
    fixed = [
        "#1=IFCPROJECT('P000000000000000000000',$,'Project',$,$,$,$,$,#8);", "#2=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.);", "#3=IFCSIUNIT(*,.AREAUNIT.,$,.SQUARE_METRE.);", "#4=IFCSIUNIT(*,.VOLUMEUNIT.,$,.CUBIC_METRE.);",
        "#5=IFCDIMENSIONALEXPONENTS(1,0,0,0,0,0,0);", "#6=IFCMEASUREWITHUNIT(IFCLENGTHMEASURE(304.8),#2);", "#7=IFCCONVERSIONBASEDUNIT(#5,.LENGTHUNIT.,'FOOT',#6);", "#8=IFCUNITASSIGNMENT((#7,#3,#4));",
    ]
    out.append(spark.createDataFrame([(1000 + i, r) for i, r in enumerate(fixed)], "ord long, raw string"))
    # Spatial structure. The first copy of a site is overruled by the second.
    put(region, "site", "r_regionkey", "IFCSITE", g("R", "r_regionkey"), "$", "'overruled'", "$", "$", "$", "$", "$", ".ELEMENT.", "$", "$", "$", "$", "$", early=True)
    put(region, "site", "r_regionkey", "IFCSITE", g("R", "r_regionkey"), "$", _text(F.concat("r_name", F.lit("'s; /* #9=X(); */ (y)"))), "$", "$", "$", "$", "$", ".ELEMENT.", "$", "$", "$", "$", "$")
    put(nation, "building", "n_nationkey", "IFCBUILDING", g("N", "n_nationkey"), "$", F.concat(F.lit("'"), F.col("n_name"), F.lit("\\X2\\00E900FC\\X0\\ \\S\\i \\X\\E9'")), "$", "$", "$", "$", "$", ".ELEMENT.", "$", "$", "$")
    put(supplier, "storey", "s_suppkey", "IFCBUILDINGSTOREY", g("S", "s_suppkey"), "$", _text(F.col("s_name")), "$", "$", "$", "$", "$", ".ELEMENT.", F.col("s_acctbal").cast("decimal(12,2)").cast("string"))
    put(refs(region.withColumn("one", F.lit(0)), "one", "site", "r_regionkey"), "agg_sites", "one", "IFCRELAGGREGATES", "'a000000000000000000000'", "$", "$", "$", "#1", listed)
    put(refs(nation, "n_regionkey", "building", "n_nationkey"), "agg_buildings", "n_regionkey", "IFCRELAGGREGATES", g("b", "n_regionkey"), "$", "$", "$", _ref("site", "n_regionkey"), listed)
    put(refs(supplier, "s_nationkey", "storey", "s_suppkey"), "agg_storeys", "s_nationkey", "IFCRELAGGREGATES", g("c", "s_nationkey"), "$", "$", "$", _ref("building", "s_nationkey"), listed)
    # Products.
    put(customer, "customer", "c_custkey", _mapped(F.col("c_mktsegment"), CUSTOMERS), g("C", "c_custkey"), "$", _text(F.col("c_name")), "$", _text(F.col("c_mktsegment")), "$", "$", _text(F.col("c_nationkey").cast("string")), F.when(F.col("c_custkey") % 2 == 0, ".STANDARD.").otherwise("$"))
    window = orders.where("o_orderpriority = '5-LOW'")
    put(window, "order", "o_orderkey", "IFCWINDOW", g("O", "o_orderkey"), "$", "$", "$", _text(F.col("o_orderstatus")), "$", "$", "$", "1.5", "2.", F.concat(F.lit(".W"), F.col("o_orderstatus"), F.lit(".")), ".SINGLE_PANEL.", "$")
    put(orders.where("o_orderpriority <> '5-LOW'"), "order", "o_orderkey", _mapped(F.col("o_orderpriority"), ORDERS), g("O", "o_orderkey"), "$", _text(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))), "$", "$", "$", "$", "$", F.concat(F.lit("."), F.col("o_orderstatus"), F.lit(".")))
    put(refs(orders, "o_custkey", "order", "o_orderkey"), "agg_orders", "o_custkey", "IFCRELAGGREGATES", g("d", "o_custkey"), "$", "$", "$", _ref("customer", "o_custkey"), listed)
    storeys = supplier.agg(F.count("*").alias("n_storeys"))
    even = customer.where("c_custkey % 2 = 0").crossJoin(F.broadcast(storeys)).withColumn("at", F.col("c_custkey") % F.col("n_storeys"))  # one row
    put(refs(even, "at", "customer", "c_custkey"), "in_storey", "at", "IFCRELCONTAINEDINSPATIALSTRUCTURE", g("e", "at"), "$", "$", "$", listed, _ref("storey", "at"))
    put(refs(customer.where("c_custkey % 2 = 1"), "c_nationkey", "customer", "c_custkey"), "in_building", "c_nationkey", "IFCRELCONTAINEDINSPATIALSTRUCTURE", g("f", "c_nationkey"), "$", "$", "$", listed, _ref("building", "c_nationkey"))
    put(orders.where("o_orderpriority = '2-HIGH'"), "void", "o_orderkey", "IFCRELVOIDSELEMENT", g("v", "o_orderkey"), "$", "$", "$", _ref("customer", "o_custkey"), _ref("order", "o_orderkey"))
    # Types, which hand down properties and quantities.
    put(part, "part", "p_partkey", "IFCWALLTYPE", g("T", "p_partkey"), "$", _text(F.col("p_name")), "$", "$", F.concat(F.lit("("), _ref("part_set", "p_partkey"), F.lit(")")), "$", "$", "$", ".STANDARD.")
    put(part, "part_set", "p_partkey", "IFCPROPERTYSET", g("t", "p_partkey"), "$", "'Pset_Common'", "$", F.concat(F.lit("("), _ref("part_prop", F.col("p_partkey") * 2), F.lit(","), _ref("part_prop", F.col("p_partkey") * 2 + 1), F.lit(")")))
    put(part, "part_prop", F.col("p_partkey") * 2, "IFCPROPERTYSINGLEVALUE", "'Grade'", "$", F.concat(F.lit("IFCLABEL("), _text(F.col("p_type")), F.lit(")")), "$")
    put(part, "part_prop", F.col("p_partkey") * 2 + 1, "IFCPROPERTYSINGLEVALUE", "'LoadBearing'", "$", F.when(F.col("p_size") > 25, "IFCBOOLEAN(.T.)").otherwise("IFCBOOLEAN(.F.)"), "$")
    put(customer.join(part, F.col("c_custkey") == F.col("p_partkey"), "left_semi"), "typed", "c_custkey", "IFCRELDEFINESBYTYPE", g("y", "c_custkey"), "$", "$", "$", F.concat(F.lit("("), _ref("customer", "c_custkey"), F.lit(")")), _ref("part", "c_custkey"))
    # Properties of customers, one of each form; every third has a Grade of its own.
    own = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(","), _ref("single", F.col("c_custkey") * 2 + 1))).otherwise("")
    props = F.concat(F.lit("("), _ref("single", F.col("c_custkey") * 2), own, *[F.concat(F.lit(","), _ref(k, "c_custkey")) for k in ("bounded", "listed", "table", "complex")], F.lit(")"))
    put(customer, "pset", "c_custkey", "IFCPROPERTYSET", g("p", "c_custkey"), "$", "'Pset_Common'", "$", props)
    put(customer, "single", F.col("c_custkey") * 2, "IFCPROPERTYSINGLEVALUE", "'Balance'", "$", F.concat(F.lit("IFCREAL("), _cents("c_acctbal"), F.lit(")")), "$")
    put(customer.where("c_custkey % 3 = 0"), "single", F.col("c_custkey") * 2 + 1, "IFCPROPERTYSINGLEVALUE", "'Grade'", "$", "IFCLABEL('own')", "$")
    put(customer, "bounded", "c_custkey", "IFCPROPERTYBOUNDEDVALUE", "'Range'", "$", F.concat(F.lit("IFCINTEGER("), (F.col("c_custkey") + 1).cast("string"), F.lit(")")), F.concat(F.lit("IFCINTEGER("), F.col("c_custkey").cast("string"), F.lit(")")), "$", "$")
    put(customer, "listed", "c_custkey", "IFCPROPERTYLISTVALUE", "'Words'", "$", F.concat(F.lit("(IFCLABEL("), _text(F.col("c_mktsegment")), F.lit("),$,IFCLABEL('z, y'))")), "$")
    put(customer, "table", "c_custkey", "IFCPROPERTYTABLEVALUE", "'Table'", "$", "(IFCINTEGER(1),IFCINTEGER(2))", F.concat(F.lit("(IFCLABEL("), _text(F.col("c_name")), F.lit("),IFCLABEL('b'))")), "$", "$", "$", "$")
    put(customer, "complex", "c_custkey", "IFCCOMPLEXPROPERTY", "'Outer'", "$", "'use'", F.concat(F.lit("("), _ref("nested", "c_custkey"), F.lit(")")))
    put(customer, "nested", "c_custkey", "IFCPROPERTYSINGLEVALUE", "'Inner'", "$", F.when(F.col("c_custkey") % 2 == 0, "IFCLOGICAL(.U.)").otherwise("IFCLABEL($)"), "$")
    put(customer, "set_of", "c_custkey", "IFCRELDEFINESBYPROPERTIES", g("q", "c_custkey"), "$", "$", "$", F.concat(F.lit("("), _ref("customer", "c_custkey"), F.lit(")")), _ref("pset", "c_custkey"))
    # Quantities of orders: an area in the project's unit, a length with a unit of its own.
    put(orders, "quantity", "o_orderkey", "IFCELEMENTQUANTITY", g("k", "o_orderkey"), "$", "'Qto_Base'", "$", "$", F.concat(F.lit("("), _ref("quantity_value", F.col("o_orderkey") * 2), F.lit(","), _ref("quantity_value", F.col("o_orderkey") * 2 + 1), F.lit(")")))
    put(orders, "quantity_value", F.col("o_orderkey") * 2, "IFCQUANTITYAREA", "'Gross'", "$", "$", F.col("o_totalprice").cast("decimal(12,2)").cast("string"), "$")
    put(orders, "quantity_value", F.col("o_orderkey") * 2 + 1, "IFCQUANTITYLENGTH", "'Long'", "$", "#2", F.concat(F.col("o_custkey").cast("string"), F.lit(".")), "$")
    put(orders, "quantity_of", "o_orderkey", "IFCRELDEFINESBYPROPERTIES", g("l", "o_orderkey"), "$", "$", "$", F.concat(F.lit("("), _ref("order", "o_orderkey"), F.lit(")")), _ref("quantity", "o_orderkey"))
    # Materials: a container of each form for each nation, and one that is none.
    put(nation, "material", F.col("n_nationkey") * 2, "IFCMATERIAL", _text(F.concat("n_name", F.lit(" core"))), "$", "$")
    put(nation, "material", F.col("n_nationkey") * 2 + 1, "IFCMATERIAL", _text(F.concat("n_name", F.lit(" skin"))), "$", "$")
    two = lambda kind: F.concat(F.lit("("), _ref(kind, F.col("n_nationkey") * 2), F.lit(","), _ref(kind, F.col("n_nationkey") * 2 + 1), F.lit(")"))
    for i in (0, 1):
        k, m = F.col("n_nationkey") * 2 + i, _ref("material", F.col("n_nationkey") * 2 + i)
        put(nation, "layer", k, "IFCMATERIALLAYER", m, F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(".5")), "$", "$", "$", "$", "$")
        put(nation, "constituent", k, "IFCMATERIALCONSTITUENT", "$", "$", m, "$", "$")
        put(nation, "profile", k, "IFCMATERIALPROFILE", "$", "$", m, "$", "$", "$")
    put(nation, "list", "n_nationkey", "IFCMATERIALLIST", two("material"))
    put(nation, "layers", "n_nationkey", "IFCMATERIALLAYERSET", two("layer"), "$", "$")
    put(nation, "usage", F.col("n_nationkey") * 2, "IFCMATERIALLAYERSETUSAGE", _ref("layers", "n_nationkey"), ".AXIS2.", ".POSITIVE.", "0.", "$")
    put(nation, "usage", F.col("n_nationkey") * 2 + 1, "IFCMATERIALPROFILESETUSAGE", _ref("profiles", "n_nationkey"), "$", "$")
    put(nation, "constituents", "n_nationkey", "IFCMATERIALCONSTITUENTSET", "$", "$", two("constituent"))
    put(nation, "profiles", "n_nationkey", "IFCMATERIALPROFILESET", "$", "$", two("profile"), "$")
    target = F.element_at(F.array(_ref("material", F.col("n_nationkey") * 2), _ref("list", "n_nationkey"), _ref("usage", F.col("n_nationkey") * 2), _ref("constituents", "n_nationkey"), _ref("usage", F.col("n_nationkey") * 2 + 1), F.lit("#3")), F.col("m") + 1)
    grouped = refs(customer.withColumn("m", (F.col("c_custkey") % 6).cast("int")).withColumn("by", F.struct("c_nationkey", "m")), "by", "customer", "c_custkey").select(F.col("by.c_nationkey").alias("n_nationkey"), "by.m", "refs")
    put(grouped, "material_of", F.col("n_nationkey") * 6 + F.col("m"), "IFCRELASSOCIATESMATERIAL", g("m", F.col("n_nationkey") * 6 + F.col("m")), "$", "$", "$", listed, target)
    # Classifications: nations refer to regions, which refer to a system; sites are classified by the system itself.
    put(region, "system", "r_regionkey", "IFCCLASSIFICATION", _text(F.col("r_name")), "'v1'", "$", _text(F.concat(F.lit("Sys "), "r_name")), "$", "$", "$")
    put(region, "reference", F.col("r_regionkey") + 1000, "IFCCLASSIFICATIONREFERENCE", "$", _text(F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))), "$", _ref("system", "r_regionkey"), "$", "$")
    put(nation, "reference", "n_nationkey", "IFCCLASSIFICATIONREFERENCE", "'http://x'", _text(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))), _text(F.col("n_name")), _ref("reference", F.col("n_regionkey") + 1000), "$", "$")
    put(refs(customer, "c_nationkey", "customer", "c_custkey"), "class_of", "c_nationkey", "IFCRELASSOCIATESCLASSIFICATION", g("w", "c_nationkey"), "$", "$", "$", listed, _ref("reference", "c_nationkey"))
    put(region, "class_direct", "r_regionkey", "IFCRELASSOCIATESCLASSIFICATION", g("x", "r_regionkey"), "$", "$", "$", F.concat(F.lit("("), _ref("site", "r_regionkey"), F.lit(")")), _ref("system", "r_regionkey"))
    return reduce(DataFrame.unionByName, out)


_files: dict[tuple[str, str], str] = {}
_tables: dict[tuple[str, str], Tables] = {}


def step_file(spark: SparkSession, sf_dir: str) -> str:
    """The folder with the model's STEP file, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _files:
        path = f"{shared_dir(spark)}/ashlar-step/{uuid.uuid4().hex}"
        step.write_step(records(spark, sf_dir), HEAD, path)
        _files[key] = path
    return _files[key]


def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of step_file() as the source reads them."""
    return step.read_step(spark, step_file(spark, sf_dir))


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = Tables(read_back(spark, sf_dir), "IFC4")
    return _tables[key]


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_MODES = "CASE entity " + " ".join(f"WHEN '{e}' THEN '{classes.mode_of(e)}'" for e in sorted({*CUSTOMERS.values(), *ORDERS.values()})) + " END"
_C, _O, _S, _N, _R, _T = (_guid_sql(letter, key) for letter, key in (("C", "c_custkey"), ("O", "o_orderkey"), ("S", "s_suppkey"), ("N", "n_nationkey"), ("R", "r_regionkey"), ("T", "p_partkey")))
_PRODUCTS = f"""SELECT {_C} AS guid, {_case("c_mktsegment", CUSTOMERS)} AS entity, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'STANDARD' END AS predefined_type, c_mktsegment AS object_type, CAST(c_nationkey AS VARCHAR) AS tag, CAST({BASE["customer"]} + c_custkey AS BIGINT) AS step_id FROM customer
UNION ALL SELECT {_O}, {_case("o_orderpriority", ORDERS)}, CASE WHEN o_orderpriority <> '5-LOW' THEN concat('Order ', o_orderkey) END, CASE WHEN o_orderpriority = '5-LOW' THEN concat('W', o_orderstatus) ELSE o_orderstatus END, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus END, NULL, CAST({BASE["order"]} + o_orderkey AS BIGINT) FROM orders"""
_HELD = f"""SELECT c_custkey, {_C} AS guid, CASE WHEN c_custkey % 2 = 0 THEN {_guid_sql("S", "c_custkey % (SELECT count(*) FROM supplier)")} ELSE {_guid_sql("N", "c_nationkey")} END AS holder, CASE WHEN c_custkey % 2 = 0 THEN {_guid_sql("S", "c_custkey % (SELECT count(*) FROM supplier)")} END AS storey FROM customer"""
_TYPED = f"SELECT {_C} AS guid, {_T} AS type_guid, p_name AS type_name, p_type, p_size FROM customer JOIN part ON p_partkey = c_custkey"
_PLAIN = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
STEP_SQL = f"""WITH products AS ({_PRODUCTS}), held AS ({_HELD}), typed AS ({_TYPED})
"""


def q_step_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of some types, chosen in the scan: how many, how many ids, and how many are whole."""
    rows = step.read_step(spark, step_file(spark, sf_dir), types="IFCSITE,IFCBUILDING,IFCBUILDINGSTOREY,IFCRELVOIDSELEMENT,IFCQUANTITYAREA")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("step_id").alias("n_ids"), F.count_if(F.col("raw").rlike(r"(?s)^#\d+=[A-Z]+\(.*\);\s*$")).alias("n_whole"))


def q_step_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites after ids that stand twice are merged: the last name at the first place; with the count of repeats."""
    whole = read_back(spark, sf_dir)
    merged = step.entity_table(whole.where("type = 'IFCSITE'"))
    name = step_text.string(F.get(step_text.split_fields("args"), F.lit(2)))
    rows = merged.crossJoin(F.broadcast(step.duplicate_ids(whole).select("duplicates")))  # one row
    return rows.select("step_id", name.alias("name"), (F.row_number().over(Window.orderBy("ord")) - 1).cast("long").alias("place"), "duplicates")


def q_step_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = step.header(step_file(spark, sf_dir))
    return spark.createDataFrame([(h["schema"], h["name"], h["time_stamp"], "|".join(h["description"]), "|".join(h["author"]), "|".join(h["organization"]), h["preprocessor_version"], h["originating_system"], h["authorisation"], h["encoding_lossy"], len(h["cache_key"]))], "schema_name string, name string, time_stamp string, description string, author string, organization string, preprocessor string, origin string, auth string, lossy boolean, key_chars int")


def q_step_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).products().select("guid", "entity", "name", "predefined_type", "object_type", "tag", "mode", "step_id")


def q_step_denormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).denormalised().select("guid", "entity", "storey_guid", "storey_name", "parent_guid", "type_guid", "type_name", "type_source")


def q_step_storeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).storeys().select("guid", "name", "elevation", "building_guid")


def q_step_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of edge, resolved on both ends."""
    t = tables(spark, sf_dir)
    parts = [
        t.aggregates().select(F.lit("aggregates").alias("edge"), F.col("child_guid").alias("a"), F.col("parent_guid").alias("b"), F.col("parent_kind").alias("kind")), t.contained_in().select(F.lit("contained"), "product_guid", "container_guid", "container_kind"),
        t.storey_building().select(F.lit("storey_building"), "storey_guid", "building_guid", F.lit("building")), t.voids().select(F.lit("voids"), "opening_guid", "host_guid", F.lit("product")),
    ]
    return reduce(DataFrame.union, parts)


def q_step_psets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).psets().select("guid", "pset_name", "prop_name", "value", "value_type", "source")


def q_step_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).quantities().select("guid", "qto_name", "quantity_name", "value", "quantity_type", "unit_step_id", "source")


def q_step_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).materials().select("guid", "role", "layer_index", "material_name", F.round("layer_thickness_mm", 4).alias("layer_thickness_mm"))


def q_step_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).classifications()


def q_step_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    units = t.project_units().select("quantity_type", F.col("project_unit").cast("double").alias("value"))
    return units.union(t.unit_scale().select(F.lit("scale"), F.round("unit_scale", 6)))


def q_step_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file written anew from its records, cut into small pieces when read again: records by type, and those that differ."""
    path = f"{shared_dir(spark)}/ashlar-step/again-{uuid.uuid4().hex}"
    first = durable(read_back(spark, sf_dir))
    step.write_step(first, HEAD, path)
    again = durable(step.read_step(spark, path, splitBytes="200000").select("step_id", "type", "args"))
    lost = first.select("step_id", "type", "args").exceptAll(again.select("step_id", "type", "args")).agg(F.count("*").alias("lost"))
    return again.groupBy("type").agg(F.count("*").alias("n")).where(F.col("type").isin("IFCSITE", "IFCBUILDING", "IFCWINDOW", "IFCQUANTITYAREA")).crossJoin(F.broadcast(lost))  # one row


def q_step_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A self-contained subset for three customers, written and read: records by type, and references that lead nowhere."""
    path = f"{shared_dir(spark)}/ashlar-step/subset-{uuid.uuid4().hex}"
    whole = step.entity_table(read_back(spark, sf_dir))
    step.write_step(subset.subset(whole, ["C" + str(k).zfill(21) for k in (0, 1, 5)]), HEAD, path)
    again = step.read_step(spark, path)
    refs = again.select(F.explode(step_text.all_refs(F.col("args"))).alias("step_id")).distinct()
    dangling = refs.join(again.select("step_id"), "step_id", "left_anti").agg(F.count("*").alias("dangling"))
    kinds = ("IFCPROJECT", "IFCRELAGGREGATES", "IFCRELDEFINESBYTYPE", "IFCWALLTYPE", "IFCPROPERTYSET", "IFCRELASSOCIATESMATERIAL")
    return again.where(F.col("type").isin(*kinds)).groupBy("type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(dangling))  # one row


_STEP_NAME = "concat(r_name, '''s; /* #9=X(); */ (y)')"
QUERIES = {f.__name__: f for f in (q_step_source, q_step_duplicates, q_step_header, q_step_products, q_step_denormalised, q_step_storeys, q_step_edges, q_step_psets, q_step_quantities, q_step_materials, q_step_classifications, q_step_units, q_step_rewritten, q_step_subset)}
SQL = {
    "q_step_source": """SELECT 'IFCSITE' AS type, 2 * count(*) AS n, count(*) AS n_ids, 2 * count(*) AS n_whole FROM region UNION ALL SELECT 'IFCBUILDING', count(*), count(*), count(*) FROM nation UNION ALL SELECT 'IFCBUILDINGSTOREY', count(*), count(*), count(*) FROM supplier
UNION ALL SELECT 'IFCRELVOIDSELEMENT', count(*), count(*), count(*) FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT 'IFCQUANTITYAREA', count(*), count(*), count(*) FROM orders""",
    "q_step_duplicates": f"SELECT CAST({BASE['site']} + r_regionkey AS BIGINT) AS step_id, {_STEP_NAME} AS name, CAST(r_regionkey AS BIGINT) AS place, (SELECT count(*) FROM region) AS duplicates FROM region",
    "q_step_header": "SELECT 'IFC4' AS schema_name, 'star é.ifc' AS name, '2024-01-02T03:04:05' AS time_stamp, 'ViewDefinition [CoordinationView]|a ''quoted'' part' AS description, 'A|B' AS author, 'Org' AS organization, 'pre' AS preprocessor, 'Origin; (x)' AS origin, 'auth' AS auth, false AS lossy, CAST(16 AS INTEGER) AS key_chars",
    "q_step_products": STEP_SQL + f"SELECT guid, entity, name, predefined_type, object_type, tag, {_MODES} AS mode, step_id FROM products",
    "q_step_denormalised": STEP_SQL + f"""SELECT p.guid, p.entity, s.guid AS storey_guid, s.s_name AS storey_name, coalesce(o.parent, h.holder) AS parent_guid, t.type_guid, coalesce(t.type_name, p.object_type) AS type_name, CASE WHEN t.type_guid IS NOT NULL THEN 'ifctype' WHEN p.object_type IS NOT NULL THEN 'objecttype' ELSE 'none' END AS type_source
FROM products p LEFT JOIN (SELECT {_O} AS guid, {_guid_sql("C", "o_custkey")} AS parent, o_custkey FROM orders) o ON o.guid = p.guid LEFT JOIN held h ON h.guid = coalesce(o.parent, p.guid) LEFT JOIN (SELECT {_S} AS guid, s_name FROM supplier) s ON s.guid = h.storey LEFT JOIN typed t ON t.guid = p.guid""",
    "q_step_storeys": f"SELECT {_S} AS guid, s_name AS name, s_acctbal AS elevation, {_guid_sql('N', 's_nationkey')} AS building_guid FROM supplier",
    "q_step_edges": STEP_SQL + f"""SELECT 'aggregates' AS edge, {_R} AS a, 'P000000000000000000000' AS b, 'project' AS kind FROM region UNION ALL SELECT 'aggregates', {_N}, {_guid_sql("R", "n_regionkey")}, 'site' FROM nation UNION ALL SELECT 'aggregates', {_S}, {_guid_sql("N", "s_nationkey")}, 'building' FROM supplier
UNION ALL SELECT 'aggregates', {_O}, {_guid_sql("C", "o_custkey")}, 'product' FROM orders UNION ALL SELECT 'contained', guid, holder, CASE WHEN storey IS NULL THEN 'building' ELSE 'storey' END FROM held UNION ALL SELECT 'storey_building', {_S}, {_guid_sql("N", "s_nationkey")}, 'building' FROM supplier
UNION ALL SELECT 'voids', {_O}, {_guid_sql("C", "o_custkey")}, 'product' FROM orders WHERE o_orderpriority = '2-HIGH'""",
    "q_step_psets": STEP_SQL + f""", own AS (
  SELECT {_C} AS guid, 'Balance' AS prop_name, format('{{:.2f}}', c_acctbal) AS value, 'IFCREAL' AS value_type FROM customer UNION ALL SELECT {_C}, 'Grade', 'own', 'IFCLABEL' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT {_C}, 'Range', concat(c_custkey, '..', c_custkey + 1), 'IFCINTEGER' FROM customer
  UNION ALL SELECT {_C}, 'Words', concat(c_mktsegment, ', z, y'), 'IFCLABEL' FROM customer UNION ALL SELECT {_C}, 'Table', concat('1=>', c_name, ', 2=>b'), 'IFCLABEL' FROM customer UNION ALL SELECT {_C}, 'Outer.Inner', CASE WHEN c_custkey % 2 = 0 THEN 'UNKNOWN' END, CASE WHEN c_custkey % 2 = 0 THEN 'IFCLOGICAL' ELSE 'IFCLABEL' END FROM customer)
SELECT guid, 'Pset_Common' AS pset_name, prop_name, value, value_type, 'instance' AS source FROM own UNION ALL SELECT guid, 'Pset_Common', 'LoadBearing', CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END, 'IFCBOOLEAN', 'type' FROM typed
UNION ALL SELECT guid, 'Pset_Common', 'Grade', p_type, 'IFCLABEL', 'type' FROM typed WHERE guid NOT IN (SELECT guid FROM own WHERE prop_name = 'Grade')""",
    "q_step_quantities": f"""SELECT {_O} AS guid, 'Qto_Base' AS qto_name, 'Gross' AS quantity_name, {_PLAIN("o_totalprice")} AS value, 'Area' AS quantity_type, CAST(3 AS BIGINT) AS unit_step_id, 'instance' AS source FROM orders UNION ALL SELECT {_O}, 'Qto_Base', 'Long', CAST(o_custkey AS VARCHAR), 'Length', 2, 'instance' FROM orders""",
    "q_step_materials": f"""SELECT guid, ['direct', 'list', 'layer', 'constituent', 'profile', 'unknown'][m + 1] AS role, CASE WHEN m IN (0, 5) THEN -1 ELSE i END AS layer_index, CASE WHEN m = 5 THEN NULL ELSE concat(n_name, CASE i WHEN 0 THEN ' core' ELSE ' skin' END) END AS material_name, CASE WHEN m = 2 THEN round((n_nationkey + 1.5) * 304.8, 4)::DOUBLE END AS layer_thickness_mm
FROM (SELECT {_C} AS guid, c_custkey % 6 AS m, n_name, n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey) CROSS JOIN (SELECT CAST(0 AS INTEGER) AS i UNION ALL SELECT 1) WHERE i = 0 OR m IN (1, 2, 3, 4)""",
    "q_step_classifications": f"""SELECT {_C} AS guid, concat('Sys ', r_name) AS system_name, 'v1' AS edition, concat('N', n_nationkey) AS identification, n_name AS name, 'http://x' AS location, r_name AS source FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT {_R}, concat('Sys ', r_name), 'v1', NULL, NULL, NULL, r_name FROM region""",
    "q_step_rewritten": "SELECT 'IFCSITE' AS type, 2 * count(*) AS n, CAST(0 AS BIGINT) AS lost FROM region UNION ALL SELECT 'IFCBUILDING', count(*), 0 FROM nation UNION ALL SELECT 'IFCWINDOW', count(*), 0 FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT 'IFCQUANTITYAREA', count(*), 0 FROM orders",
    "q_step_subset": f"""WITH c AS (SELECT c_custkey, c_nationkey, c_custkey % 6 AS m FROM customer WHERE c_custkey IN (0, 1, 5)), n AS (SELECT c_nationkey AS n FROM c WHERE c_custkey IN (1, 5) UNION SELECT s_nationkey FROM supplier WHERE s_suppkey = 0),
t AS (SELECT count(*) AS n FROM part WHERE p_partkey IN (0, 1, 5)), o AS (SELECT count(*) AS n FROM orders WHERE o_custkey IN (0, 1, 5) AND o_orderpriority = '2-HIGH'), k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (0, 1, 5) AND o_orderpriority = '2-HIGH')
SELECT 'IFCPROJECT' AS type, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS dangling UNION ALL SELECT 'IFCRELDEFINESBYTYPE', n, 0 FROM t UNION ALL SELECT 'IFCWALLTYPE', n, 0 FROM t UNION ALL SELECT 'IFCPROPERTYSET', n + 3, 0 FROM t
UNION ALL SELECT 'IFCRELASSOCIATESMATERIAL', count(DISTINCT c_nationkey * 6 + m), 0 FROM c UNION ALL SELECT 'IFCRELAGGREGATES', 2 + (SELECT count(DISTINCT n_regionkey) FROM nation WHERE n_nationkey IN (SELECT n FROM n)) + (SELECT count(*) FROM k), 0""",
    "q_step_units": "SELECT * FROM (VALUES ('Area', 3.0::DOUBLE), ('Volume', 4.0), ('scale', 0.3048)) t(quantity_type, value)",
}
