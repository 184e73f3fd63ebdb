"""From STEP records to the canonical tables: products, storeys, edges, types, units and facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes
from ..functions import step_text as step
from ..functions.units import SI_POWERS
from . import facts, graph
from .durable import once_each

# Classes and kinds of the public schemas.
#: Products whose predefined type IFC2X3 does not have.
NO_PREDEFINED_2X3 = ("IFCWALL", "IFCWALLSTANDARDCASE", "IFCBEAM", "IFCCOLUMN", "IFCPLATE", "IFCMEMBER")
#: Doors and windows name other enumerations after theirs.
OPENING_FILLERS = ("IFCDOOR", "IFCWINDOW", "IFCDOORSTANDARDCASE", "IFCWINDOWSTANDARDCASE")
SPATIAL = {"IFCPROJECT": "project", "IFCSITE": "site", "IFCBUILDING": "building", "IFCBUILDINGSTOREY": "storey", "IFCSPACE": "space"}
SIMPLE_VALUES = "IFCPROPERTYSINGLEVALUE IFCPROPERTYENUMERATEDVALUE IFCPROPERTYLISTVALUE IFCPROPERTYBOUNDEDVALUE IFCPROPERTYTABLEVALUE".split()
QUANTITY_KINDS = {"IFCQUANTITYLENGTH": "Length", "IFCQUANTITYAREA": "Area", "IFCQUANTITYVOLUME": "Volume", "IFCQUANTITYCOUNT": "Count", "IFCQUANTITYWEIGHT": "Weight", "IFCQUANTITYTIME": "Time"}
#: Relationships that assign facts to the items of their fifth field, and records that facts are not looked for under.
ASSIGNING = ("IFCRELDEFINESBYPROPERTIES", "IFCRELDEFINESBYTYPE", "IFCRELASSOCIATESMATERIAL", "IFCRELASSOCIATESCLASSIFICATION")
NO_FACTS = ("IFCOWNERHISTORY", "IFCREPRESENTATIONMAP")
#: Records of one guid beyond which an item's facts are looked up in the tables of all items.
MANY = 100
UNIT_KINDS = {"LENGTHUNIT": "Length", "AREAUNIT": "Area", "VOLUMEUNIT": "Volume", "MASSUNIT": "Weight", "TIMEUNIT": "Time"}


def _f(i: int) -> Column:
    return F.get("f", F.lit(i))


def dealt(rows: DataFrame, many: Column, name: str, *one: Column | str, place: str | None = None) -> DataFrame:
    """rows' columns `one` beside each element of the list `many`, called name, with its place if that has a name.

    The list is made before it is dealt out. In one step each element would be written with a copy of all of the record's
    fields, the list's own text among them, which grows with the square of a list's length.
    """
    listed = rows.select(*one, many.alias("_many"))
    each = F.posexplode("_many").alias(place, name) if place else F.explode("_many").alias(name)
    return listed.select(*listed.columns[:-1], each)


def kept(f: Callable) -> Callable:
    """A table worked out on first use and then read from its checkpoint, so plans stay short."""

    @wraps(f)
    def table(self: Tables) -> DataFrame:
        if f.__name__ not in self.made:
            self.made[f.__name__] = graph.durable(f(self))
        return self.made[f.__name__]

    return table


def product_rows(records: DataFrame, schema: str) -> DataFrame:
    """(.., step_id, ord, guid, entity, name, predefined_type, object_type, tag, placement_id, shape_id, mode) of the products among records(step_id, ord, type, args, ..).

    Each product is one record, so records of any number of files of a schema may come together; further columns stay.
    """
    rows = records.where(F.col("type").isin(*classes.product_names(schema))).withColumn("f", step.split_fields("args"))
    picked = step.last_enum(F.col("f"))
    if classes.resolve_schema(schema) == "IFC2X3":
        predefined = F.when(F.col("type").isin(*NO_PREDEFINED_2X3), None).otherwise(picked)
    else:
        third = step.enum(F.get("f", F.size("f") - 3))
        predefined = F.when(F.col("type").isin(*OPENING_FILLERS) & (F.size("f") >= 11), third).otherwise(picked)
    more = [c for c in records.columns if c not in ("step_id", "ord", "type", "args", "raw")]
    out = rows.select(*more, "step_id", "ord", step.string(_f(0)).alias("guid"), classes.canonical(F.col("type")).alias("entity"), step.string(_f(2)).alias("name"), predefined.alias("predefined_type"), step.string(_f(4)).alias("object_type"), step.string(_f(7)).alias("tag"), step.ref(_f(5)).alias("placement_id"), step.ref(_f(6)).alias("shape_id"))
    return out.withColumn("mode", classes.mode_column(F.col("entity"), schema))


class Tables:
    """Tables over records(file_id, ord, step_id, type, args, raw) of one model, each worked out on first use.

    The schema decides on which records are products, their modes and predefined types. Records of one step_id count once, the last value
    at the first place.
    """

    def __init__(self, records: DataFrame, schema: str = "IFC4"):
        self.spark, self.schema = records.sparkSession, schema.upper()
        self.made: dict[str, DataFrame] = {}
        self.records = once_each(graph.durable(records.select("ord", "step_id", F.upper("type").alias("type"), "args")), "step_id")
        self.all_records = records

    def of(self, *types: str) -> DataFrame:
        """Records of the given types with their fields split; the filter comes before the split."""
        return self.records.where(F.col("type").isin(*types)).withColumn("f", step.split_fields("args"))

    @kept
    def guids(self) -> DataFrame:
        """(step_id, guid) of every record whose first field is a 22-character string."""
        first = F.regexp_extract("args", r"^\s*'([^']{22})'", 1)
        return self.records.where(F.col("type").startswith("IFC") & (first != "")).select("step_id", first.alias("guid"))

    @kept
    def products(self) -> DataFrame:
        return product_rows(self.records, self.schema)

    @kept
    def storeys(self) -> DataFrame:
        rows = self.of("IFCBUILDINGSTOREY").select("step_id", step.string(_f(0)).alias("guid"), step.string(_f(2)).alias("name"), step.last_number(F.col("f")).alias("elevation"))
        return rows.join(self.storey_building().withColumnRenamed("storey_guid", "guid"), "guid", "left")

    @kept
    def kinds(self) -> DataFrame:
        """(guid, step_id, kind): project, site, building, storey, space or product."""
        spatial = self.of(*SPATIAL).select("step_id", step.string(_f(0)).alias("guid"), F.element_at(F.create_map(*[F.lit(x) for kv in SPATIAL.items() for x in kv]), F.col("type")).alias("kind"))
        rest = self.products().where("entity <> 'IfcSpace'").select("step_id", "guid", F.lit("product").alias("kind"))
        return spatial.unionByName(rest)

    def _edges(self, name: str, one: int, many: int) -> DataFrame:
        """(ord, one_id, many_id) of a relationship's single and listed side."""
        return dealt(self.of(name), step.refs(_f(many)), "many_id", "ord", step.ref(_f(one)).alias("one_id"))

    def _resolved(self, edges: DataFrame) -> DataFrame:
        k = self.kinds()
        one = k.select(F.col("step_id").alias("one_id"), F.col("guid").alias("one_guid"), F.col("kind").alias("one_kind"))
        many = k.select(F.col("step_id").alias("many_id"), F.col("guid").alias("many_guid"), F.col("kind").alias("many_kind"))
        return edges.join(one, "one_id").join(many, "many_id")

    @kept
    def _aggregates(self) -> DataFrame:
        return self._resolved(self._edges("IFCRELAGGREGATES", 4, 5)).select(F.col("many_guid").alias("child_guid"), F.col("one_guid").alias("parent_guid"), F.col("one_kind").alias("parent_kind"), "ord", F.col("many_kind").alias("child_kind"))

    def aggregate_edges(self) -> DataFrame:
        """aggregates() with ord, the place of the relationship in the file."""
        return self._aggregates().drop("child_kind")

    def aggregates(self) -> DataFrame:
        return self.aggregate_edges().drop("ord")

    @kept
    def containment_edges(self) -> DataFrame:
        """contained_in() with ord, the place of the relationship in the file."""
        rows = self._resolved(self._edges("IFCRELCONTAINEDINSPATIALSTRUCTURE", 5, 4)).where("one_kind <> 'product' AND many_kind IN ('product', 'space')")
        return rows.select(F.col("many_guid").alias("product_guid"), F.col("one_guid").alias("container_guid"), F.col("one_kind").alias("container_kind"), "ord")

    def contained_in(self) -> DataFrame:
        return self.containment_edges().drop("ord")

    def storey_building(self) -> DataFrame:
        rows = self._aggregates().where("parent_kind = 'building' AND child_kind = 'storey'")
        return rows.select(F.col("child_guid").alias("storey_guid"), F.col("parent_guid").alias("building_guid"))

    @kept
    def parent_of(self) -> DataFrame:
        """graph.parents() of this model's edges."""
        return graph.parents(self.aggregate_edges(), self.containment_edges())

    @kept
    def voids(self) -> DataFrame:
        pairs = self.of("IFCRELVOIDSELEMENT").select(step.ref(_f(4)).alias("host"), step.ref(_f(5)).alias("opening"))
        p = self.products().select("step_id", "guid")
        return pairs.join(p.select(F.col("step_id").alias("host"), F.col("guid").alias("host_guid")), "host").join(p.select(F.col("step_id").alias("opening"), F.col("guid").alias("opening_guid")), "opening").select("opening_guid", "host_guid")

    @kept
    def types(self) -> DataFrame:
        named = self.records.where(F.col("type").rlike("^IFC.*(TYPE|STYLE)$|^IFCTYPE(OBJECT|PRODUCT)$") & ~F.col("type").startswith("IFCREL") & F.col("args").rlike(r"^\s*'[^']{22}'")).withColumn("f", step.split_fields("args"))
        return named.select("step_id", step.string(_f(0)).alias("guid"), classes.canonical(F.col("type")).alias("entity"), step.string(_f(2)).alias("name"), step.refs(_f(5)).alias("sets"))

    @kept
    def type_of(self) -> DataFrame:
        """(guid, type_guid, type_name): each item's type, the last relationship winning."""
        pairs = dealt(self.of("IFCRELDEFINESBYTYPE"), step.refs(_f(4)), "item", "ord", step.ref(_f(5)).alias("type_id")).groupBy("item").agg(F.max_by("type_id", "ord").alias("type_id"))
        t = self.types().select(F.col("step_id").alias("type_id"), F.col("guid").alias("type_guid"), F.col("name").alias("type_name"))
        return pairs.join(self.guids().select(F.col("step_id").alias("item"), "guid"), "item").join(t, "type_id").select("guid", "type_guid", "type_name")

    @kept
    def denormalised(self) -> DataFrame:
        """products with storey, parent and type columns, one row a guid."""
        p = graph.last_by(self.products(), ["guid"], [F.desc("ord")])
        up = self.parent_of()
        at = graph.storey_of(p, self.aggregate_edges(), self.containment_edges(), self.storeys())
        named = self.storeys().select(F.col("guid").alias("storey_guid"), F.col("name").alias("storey_name"))
        out = p.join(at, "guid", "left").join(named, "storey_guid", "left").join(up, "guid", "left").join(self.type_of(), "guid", "left")
        source = F.when(F.col("type_guid").isNotNull(), "ifctype").when(F.col("object_type").isNotNull(), "objecttype").otherwise("none")
        return out.withColumn("type_source", source).withColumn("type_name", F.coalesce("type_name", "object_type")).select("guid", "entity", "name", "predefined_type", "object_type", "tag", "storey_guid", "storey_name", "parent_guid", "mode", "step_id", "type_guid", "type_name", "type_source")

    # --- facts

    def about(self, guid: str) -> Tables:
        """The tables of the records that state one item's facts, in which psets, quantities, materials and classifications are worked out for it alone.

        These are the relationships that name the item, what they assign, other types of the same guid, all that these refer to, and the units.
        """
        found = self.guids().where(F.col("guid") == guid).select("step_id").limit(MANY + 1).collect()
        if len(found) > MANY:
            return self
        names = "|".join(str(r[0]) for r in found) or "-"
        rels = self.of(*ASSIGNING).where(F.col("args").rlike(f"#({names})(?![0-9])"))
        here = graph.durable(rels.select(F.explode(step.refs(_f(5))).alias("step_id")).distinct())
        same = here.join(self.guids(), "step_id").select("guid").join(self.guids(), "guid").select("step_id")
        here = seen = graph.durable(here.union(same).distinct())
        while not here.isEmpty():
            refs = self.records.where(~F.col("type").isin(*NO_FACTS)).join(here, "step_id", "left_semi").select(F.explode(step.all_refs(F.col("args"))).alias("step_id")).distinct()
            here = graph.durable(refs.join(seen, "step_id", "left_anti"))
            seen = seen.union(here)
        ids = graph.durable(seen.union(rels.select("step_id")).union(self.guids().where(F.col("guid") == guid).select("step_id")).distinct())
        units = F.col("type").isin("IFCUNITASSIGNMENT", "IFCSIUNIT", "IFCMEASUREWITHUNIT", "IFCCONVERSIONBASEDUNIT")
        rows = self.records.where(~units).join(ids, "step_id", "left_semi").unionByName(self.records.where(units))
        return Tables(rows, self.schema)

    def _definitions(self) -> DataFrame:
        """(guid, set_id, source) of property and quantity sets on items and, through types, on their items."""
        sets = dealt(self.of("IFCRELDEFINESBYPROPERTIES"), step.refs(_f(5)), "set_id", step.refs(_f(4)).alias("items"))
        own = sets.select(F.explode("items").alias("item"), "set_id")
        return own.join(self.guids().select(F.col("step_id").alias("item"), "guid"), "item").select("guid", "set_id")

    def _type_definitions(self) -> DataFrame:
        return self.types().select("guid", F.explode("sets").alias("set_id"))

    @kept
    def _properties(self) -> DataFrame:
        """(prop_id, path, value, value_type): leaves under each property, complex ones by a dotted path."""
        values = self.of(*SIMPLE_VALUES, "IFCCOMPLEXPROPERTY")
        single, single_type = step.typed(_f(2))
        upper, upper_type = step.typed(_f(2))
        lower, _ = step.typed(_f(3))
        at, _ = step.typed(_f(5))
        listed = step.split_fields(F.regexp_extract(_f(2), r"(?s)^\((.*)\)$", 1))
        marks = step.split_fields(F.regexp_extract(_f(3), r"(?s)^\((.*)\)$", 1))
        rows = values.withColumn("items", F.when(F.col("type").isin("IFCPROPERTYENUMERATEDVALUE", "IFCPROPERTYLISTVALUE", "IFCPROPERTYTABLEVALUE"), listed)).withColumn("marks", F.when(F.col("type") == "IFCPROPERTYTABLEVALUE", marks))
        rows = rows.withColumn("item_values", F.transform("items", lambda x: step_value(x)[0])).withColumn("mark_values", F.transform("marks", lambda x: step_value(x)[0]))
        kind_of = lambda c: F.element_at(F.filter(F.transform(c, lambda x: step_value(x)[1]), lambda t: t.isNotNull()), 1)
        value = (
            F.when(F.col("type") == "IFCPROPERTYSINGLEVALUE", single).when(F.col("type") == "IFCPROPERTYBOUNDEDVALUE", facts.format_bounded(lower, upper, at))
            .when(F.col("type") == "IFCPROPERTYTABLEVALUE", facts.join_table(F.col("item_values"), F.col("mark_values"))).when(F.col("type") != "IFCCOMPLEXPROPERTY", facts.join_values(F.col("item_values")))
        )
        kind = F.when(F.col("type") == "IFCPROPERTYSINGLEVALUE", single_type).when(F.col("type") == "IFCPROPERTYBOUNDEDVALUE", upper_type).when(F.col("type") == "IFCPROPERTYTABLEVALUE", kind_of(F.col("marks"))).when(F.col("type") != "IFCCOMPLEXPROPERTY", kind_of(F.col("items")))
        return rows.select(F.col("step_id").alias("prop_id"), step.string(_f(0)).alias("name"), F.when(F.col("type") == "IFCCOMPLEXPROPERTY", step.refs(_f(3))).alias("parts"), value.alias("value"), kind.alias("value_type"))

    def _leaves(self, nodes: DataFrame, limit: int = 8) -> DataFrame:
        """(root, path, leaf_id): leaves of nodes(id, name, parts) reached from each node, names joined by dots."""
        here = nodes.select(F.col("id").alias("root"), "id", F.col("name").alias("path"), "parts")
        found = [here.where("parts IS NULL").select("root", "path", F.col("id").alias("leaf_id"))]
        for _ in range(limit):
            below = here.where("parts IS NOT NULL").select("root", "path", F.explode("parts").alias("child"))
            here = graph.durable(below.join(nodes.select(F.col("id").alias("child"), "name", "parts"), "child").select("root", F.col("child").alias("id"), F.concat("path", F.lit("."), "name").alias("path"), "parts"))
            if here.isEmpty():
                break
            found.append(here.where("parts IS NULL").select("root", "path", F.col("id").alias("leaf_id")))
        return reduce(DataFrame.union, found)

    def _set_facts(self, definitions: DataFrame) -> DataFrame:
        props = self._properties()
        leaves = self._leaves(props.select(F.col("prop_id").alias("id"), "name", "parts"))
        sets = dealt(self.of("IFCPROPERTYSET"), step.refs(_f(4)), "root", F.col("step_id").alias("set_id"), step.string(_f(2)).alias("pset_name"))
        values = props.select(F.col("prop_id").alias("leaf_id"), "value", F.col("value_type"))
        return definitions.join(sets, "set_id").join(leaves, "root").join(values, "leaf_id").select("guid", "pset_name", F.col("path").alias("prop_name"), "value", F.col("value_type"))

    @kept
    def psets(self) -> DataFrame:
        own = self._set_facts(self._definitions()).withColumn("source", F.lit("instance"))
        of_types = self._set_facts(self._type_definitions()).withColumn("source", F.lit("type"))
        return facts.inherited(own, of_types, self.type_of(), ["pset_name", "prop_name"])

    def _quantity_facts(self, definitions: DataFrame) -> DataFrame:
        kinds = F.create_map(*[F.lit(x) for kv in QUANTITY_KINDS.items() for x in kv])
        rows = self.of(*QUANTITY_KINDS, "IFCPHYSICALCOMPLEXQUANTITY")
        nested = F.col("type") == "IFCPHYSICALCOMPLEXQUANTITY"
        q = rows.select(F.col("step_id").alias("id"), step.string(_f(0)).alias("name"), F.when(nested, step.refs(_f(2))).alias("parts"), F.element_at(kinds, F.col("type")).alias("quantity_type"), F.when(~nested, step.ref(_f(2))).alias("unit_step_id"), F.when(~nested, facts.format_number(step.number(_f(3)))).alias("value"))
        sets = dealt(self.of("IFCELEMENTQUANTITY"), step.refs(_f(5)), "root", F.col("step_id").alias("set_id"), step.string(_f(2)).alias("qto_name"))
        leaf = q.select(F.col("id").alias("leaf_id"), "quantity_type", "unit_step_id", "value")
        out = definitions.join(sets, "set_id").join(self._leaves(q.select("id", "name", "parts")), "root").join(leaf, "leaf_id")
        return out.select("guid", "qto_name", F.col("path").alias("quantity_name"), "value", "quantity_type", "unit_step_id")

    @kept
    def quantities(self) -> DataFrame:
        own = self._quantity_facts(self._definitions()).withColumn("source", F.lit("instance"))
        of_types = self._quantity_facts(self._type_definitions()).withColumn("source", F.lit("type"))
        return facts.unit_fallback(facts.inherited(own, of_types, self.type_of(), ["qto_name", "quantity_name"]), self.project_units())

    def _assigned_units(self) -> DataFrame:
        return self.of("IFCUNITASSIGNMENT").select("ord", F.posexplode(step.refs(_f(0))).alias("place", "unit_id"))

    @kept
    def project_units(self) -> DataFrame:
        """(quantity_type, project_unit): the first assigned SI unit of each kind."""
        kinds = F.create_map(*[F.lit(x) for kv in UNIT_KINDS.items() for x in kv])
        si = self.of("IFCSIUNIT").select(F.col("step_id").alias("unit_id"), F.element_at(kinds, step.enum(_f(1))).alias("quantity_type")).where("quantity_type IS NOT NULL")
        return self._assigned_units().join(si, "unit_id").groupBy("quantity_type").agg(F.min_by("unit_id", F.struct("ord", "place")).alias("project_unit"))

    @kept
    def unit_scale(self) -> DataFrame:
        """One row, unit_scale: metres to the length unit of the first unit assignment, null if unresolved."""
        powers = F.create_map(*[x for k, v in SI_POWERS.items() for x in (F.lit(k), F.lit(10.0**v))])
        si = self.of("IFCSIUNIT").select(F.col("step_id").alias("unit_id"), step.enum(_f(1)).alias("kind"), F.when(step.enum(_f(2)).isNull(), 1.0).otherwise(F.element_at(powers, step.enum(_f(2)))).alias("scale"))
        measure = self.of("IFCMEASUREWITHUNIT").select(F.col("step_id").alias("measure_id"), step.number(F.regexp_replace(_f(0), r"^[A-Z0-9_]+\((.*)\)$", "$1")).alias("factor"), step.ref(_f(1)).alias("base_id"))
        conversion = self.of("IFCCONVERSIONBASEDUNIT").select(F.col("step_id").alias("unit_id"), step.enum(_f(1)).alias("kind"), step.ref(_f(3)).alias("measure_id"))
        chained = conversion.join(measure, "measure_id", "left").join(si.select(F.col("unit_id").alias("base_id"), "scale"), "base_id", "left").select("unit_id", "kind", (F.col("factor") * F.col("scale")).alias("scale"))
        first = self._assigned_units().withColumn("first", F.min("ord").over(Window.partitionBy(F.lit(0)))).where("ord = first")
        lengths = first.join(si.unionByName(chained), "unit_id").where("kind = 'LENGTHUNIT'")
        return lengths.agg(F.min_by("scale", "place").alias("unit_scale"))

    @kept
    def materials(self) -> DataFrame:
        used = dealt(self.of("IFCRELASSOCIATESMATERIAL"), step.refs(_f(4)), "item", step.ref(_f(5)).alias("container")).join(self.guids().select(F.col("step_id").alias("item"), "guid"), "item").select("guid", "container")
        usage = self.of("IFCMATERIALLAYERSETUSAGE", "IFCMATERIALPROFILESETUSAGE").select(F.col("step_id").alias("container"), step.ref(_f(0)).alias("inner"))
        used = used.join(usage, "container", "left").select("guid", F.coalesce("inner", "container").alias("container"))
        material = self.of("IFCMATERIAL").select(F.col("step_id").alias("material_id"), step.string(_f(0)).alias("material_name"))
        scale = F.broadcast(self.unit_scale())  # one row
        shape = {"layer": ("IFCMATERIALLAYERSET", 0, "IFCMATERIALLAYER", 0), "constituent": ("IFCMATERIALCONSTITUENTSET", 2, "IFCMATERIALCONSTITUENT", 2), "profile": ("IFCMATERIALPROFILESET", 2, "IFCMATERIALPROFILE", 2)}
        parts = []
        for role, (set_type, members, part_type, at) in shape.items():
            thick = step.number(_f(1)) if role == "layer" else F.lit(None).cast("double")
            part = self.of(part_type).select(F.col("step_id").alias("part_id"), step.ref(_f(at)).alias("material_id"), thick.alias("thickness"))
            listed = dealt(self.of(set_type), step.refs(_f(members)), "part_id", F.col("step_id").alias("container"), place="layer_index")
            parts.append(listed.join(part, "part_id").join(material, "material_id", "left").select("container", F.lit(role).alias("role"), "layer_index", "material_name", "thickness"))
        listed = dealt(self.of("IFCMATERIALLIST"), step.refs(_f(0)), "material_id", F.col("step_id").alias("container"), place="layer_index")
        parts.append(listed.join(material, "material_id", "left").select("container", F.lit("list").alias("role"), "layer_index", "material_name", F.lit(None).cast("double").alias("thickness")))
        members = reduce(DataFrame.union, parts).crossJoin(scale).withColumn("thickness_mm", F.col("thickness") * F.coalesce("unit_scale", F.lit(1.0)) * 1000)
        return facts.materials(used, material.select(F.col("material_id").alias("container"), "material_name"), members)

    @kept
    def classifications(self) -> DataFrame:
        used = dealt(self.of("IFCRELASSOCIATESCLASSIFICATION"), step.refs(_f(4)), "item", step.ref(_f(5)).alias("id")).join(self.guids().select(F.col("step_id").alias("item"), "guid"), "item").select("guid", "id")
        systems = self.of("IFCCLASSIFICATION").select(F.col("step_id").alias("system"), step.string(_f(3)).alias("system_name"), step.string(_f(1)).alias("edition"), step.string(_f(0)).alias("source"))
        refs = self.of("IFCCLASSIFICATIONREFERENCE").select(F.col("step_id").alias("id"), step.string(_f(0)).alias("location"), step.string(_f(1)).alias("identification"), step.string(_f(2)).alias("name"), step.ref(_f(3)).alias("next"))
        ends = graph.chain_end(refs.select("id", "next"), systems.select(F.col("system").alias("id"))).select("id", F.col("end_id").alias("system"))
        null = F.lit(None).cast("string")
        through = used.join(refs, "id").join(ends, "id", "left").join(systems, "system", "left")
        direct = used.withColumnRenamed("id", "system").join(systems, "system").select("guid", "system_name", "edition", null.alias("identification"), null.alias("name"), null.alias("location"), "source")
        return through.select("guid", "system_name", "edition", "identification", "name", "location", "source").unionByName(direct)


def step_value(x: Column) -> tuple[Column, Column]:
    """typed() without the Arrow decoder, for use inside array functions: quotes are undoubled, escapes stay."""
    name = F.regexp_extract(x, r"(?s)^\s*([A-Z][A-Z0-9_]*)\s*\((.*)\)\s*$", 1)
    inner = F.when(name != "", F.trim(F.regexp_extract(x, r"(?s)^\s*([A-Z][A-Z0-9_]*)\s*\((.*)\)\s*$", 2))).otherwise(x)
    text = F.when(inner.startswith("'"), F.replace(F.substr(inner, F.lit(2), F.char_length(inner) - 2), F.lit("''"), F.lit("'")))
    flag = F.when(inner == ".T.", "True").when(inner == ".F.", "False").when((inner == ".U.") & (name == "IFCLOGICAL"), "UNKNOWN")
    value = F.when(inner.isin("$", "*", ""), None).otherwise(F.coalesce(flag, text, step.enum(inner), inner))
    return value, F.nullif(name, F.lit(""))
