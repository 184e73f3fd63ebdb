"""Meshes of products from STEP records: shared shapes once, placements once, then a join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import step_text as step
from ..functions.memo import Memo, alike
from ..functions.solids import Items
from .durable import durable
from . import geometry
from .index import Tables

#: References into these types are not followed from geometry.
_OUTSIDE = "IFCOWNERHISTORY|IFCGEOMETRICREPRESENTATIONCONTEXT|IFCGEOMETRICREPRESENTATIONSUBCONTEXT|IFCSTYLEDITEM|IFCPRESENTATION.*"


def _kept(tables: Tables, name: str, table: Callable[[], DataFrame]) -> DataFrame:
    """A table that goes with the model, worked out on first use and then read again."""
    if name not in tables.made:
        tables.made[name] = durable(table())
    return tables.made[name]


def _owned(tables: Tables, roots: DataFrame) -> DataFrame:
    """(root, step_id, type, args): each root's record and all that it refers to, level by level."""
    records = tables.records.where(~F.col("type").rlike(f"^({_OUTSIDE}|IFCREL.*)$"))
    refs = _kept(tables, "_references", lambda: records.select(F.col("step_id").alias("src"), F.explode(F.array_distinct(step.all_refs(F.col("args")))).alias("dst")))
    here = durable(roots.select("root", F.col("root").alias("step_id")).distinct())
    seen = here
    while True:
        ahead = here.join(refs, here.step_id == refs.src).select("root", F.col("dst").alias("step_id")).distinct()
        here = durable(ahead.join(seen, ["root", "step_id"], "left_anti"))
        if here.isEmpty():
            break
        seen = seen.union(here)
    return seen.join(records.select("step_id", "type", "args"), "step_id").select("root", "step_id", "type", "args")


#: Meshes and matrices that a worker has made; what records refer to each other by does not matter to them.
_MESHES, _WORLDS = Memo(), Memo(4 << 20)


def _memos() -> tuple[Memo, Memo]:
    """The memos of this process. Named in a function that is sent to workers they would be sent along, new for each task."""
    from . import meshes

    return meshes._MESHES, meshes._WORLDS


#: Numbers in a batch of results.
_NUMBERS = 1 << 20


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows as batches of about _NUMBERS array elements."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 8 + sum(len(x) for x in row if isinstance(x, np.ndarray))
        if n >= _NUMBERS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def groups(batch: pa.RecordBatch, key: int = 0, rows: int = 1) -> Iterator[tuple]:
    """(key, (field, field, ..)) of each row of a batch whose column `rows` is an array of structs; fields are Arrow arrays."""
    names, each = batch.column(key), batch.column(rows)
    flat, starts = each.flatten(), each.offsets.to_numpy() - each.offsets[0].as_py()
    fields = flat.flatten()
    for i in range(batch.num_rows):
        yield names[i].as_py(), tuple(f.slice(starts[i], starts[i + 1] - starts[i]) for f in fields)


def _evaluated(owned: DataFrame, made: Callable[[int, list[tuple[int, str, str]]], Iterator[tuple]], shape: str, schema: pa.Schema) -> DataFrame:
    """Rows that made(root, records) gives for each root of owned(root, step_id, type, args)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for root, fields in groups(batch) for row in made(root, list(zip(*(f.to_pylist() for f in fields), strict=True))))
        yield from in_batches(rows, schema)

    return owned.groupBy("root").agg(F.collect_list(F.struct("step_id", "type", "args")).alias("records")).mapInArrow(run, shape)


def _decoded(records: list[tuple[int, str, str]]) -> Items:
    return Items({i: (t, a) for i, t, a in records})


def body_items(tables: Tables) -> DataFrame:
    """(product_id, guid, entity, item_id, place, reason): items of each product's body.

    The body is the first representation called Body or Facetation, else the first of all. Products without
    one keep a row with a reason and no item.
    """
    products = tables.products().select(F.col("step_id").alias("product_id"), "guid", "entity", "shape_id")
    shapes = tables.of("IFCPRODUCTDEFINITIONSHAPE").select(F.col("step_id").alias("shape_id"), F.posexplode(step.refs(F.get("f", F.lit(2)))).alias("pos", "rep"))
    reps = tables.of("IFCSHAPEREPRESENTATION").select(F.col("step_id").alias("rep"), F.lower(step.string(F.get("f", F.lit(1)))).alias("called"), step.refs(F.get("f", F.lit(3))).alias("items"))
    best = shapes.join(reps, "rep").groupBy("shape_id").agg(F.min_by("items", F.struct(~F.coalesce(F.col("called").isin("body", "facetation"), F.lit(False)), F.col("pos"))).alias("items"))
    joined = products.join(best, "shape_id", "left").select("product_id", "guid", "entity", F.posexplode_outer("items").alias("place", "item_id"), F.when(F.col("shape_id").isNull(), "no_representation").when(F.col("items").isNull() | (F.size("items") == 0), "no_body_items").alias("reason"))
    return joined


def item_meshes(tables: Tables, items: DataFrame) -> DataFrame:
    """(item_id, fragment, source, vertices, indices) of each distinct item, in its own frame."""
    owned = _owned(tables, items.where("item_id IS NOT NULL").select(F.col("item_id").alias("root")))

    def made(root: int, records: list[tuple[int, str, str]]) -> Iterator[tuple]:
        mesh = lambda: [(t, v.ravel().astype(float), f.ravel().astype(np.int64)) for t, v, f in _decoded(records).mesh(root)]
        for n, (source, v, f) in enumerate(_memos()[0].get(alike(root, records), mesh, lambda m: sum(v.nbytes + f.nbytes for _, v, f in m) + sum(map(len, (a for _, _, a in records))))):
            yield root, n, source, v, f

    schema = pa.schema([("item_id", pa.int64()), ("fragment", pa.int32()), ("source", pa.string()), ("vertices", pa.list_(pa.float64())), ("indices", pa.list_(pa.int64()))])
    return _evaluated(owned, made, "item_id long, fragment int, source string, vertices array<double>, indices array<bigint>", schema)


def placements(tables: Tables) -> DataFrame:
    """(placement_id, matrix): the world matrix, by rows, of each placement that a product uses."""
    return _kept(tables, "_placements", lambda: _placements(tables))


def _placements(tables: Tables) -> DataFrame:
    roots = tables.products().where("placement_id IS NOT NULL").select(F.col("placement_id").alias("root"))

    def made(root: int, records: list[tuple[int, str, str]]) -> Iterator[tuple]:
        yield root, _memos()[1].get(alike(root, records), lambda: _decoded(records).world(f"#{root}").ravel(), lambda m: m.nbytes + sum(map(len, (a for _, _, a in records))))

    schema = pa.schema([("placement_id", pa.int64()), ("matrix", pa.list_(pa.float64()))])
    return _evaluated(_owned(tables, roots), made, "placement_id long, matrix array<double>", schema)


def product_meshes(tables: Tables, space: str = "world", guids: list[str] | None = None) -> DataFrame:
    """(guid, entity, place, item_id, fragment, source, vertices, indices) of every fragment of every product.

    space is world, local (the product's own frame) or item. With guids only those products' items are read and meshed. Matrices are applied in the JVM, row by row.
    """
    if guids is not None:
        items = durable(body_items(tables).where(F.col("guid").isin(*guids)))
        made = item_meshes(tables, items)
    else:
        items = _kept(tables, "_body_items", lambda: body_items(tables))
        made = _kept(tables, "_item_meshes", lambda: item_meshes(tables, items))
    shaped = items.where("item_id IS NOT NULL").join(made, "item_id")
    if space in ("item", "local"):
        return shaped.select("guid", "entity", "place", "item_id", "fragment", "source", "vertices", "indices")
    if space != "world":
        raise ValueError(f"unknown space {space!r}")
    at = tables.products().select("guid", "placement_id").join(placements(tables), "placement_id", "left").select("guid", "matrix")
    one = F.coalesce("matrix", F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)]))
    n = (F.size("vertices") / 3).cast("int")
    v = lambda i, k: F.get("vertices", i * 3 + k)
    point = lambda i: F.array(*[F.get("m", F.lit(4 * r)) * v(i, 0) + F.get("m", F.lit(4 * r + 1)) * v(i, 1) + F.get("m", F.lit(4 * r + 2)) * v(i, 2) + F.get("m", F.lit(4 * r + 3)) for r in range(3)])
    joined = shaped.join(at, "guid", "left").withColumn("m", one)
    put = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), point))).otherwise(F.col("vertices"))
    return joined.select("guid", "entity", "place", "item_id", "fragment", "source", put.alias("vertices"), "indices")


def merged(fragments: DataFrame) -> DataFrame:
    """(guid, vertices, indices, segments): one mesh a product, from its fragments in order of place, fragment and source.

    segments holds (segment_index, source, index_start, triangle_count) of each part. Offsets are running sums over
    the parts, so a product of many parts costs no more than their length.
    """
    n = (F.size("vertices") / 3).cast("long")
    order = [c for c in ("place", "fragment", "source", "item_id") if c in fragments.columns]
    before = Window.partitionBy("guid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = lambda size: F.coalesce(F.sum(size).over(before), F.lit(0))
    rows = fragments.withColumns({"base": first(n), "index_start": first(F.size("indices").cast("long")), "segment_index": F.row_number().over(Window.partitionBy("guid").orderBy(*order)) - 1})
    part = F.struct("segment_index", "source", "index_start", (F.size("indices") / 3).cast("long").alias("triangle_count"), "vertices", F.transform("indices", lambda i: i + F.col("base")).alias("indices"))
    rows = rows.groupBy("guid").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return rows.select(
        "guid", F.flatten(F.transform("parts", lambda p: p["vertices"])).alias("vertices"), F.flatten(F.transform("parts", lambda p: p["indices"])).alias("indices"),
        F.transform("parts", lambda p: F.struct(p["segment_index"].alias("segment_index"), p["source"].alias("source"), p["index_start"].alias("index_start"), p["triangle_count"].alias("triangle_count"))).alias("segments"),
    )


def segments(whole: DataFrame) -> DataFrame:
    """(guid, segment_index, source, index_start, triangle_count) of merged() meshes."""
    return whole.select("guid", F.explode("segments").alias("s")).select("guid", "s.segment_index", "s.source", "s.index_start", "s.triangle_count")


def sized_fragments(tables: Tables) -> DataFrame:
    """(guid, place, item_id, fragment, source, n_indices): product_meshes() in a frame of their own with sizes in place of arrays."""
    items = _kept(tables, "_body_items", lambda: body_items(tables))
    made = _kept(tables, "_item_meshes", lambda: item_meshes(tables, items)).select("item_id", "fragment", "source", F.size("indices").alias("n_indices"))
    return items.where("item_id IS NOT NULL").join(made, "item_id").select("guid", "place", "item_id", "fragment", "source", "n_indices")


def segments_of(sized: DataFrame) -> DataFrame:
    """segments() of the meshes that merged() would make of sized_fragments(); nothing is merged and no array moves."""
    order = ("place", "fragment", "source", "item_id")
    ranked = Window.partitionBy("guid").orderBy(*order)
    start = F.coalesce(F.sum(F.col("n_indices").cast("long")).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.select("guid", (F.row_number().over(ranked) - 1).alias("segment_index"), "source", start.cast("long").alias("index_start"), (F.col("n_indices") / 3).cast("long").alias("triangle_count"))


def scaled(fragments: DataFrame, by: float) -> DataFrame:
    """fragments with every coordinate multiplied."""
    return fragments.withColumn("vertices", F.transform("vertices", lambda x: x * by))


def by_source(fragments: DataFrame) -> DataFrame:
    """(source, fragments, products, triangles) of each provenance."""
    return fragments.groupBy("source").agg(F.count("*").alias("fragments"), F.count_distinct("guid").alias("products"), F.sum((F.size("indices") / 3).cast("long")).alias("triangles"))


def drift_report(tables: Tables, fragments: DataFrame) -> DataFrame:
    """Boxes of merged world meshes with their distance from the product's placement; see geometry.drift()."""
    at = tables.products().select("guid", "placement_id").join(placements(tables), "placement_id").select("guid", *[F.get("matrix", F.lit(4 * i + 3)).alias(f"placement_{x}") for i, x in enumerate("xyz")])
    return geometry.drift(geometry.bounds(merged(fragments)).join(at, "guid"))


def obj_text(meshes: DataFrame) -> DataFrame:
    """(guid, value): each mesh as a group of Wavefront OBJ text with indices of its own, from the end."""
    n = (F.size("vertices") / 3).cast("int")
    v = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("v "), F.array_join(F.transform(F.slice("vertices", i * 3 + 1, 3), lambda x: F.format_string("%.6f", x)), " ")))
    f = F.transform(F.sequence(F.lit(0), (F.size("indices") / 3).cast("int") - 1), lambda t: F.concat(F.lit("f "), F.array_join(F.transform(F.slice("indices", t * 3 + 1, 3), lambda x: (x - n).cast("string")), " ")))
    return meshes.where(F.size("indices") >= 3).select("guid", F.concat_ws("\n", F.concat(F.lit("g "), "guid"), F.array_join(v, "\n"), F.array_join(f, "\n")).alias("value"))
