"""Putting a mesh in place of a product's body in a STEP file, and taking out what nothing else needs any more."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import step_text as step
from .durable import durable
from .subset import orphans, resolve


def real_text(x: float) -> str:
    """A number as STEP text: always with a decimal point."""
    text = repr(float(x))
    mantissa, e, exponent = text.partition("e")
    return (mantissa if "." in mantissa else mantissa + ".") + (f"E{exponent}" if e else "")


def body_records(first: int, vertices: Sequence[Sequence[float]], triangles: Sequence[Sequence[int]], tessellated: bool) -> list[tuple[int, str, str]]:
    """(step_id, type, args) of a mesh from a free step id on; the item is the last. Schemas without tessellation get a faceted solid."""
    point = lambda p: "(" + ",".join(map(real_text, p)) + ")"
    if tessellated:
        faces = ",".join("(" + ",".join(str(i + 1) for i in t) + ")" for t in triangles)
        return [(first, "IFCCARTESIANPOINTLIST3D", "(" + ",".join(map(point, vertices)) + ")"), (first + 1, "IFCTRIANGULATEDFACESET", f"#{first},$,.T.,({faces}),$")]
    out = [(first + i, "IFCCARTESIANPOINT", point(p)) for i, p in enumerate(vertices)]
    at, faces = first + len(vertices), []
    for t in triangles:
        out += [(at, "IFCPOLYLOOP", "(" + ",".join(f"#{first + i}" for i in t) + ")"), (at + 1, "IFCFACEOUTERBOUND", f"#{at},.T."), (at + 2, "IFCFACE", f"(#{at + 1})")]
        faces.append(f"#{at + 2}")
        at += 3
    return [*out, (at, "IFCCLOSEDSHELL", "(" + ",".join(faces) + ")"), (at + 1, "IFCFACETEDBREP", f"#{at}")]


def with_overrides(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """records(step_id, args, raw, ..) with args and raw of overrides(step_id, args, raw) where it has the step id."""
    new = overrides.select("step_id", F.col("args").alias("_args"), F.col("raw").alias("_raw"))
    return records.join(F.broadcast(new), "step_id", "left").withColumns({"args": F.coalesce("_args", "args"), "raw": F.coalesce("_raw", "raw")}).drop("_args", "_raw").select(*records.columns)  # overrides are the caller's few


def hotswap(records: DataFrame, guid: str, vertices: Sequence[Sequence[float]], triangles: Sequence[Sequence[int]], schema: str = "IFC4") -> tuple[DataFrame, dict[str, int]]:
    """records(file_id, ord, step_id, type, args, raw) with the product's body replaced, and what was done.

    The body is the representation called Body, else the first; its items are replaced by the mesh, in
    the product's own frame and file units, and every record that only the old items needed is taken out, level by level.
    Shared shapes stay. Unknown ids, empty meshes and indices out of range raise.
    """
    if not len(vertices) or not len(triangles):
        raise ValueError("the mesh is empty")
    if any(not 0 <= i < len(vertices) for t in triangles for i in t):
        raise ValueError("a triangle names a vertex that does not exist")
    spark = records.sparkSession
    product = resolve(records, [guid]).first()[0]
    fields = lambda ids, *kinds: records.where(F.col("step_id").isin(*ids) & F.col("type").isin(*kinds) if kinds else F.col("step_id").isin(*ids)).withColumn("f", step.split_fields("args"))
    shape_id = fields([product]).select(step.ref(F.get("f", F.lit(6)))).first()[0]
    definition = fields([shape_id], "IFCPRODUCTDEFINITIONSHAPE").select(step.refs(F.get("f", F.lit(2)))).first() if shape_id is not None else None
    if definition is None:
        raise ValueError(f"{guid} has no representation")
    reps = fields(definition[0], "IFCSHAPEREPRESENTATION").select("step_id", "f").collect()
    order = {r: i for i, r in enumerate(definition[0])}
    rep = min(reps, key=lambda r: (r.f[1].lower() not in ("'body'", "'facetation'"), order[r.step_id]))
    top = records.agg(F.max("step_id"), F.max("ord"), F.max("file_id")).first()
    tessellated = not schema.upper().startswith("IFC2X3")
    made = body_records(top[0] + 1, vertices, triangles, tessellated)
    new_fields = [rep.f[0], rep.f[1], "'Tessellation'" if tessellated else "'Brep'", f"(#{made[-1][0]})"]
    line = lambda i, t, a: f"#{i}={t}({a});\n"
    override = spark.createDataFrame([(rep.step_id, ",".join(new_fields), line(rep.step_id, "IFCSHAPEREPRESENTATION", ",".join(new_fields)))], "step_id long, args string, raw string")
    swapped = durable(with_overrides(records, override))
    refs = lambda df: df.select(F.col("step_id").alias("src"), F.explode(step.all_refs(F.col("args"))).alias("dst"))
    # The old items as if they hung on a record that has gone; whatever still refers to them keeps them.
    old = [int(x[1:]) for x in rep.f[3].strip("()").replace(" ", "").split(",") if x.startswith("#")]
    hung = spark.createDataFrame([(-1, i) for i in old], "src long, dst long")
    gone = orphans(refs(swapped).union(hung), spark.createDataFrame([(-1,)], "node long"))
    left = swapped.join(gone, F.col("step_id") == F.col("node"), "left_anti")
    fresh = spark.createDataFrame([(top[2], top[1] + 1 + k, i, t, a, line(i, t, a)) for k, (i, t, a) in enumerate(made)], "file_id string, ord long, step_id long, type string, args string, raw string")
    stats = {"product": product, "shape_rep": rep.step_id, "records_new": len(made), "records_gc": gone.count()}
    return left.select(*fresh.columns).unionByName(fresh), stats


def real(x: Column) -> Column:
    """real_text() for a column of ordinary size."""
    return step.real(x)
