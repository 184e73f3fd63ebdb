"""Clash detection: a spatial self-join on a hierarchy of grids, class filters, categories, mesh distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes that have no body of their own.
NON_PHYSICAL = ("Grid", "Annotation", "Space", "OpeningElement", "VirtualElement")


def substrate_class(entity: Column) -> Column:
    """An entity without Ifc in front and without StandardCase or ElementedCase behind."""
    return F.regexp_replace(F.regexp_replace(entity, "^Ifc", ""), "(StandardCase|ElementedCase)$", "")


def category(a: Column, b: Column) -> Column:
    """non_physical, insulation, connection or clash, from the two classes."""
    family = lambda c: F.regexp_extract(c, "^(.+)(Fitting|Segment)$", 1)
    end = lambda c: F.regexp_extract(c, "^(.+)(Fitting|Segment)$", 2)
    joint = (family(a) != "") & (family(a) == family(b)) & (end(a) != end(b))
    return F.when(a.isin(*NON_PHYSICAL) | b.isin(*NON_PHYSICAL), "non_physical").when((a == "Covering") | (b == "Covering"), "insulation").when(joint, "connection").otherwise("clash")


def broad_phase(boxes: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of boxes(id, min_x .. max_z) that meet when each grows by tolerance; touching counts.

    A box belongs to the grid whose cells are at least as wide as it is, so it lies in at most eight
    cells there. One side of the join holds each box in its own grid only, the other in all coarser grids that exist
    too: a pair meets where the larger box lives, in the one cell that holds the low corner of their common part, so
    none comes twice, and the boxes that share a cell of a huge box's grid are held against that box, never
    against each other. Boxes with a null side are left out.
    """
    sides = [f"{m}_{x}" for m in ("min", "max") for x in "xyz"]
    grown = boxes.select("id", *[(F.col(s) + (tolerance if s.startswith("max") else -tolerance)).alias(s) for s in sides]).dropna()
    extent = F.greatest(*[F.col(f"max_{x}") - F.col(f"min_{x}") for x in "xyz"], F.lit(1e-9))
    levelled = grown.withColumn("level", F.ceil(F.log2(extent)).cast("int"))
    levels = levelled.agg(F.sort_array(F.collect_set("level")).alias("levels"))  # as many as powers of two between the extents
    entered = levelled.crossJoin(F.broadcast(levels)).withColumn("grid", F.explode(F.filter("levels", lambda g: g >= F.col("level")))).drop("levels")

    def cells(rows: DataFrame) -> DataFrame:
        width = F.pow(F.lit(2.0), F.col("grid"))
        for x in "xyz":
            rows = rows.withColumn(f"c{x}", F.explode(F.sequence(F.floor(F.col(f"min_{x}") / width), F.floor(F.col(f"max_{x}") / width))))
        return rows

    named = lambda rows, p: rows.select("grid", "cx", "cy", "cz", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "level", *sides)])
    large, small = named(cells(levelled.withColumn("grid", F.col("level"))), "a"), named(cells(entered), "b")
    pairs = large.join(small, ["grid", "cx", "cy", "cz"]).where((F.col("b_level") < F.col("a_level")) | ((F.col("b_level") == F.col("a_level")) & (F.col("a_id") < F.col("b_id"))))
    width = F.pow(F.lit(2.0), F.col("grid"))
    for x in "xyz":
        low = F.greatest(f"a_min_{x}", f"b_min_{x}")
        pairs = pairs.where((F.col(f"a_min_{x}") <= F.col(f"b_max_{x}")) & (F.col(f"b_min_{x}") <= F.col(f"a_max_{x}")) & (F.floor(low / width) == F.col(f"c{x}")))
    return pairs.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"))


def class_filter(pairs: DataFrame, include: list[str] | None = None, exclude_self: list[str] | None = None) -> DataFrame:
    """pairs(class_a, class_b) with either class in include, less those of one class in exclude_self."""
    if include:
        pairs = pairs.where(F.col("class_a").isin(*include) | F.col("class_b").isin(*include))
    if exclude_self:
        pairs = pairs.where(~((F.col("class_a") == F.col("class_b")) & F.col("class_a").isin(*exclude_self)))
    return pairs


def _point_triangle(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Least distances of points (n, 3) to triangles (m, 3, 3), as (n, m)."""
    a, ab, ac = t[:, 0], t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    normal = np.cross(ab, ac)
    square = np.maximum((normal * normal).sum(1), 1e-30)
    ap = p[:, None] - a
    v = (np.cross(ap, ac) * normal).sum(2) / square
    w = (np.cross(ab, ap) * normal).sum(2) / square
    inside = (v >= 0) & (w >= 0) & (v + w <= 1)
    flat = np.abs((ap * normal).sum(2)) / np.sqrt(square)
    edges = [_point_segment(p, t[:, i], t[:, (i + 1) % 3]) for i in range(3)]
    return np.where(inside, flat, np.minimum.reduce(edges))


def _point_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    s = np.clip(((p[:, None] - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-30), 0, 1)
    return np.linalg.norm(p[:, None] - (a + s[:, :, None] * d), axis=2)


def _segment_segment(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least distances of segments p-q (n) to a-b (m)."""
    d1, d2 = (q - p)[:, None], (b - a)[None]
    r = p[:, None] - a
    aa, ee, bb = (d1 * d1).sum(2), (d2 * d2).sum(2), (d1 * d2).sum(2)
    cc, ff = (d1 * r).sum(2), (d2 * r).sum(2)
    det = aa * ee - bb * bb
    s = np.clip(np.where(det > 1e-18, (bb * ff - cc * ee) / np.maximum(det, 1e-18), 0), 0, 1)
    u = np.clip((bb * s + ff) / np.maximum(ee, 1e-30), 0, 1)
    s = np.clip((bb * u - cc) / np.maximum(aa, 1e-30), 0, 1)
    return np.linalg.norm(r + s[:, :, None] * d1 - u[:, :, None] * d2, axis=2)


def _pierces(p: np.ndarray, q: np.ndarray, t: np.ndarray) -> bool:
    """True if a segment p-q passes through a triangle of t."""
    d, e1, e2 = (q - p)[:, None], t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    h = np.cross(d, e2)
    det = (h * e1).sum(2)
    sign = np.where(np.abs(det) < 1e-15, np.inf, det)
    s = p[:, None] - t[:, 0]
    u = (s * h).sum(2) / sign
    k = np.cross(s, e1)
    v = (d * k).sum(2) / sign
    w = (k * e2).sum(2) / sign
    return bool(((np.abs(det) >= 1e-15) & (u >= 0) & (v >= 0) & (u + v <= 1) & (w >= 0) & (w <= 1)).any())


def mesh_distance(a: np.ndarray, b: np.ndarray) -> float:
    """The least distance between two triangle sets (n, 3, 3); 0 where they cross or touch."""
    best = np.inf
    for i in range(0, len(a), 64):
        x = a[i : i + 64]
        for j in range(0, len(b), 64):
            y = b[j : j + 64]
            ends = [(x[:, k], x[:, (k + 1) % 3]) for k in range(3)], [(y[:, k], y[:, (k + 1) % 3]) for k in range(3)]
            if any(_pierces(p, q, y) for p, q in ends[0]) or any(_pierces(p, q, x) for p, q in ends[1]):
                return 0.0
            best = min(best, _point_triangle(x.reshape(-1, 3), y).min(), _point_triangle(y.reshape(-1, 3), x).min(), *(_segment_segment(p, q, c, d).min() for p, q in ends[0] for c, d in ends[1]))
    return float(best)


def narrow_phase(pairs: DataFrame, meshes: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """pairs with kind and min_distance_m from meshes(id, vertices, indices): hard at 0, clearance within tolerance.

    Only meshes of candidate pairs are joined in; each pair is measured within one row.
    """
    one = lambda side: meshes.select(F.col("id").alias(f"id_{side}"), F.col("vertices").alias(f"v_{side}"), F.col("indices").alias(f"i_{side}"))
    joined = pairs.join(one("a"), "id_a").join(one("b"), "id_b")
    fields = pairs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mesh = lambda v, i: np.asarray(v, float).reshape(-1, 3)[np.asarray(i, int)].reshape(-1, 3, 3)
            yield f[fields].assign(min_distance_m=[mesh_distance(mesh(va, ia), mesh(vb, ib)) for va, ia, vb, ib in zip(f["v_a"], f["i_a"], f["v_b"], f["i_b"], strict=True)])

    from pyspark.sql.types import DoubleType, StructType

    measured = joined.mapInPandas(run, StructType(pairs.schema.fields[:]).add("min_distance_m", DoubleType()))
    return measured.where(F.col("min_distance_m") <= tolerance).withColumn("kind", F.when(F.col("min_distance_m") == 0, "hard").otherwise("clearance"))


def clash(instances: DataFrame, meshes: DataFrame, tolerance: float = 0.0, include: list[str] | None = None, exclude_self: list[str] | None = None) -> DataFrame:
    """Clashes among instances(id, guid, entity, min_x .. max_z): pair, classes, kind, category and distance."""
    named = instances.select("id", "guid", substrate_class(F.col("entity")).alias("class"))
    side = lambda s: named.select(F.col("id").alias(f"id_{s}"), F.col("guid").alias(f"guid_{s}"), F.col("class").alias(f"class_{s}"))
    pairs = class_filter(broad_phase(instances, tolerance).join(side("a"), "id_a").join(side("b"), "id_b"), include, exclude_self)
    return narrow_phase(pairs, meshes, tolerance).withColumn("category", category(F.col("class_a"), F.col("class_b")))
