"""Geometric take-off over meshes(guid, vertices, indices): volumes, areas, surfaces, mesh quality, drift, points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

# Fixed values of take-off and drift; they must agree with published results.
#: Cosine and sine of 20 degrees as take-off uses them, and steps of a quantised normal.
TOP, SIDE, STEPS = 0.940, 0.342, 10
#: Triangles whose doubled area is less are skipped; surfaces of less area are noise.
DEGENERATE, NOISE = 1e-12, 1e-6
OPEN_MARGIN, WELD = 1.001, 1e-4
PRISM_MARGIN, COLLAPSE, SOLID_FLOOR = 1.05, 1e-3, 1e-3
GRID = 256
#: Drift: metres that are no drift, extents that are ok and that are a warning; rows and share of errors of a baked model.
NO_DRIFT, OK_RATIO, WARN_RATIO, BAKED_ROWS, BAKED_SHARE = 0.010, 2.0, 10.0, 20, 0.25


def bounds(meshes: DataFrame) -> DataFrame:
    """(guid, min_x .. max_z, aabb_volume) of each mesh, within its own row."""
    axis = lambda k: F.transform(F.sequence(F.lit(0), (F.size("vertices") / 3 - 1).cast("int")), lambda i: F.get("vertices", (i * 3 + k).cast("int")))
    out = meshes.where(F.size("vertices") >= 3)
    for k, name in enumerate("xyz"):
        out = out.withColumn(f"min_{name}", F.array_min(axis(k))).withColumn(f"max_{name}", F.array_max(axis(k)))
    volume = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z"))
    return out.select("guid", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z", volume.alias("aabb_volume"))


def triangles(meshes: DataFrame) -> DataFrame:
    """(guid, tri, ia, ib, ic, ax .. cz, nx, ny, nz, mag): corners, and the normal with its length, the doubled area.

    Corners are taken relative to the mesh's first vertex, so far-off coordinates lose no digits.
    """
    tris = meshes.select("guid", "vertices", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("indices") / 3 - 1).cast("int")), lambda i: F.slice("indices", (i * 3 + 1).cast("int"), 3))).alias("tri", "t")).where(F.size("t") == 3)
    at = lambda corner, k: F.get("vertices", (F.col("t")[corner] * 3 + k).cast("int")) - F.get("vertices", F.lit(k))
    out = tris.select("guid", "tri", *[F.col("t")[i].alias(f"i{c}") for i, c in enumerate("abc")], *[at(i, k).alias(f"{c}{x}") for i, c in enumerate("abc") for k, x in enumerate("xyz")])
    ux, uy, uz = (F.col(f"b{x}") - F.col(f"a{x}") for x in "xyz")
    vx, vy, vz = (F.col(f"c{x}") - F.col(f"a{x}") for x in "xyz")
    out = out.withColumns({"nx": uy * vz - uz * vy, "ny": uz * vx - ux * vz, "nz": ux * vy - uy * vx})
    return out.withColumn("mag", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")))


def take_off(tris: DataFrame) -> DataFrame:
    """(guid, triangle_count, volume, area, area_top, area_bottom, area_side, area_inclined)."""
    unit = F.col("nz") / F.col("mag")
    area = F.col("mag") / 2
    solid = F.col("mag") > DEGENERATE
    signed = (F.col("ax") * (F.col("by") * F.col("cz") - F.col("bz") * F.col("cy")) + F.col("ay") * (F.col("bz") * F.col("cx") - F.col("bx") * F.col("cz")) + F.col("az") * (F.col("bx") * F.col("cy") - F.col("by") * F.col("cx"))) / 6
    total = lambda test: F.sum(F.when(solid & test, area).otherwise(0.0))
    return tris.groupBy("guid").agg(
        F.count("*").alias("triangle_count"),
        F.sum(F.when(solid, signed).otherwise(0.0)).alias("volume"),
        total(F.lit(True)).alias("area"),
        total(unit > TOP).alias("area_top"),
        total(unit < -TOP).alias("area_bottom"),
        total(F.abs(unit) < SIDE).alias("area_side"),
        total((F.abs(unit) >= SIDE) & (F.abs(unit) <= TOP)).alias("area_inclined"),
    )


def surfaces(tris: DataFrame) -> DataFrame:
    """(guid, surface_index, area, qx, qy, qz): area by quantised normal, largest first."""
    q = lambda n: F.round(F.col(n) / F.col("mag") * STEPS).cast("int").alias(f"q{n[1]}")
    grouped = tris.where(F.col("mag") > DEGENERATE).select("guid", "mag", q("nx"), q("ny"), q("nz")).groupBy("guid", "qx", "qy", "qz").agg((F.sum("mag") / 2).alias("area")).where(F.col("area") > NOISE)
    order = Window.partitionBy("guid").orderBy(F.desc("area"), "qx", "qy", "qz")
    return grouped.withColumn("surface_index", F.row_number().over(order) - 1).select("guid", "surface_index", "area", "qx", "qy", "qz")


def surface_summary(found: DataFrame) -> DataFrame:
    """(guid, surface_count, largest, smallest)."""
    return found.groupBy("guid").agg(F.count("*").alias("surface_count"), F.max("area").alias("largest"), F.min("area").alias("smallest"))


def closed(tris: DataFrame) -> DataFrame:
    """(guid, closed): every undirected edge used twice, once in each direction; below three triangles false."""
    edge = lambda p, q: F.struct(F.col(p).alias("p"), F.col(q).alias("q"))
    edges = tris.select("guid", F.explode(F.array(edge("ia", "ib"), edge("ib", "ic"), edge("ic", "ia"))).alias("e")).where("e.p <> e.q")
    per = edges.groupBy("guid", F.least("e.p", "e.q").alias("lo"), F.greatest("e.p", "e.q").alias("hi")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("e.p") < F.col("e.q"), 1).otherwise(-1)).alias("s"))
    good = per.groupBy("guid").agg(F.bool_and((F.col("n") == 2) & (F.col("s") == 0)).alias("good"))
    return tris.groupBy("guid").agg(F.count("*").alias("t")).join(good, "guid", "left").select("guid", (F.coalesce("good", F.lit(False)) & (F.col("t") >= 3)).alias("closed"))


def welded(meshes: DataFrame, cell: float = WELD) -> DataFrame:
    """meshes(guid, vertices, indices, ..) whose indices name the first vertex of each grid cell.

    Vertices are dealt out by mesh and cell, so the work follows their number; a mesh's map comes back as one array.
    """
    place = lambda k: F.floor(F.element_at("vertices", F.col("i") * 3 + k + 1) / cell + 0.5).alias(f"c{k}")
    known = meshes.where(F.size("vertices") >= 3)
    points = known.select("guid", "vertices", F.explode(F.sequence(F.lit(0), (F.size("vertices") / 3 - 1).cast("int"))).alias("i")).select("guid", "i", *[place(k) for k in range(3)])
    first = points.withColumn("to", F.min("i").over(Window.partitionBy("guid", "c0", "c1", "c2")))
    maps = first.groupBy("guid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "to"))), lambda s: s["to"].cast("bigint")).alias("_to"))
    return known.join(maps, "guid").withColumn("indices", F.transform("indices", lambda i: F.get("_to", i.cast("int")))).select(*meshes.columns)


def quality(meshes: DataFrame) -> DataFrame:
    """(guid, mesh_quality): degenerate, open_shell or closed, retried after welding.

    The edges of both tries are counted one after the other: in one plan all their sorts would stand in the same tasks.
    """
    tris = triangles(meshes)
    ok = durable(closed(tris)).join(durable(closed(triangles(welded(meshes))).withColumnRenamed("closed", "closed_after")), "guid")
    all_of = bounds(meshes).select("guid", "aabb_volume").join(take_off(tris).select("guid", "volume"), "guid").join(ok, "guid")
    state = F.when(F.col("aabb_volume") <= 0, "degenerate").when(F.abs("volume") > OPEN_MARGIN * F.col("aabb_volume"), "open_shell").when(F.col("closed") | F.col("closed_after"), "closed").otherwise("open_shell")
    return all_of.select("guid", state.alias("mesh_quality"))


def footprint(tris: DataFrame, along: str, cells: int = GRID) -> DataFrame:
    """(guid, area): raster area of each mesh seen along an axis, by cell centres inside triangles.

    The longer side of the mesh's extent has `cells` cells. Meant for the rows that are not closed.
    """
    u, v = [x for x in "xyz" if x != along]
    corner = [F.least(*[F.col(f"{c}{x}") for c in "abc"]) for x in (u, v)], [F.greatest(*[F.col(f"{c}{x}") for c in "abc"]) for x in (u, v)]
    t = tris.withColumns({"lu": corner[0][0], "lv": corner[0][1], "hu": corner[1][0], "hv": corner[1][1]})
    box = t.groupBy("guid").agg(F.min("lu").alias("u0"), F.min("lv").alias("v0"), (F.greatest(F.max("hu") - F.min("lu"), F.max("hv") - F.min("lv")) / cells).alias("cell")).where("cell > 0")
    t = t.join(box, "guid")
    span = lambda lo, hi, base: F.sequence(F.floor((F.col(lo) - F.col(base)) / F.col("cell")).cast("int"), F.least(F.floor((F.col(hi) - F.col(base)) / F.col("cell")), F.lit(cells - 1)).cast("int"))
    t = t.withColumn("iu", F.explode(span("lu", "hu", "u0"))).withColumn("iv", F.explode(span("lv", "hv", "v0")))
    pu, pv = F.col("u0") + (F.col("iu") + 0.5) * F.col("cell"), F.col("v0") + (F.col("iv") + 0.5) * F.col("cell")
    side = lambda p, q: (F.col(f"{q}{u}") - F.col(f"{p}{u}")) * (pv - F.col(f"{p}{v}")) - (F.col(f"{q}{v}") - F.col(f"{p}{v}")) * (pu - F.col(f"{p}{u}"))
    s = [side("a", "b"), side("b", "c"), side("c", "a")]
    inside = F.greatest(*s) * 0 == 0
    inside = inside & ((F.least(*s) >= 0) | (F.greatest(*s) <= 0))
    hit = t.where(inside).select("guid", "cell", "iu", "iv").distinct()
    return hit.groupBy("guid").agg((F.count("*") * F.first("cell") * F.first("cell")).alias("area"))


def volumes(meshes: DataFrame) -> DataFrame:
    """(guid, mesh_quality, volume_m3, method, prism_bound): the best estimate of each mesh's volume.

    Closed meshes keep their own. Others are held against the least prism over their footprints: the mesh value
    stays (mesh_open) if it is positive, not collapsed and at most PRISM_MARGIN of the bound, else
    the bound replaces it (prism_fallback). prism_bound is null for closed meshes.
    """
    # Meshes are read several times, and what is joined by guid is one small row a mesh, so that no task sorts arrays or triangles.
    meshes = durable(meshes.select("guid", "vertices", "indices"))
    state = durable(quality(meshes))
    tris = triangles(meshes)
    open_ones = triangles(meshes.join(state.where("mesh_quality <> 'closed'").select("guid"), "guid", "left_semi"))
    box = durable(bounds(meshes))
    prisms = None
    for axis in "xyz":
        own = durable(footprint(open_ones, axis).join(box, "guid").select("guid", (F.col("area") * (F.col(f"max_{axis}") - F.col(f"min_{axis}"))).alias(f"p{axis}")))
        prisms = own if prisms is None else prisms.join(own, "guid", "full_outer")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    rows = state.join(durable(take_off(tris)), "guid").join(box, "guid").join(prisms, "guid", "left")
    rows = rows.withColumn("prism", F.least(positive("px"), positive("py"), positive("pz"))).withColumn("upper", F.least(F.col("prism"), positive("aabb_volume"))).withColumn("v", F.abs("volume"))
    collapsed = (F.col("prism") >= SOLID_FLOOR) & (F.col("area") > 0.5 * F.pow("prism", F.lit(2 / 3))) & (F.col("v") < F.col("upper") * COLLAPSE)
    keeps = (F.col("upper") > 0) & (F.col("v") > 0) & ~F.coalesce(collapsed, F.lit(False)) & (F.col("v") <= PRISM_MARGIN * F.col("upper"))
    method = F.when(F.col("mesh_quality") == "closed", "mesh").when(F.coalesce(keeps, F.lit(False)), "mesh_open").otherwise("prism_fallback")
    return rows.withColumn("method", method).select("guid", "mesh_quality", F.when(F.col("method") == "prism_fallback", F.coalesce("upper", F.lit(0.0))).otherwise(F.col("v")).alias("volume_m3"), "method", F.when(F.col("mesh_quality") != "closed", F.col("upper")).alias("prism_bound"))


def drift(boxes: DataFrame) -> DataFrame:
    """boxes with drift_distance, max_extent, drift_ratio and severity from placement_x, _y, _z and the box's middle."""
    middle = [(F.col(f"min_{x}") + F.col(f"max_{x}")) / 2 - F.col(f"placement_{x}") for x in "xyz"]
    extent = F.greatest(*[F.col(f"max_{x}") - F.col(f"min_{x}") for x in "xyz"], F.lit(1e-6))
    out = boxes.withColumn("drift_distance", F.sqrt(sum((m * m for m in middle[1:]), middle[0] * middle[0]))).withColumn("max_extent", extent).withColumn("drift_ratio", F.col("drift_distance") / F.col("max_extent"))
    return out.withColumn("severity", severity(F.col("drift_distance"), F.col("drift_ratio")))


def severity(distance: Column, ratio: Column) -> Column:
    """ok within 10 mm or twice the extent, warn within ten times, else error."""
    return F.when((distance < NO_DRIFT) | (ratio <= OK_RATIO), "ok").when(ratio <= WARN_RATIO, "warn").otherwise("error")


def world_baked(rows: DataFrame) -> DataFrame:
    """One row, baked: at least 20 rows and a quarter of them errors."""
    return rows.agg(((F.count("*") >= BAKED_ROWS) & (F.count_if(F.col("severity") == "error") >= BAKED_SHARE * F.count("*"))).alias("baked"))


def demoted(rows: DataFrame) -> DataFrame:
    """rows whose warnings and errors become info if the whole model is baked in world coordinates."""
    flag = world_baked(rows)
    return rows.crossJoin(F.broadcast(flag)).withColumn("severity", F.when(F.col("baked") & (F.col("severity") != "ok"), "info").otherwise(F.col("severity"))).drop("baked")


def severity_histogram(rows: DataFrame) -> DataFrame:
    """(severity, n) over the fixed domain ok, info, warn, error."""
    names = ("ok", "info", "warn", "error")
    counts = rows.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in names])).alias("x")).select("x.*")


def point_cloud(tris: DataFrame, per_m2: float = 1000.0, seed: int = 42) -> DataFrame:
    """(guid, tri, k, x, y, z): ceil(per_m2 * area) points a mesh, spread evenly over its triangles.

    The points of a mesh are the steps of an even ladder over its cumulative area, from a start drawn by hash,
    so each triangle gets its share to within one. A point's place comes from hashes of (seed, guid, triangle, k):
    the cloud is the same on every run. Coordinates are relative to the mesh's first vertex, as in triangles().
    """
    unit = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / float(1 << 30)
    solid = tris.where(F.col("mag") > 0).withColumn("area", F.col("mag") / 2)
    whole = Window.partitionBy("guid")
    so_far = whole.orderBy("tri").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = solid.withColumns({"total": F.sum("area").over(whole), "top": F.sum("area").over(so_far), "last": F.max("tri").over(whole)})
    ranked = ranked.withColumn("points", F.ceil(F.col("total") * per_m2))
    # Step j of the ladder lies at (j + start) / points of the area; the last triangle takes what rounding leaves.
    upto = lambda area: F.greatest(F.lit(0), F.least(F.col("points"), F.ceil(area / F.col("total") * F.col("points") - unit(F.lit("start"), "guid"))))
    high = F.when(F.col("tri") == F.col("last"), F.col("points")).otherwise(upto(F.col("top")))
    low = F.coalesce(F.lag("high").over(whole.orderBy("tri")), F.lit(0))
    counted = ranked.withColumn("high", high).withColumn("n", (F.col("high") - low).cast("int")).where("n > 0")
    k = counted.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    r1, r2 = F.sqrt(unit(F.lit("u"), "guid", "tri", "k")), unit(F.lit("v"), "guid", "tri", "k")
    mix = lambda x: (1 - r1) * F.col(f"a{x}") + r1 * (1 - r2) * F.col(f"b{x}") + r1 * r2 * F.col(f"c{x}")
    return k.select("guid", "tri", "k", *[mix(x).alias(x) for x in "xyz"])


def box_mesh(dx: float, dy: float, dz: float, at: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[list[float], list[int]]:
    """Vertices and outward triangles of a box."""
    x, y, z = at
    corners = [(x + i * dx, y + j * dy, z + k * dz) for k in (0, 1) for j in (0, 1) for i in (0, 1)]
    faces = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    return [c for p in corners for c in p], [i for a, b, c, d in faces for i in (a, b, c, a, c, d)]
