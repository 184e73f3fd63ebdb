"""Shapes at scale: short plans, shapes made once a worker."""

from pyspark.sql import functions as F

from ashlar.operators import geometry


def boxes(spark, n):
    corners, indices = geometry.box_mesh(1.0, 2.0, 3.0)
    rows = spark.range(n).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("guid"), F.transform(F.array(*map(F.lit, corners)), lambda c: c * (F.col("id") + 1)).alias("vertices"), F.array(*[F.lit(i).cast("bigint") for i in indices]).alias("indices"))
    return rows.union(rows.where("id = 0").select(F.lit("open").alias("guid"), "vertices", F.slice("indices", 1, 30)))


def test_volumes_joins_small_rows(spark):
    """No array, edge or triangle is sorted or exploded in the last plan, whose operators all stand in the same tasks."""
    rows = geometry.volumes(boxes(spark, 5))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    got = {r.guid: (r.mesh_quality, round(r.volume_m3, 6), r.method) for r in rows.collect()}
    assert {k: v for k, v in got.items() if k != "open"} == {f"g{i}": ("closed", 6.0 * (i + 1) ** 3, "mesh") for i in range(5)}
    assert got["open"][0] == "open_shell"


def test_walks_and_meshes_are_kept_with_the_model(spark):
    """References, placements and meshes of one model are worked out once, however many tables need them."""
    from ashlar.operators import meshes
    from ashlar.operators.index import Tables

    rows = [
        (1, "IFCWALL", "'0000000000000000000001',$,$,$,$,#2,#5,$"), (2, "IFCLOCALPLACEMENT", "$,#3"), (3, "IFCAXIS2PLACEMENT3D", "#4,$,$"), (4, "IFCCARTESIANPOINT", "(1.,2.,3.)"),
        (5, "IFCPRODUCTDEFINITIONSHAPE", "$,$,(#6)"), (6, "IFCSHAPEREPRESENTATION", "$,'Body','CSG',(#7)"), (7, "IFCBLOCK", "#8,1.,1.,1."), (8, "IFCAXIS2PLACEMENT3D", "#9,$,$"), (9, "IFCCARTESIANPOINT", "(0.,0.,0.)"),
    ]
    t = Tables(spark.createDataFrame([("f", i, i, kind, args, "") for i, kind, args in rows], "file_id string, ord long, step_id long, type string, args string, raw string"))
    assert meshes.placements(t) is meshes.placements(t)
    world = meshes.product_meshes(t, "world").first()
    assert world.source == "block" and min(world.vertices[0::3]) == 1.0 and max(world.vertices[2::3]) == 4.0
    made = dict(t.made)
    meshes.product_meshes(t, "local").collect()
    assert t.made == made and {"_references", "_item_meshes"} <= made.keys()
    assert meshes.product_meshes(t, "local", ["0000000000000000000001"]).count() == 1


def test_glb_of_equal_shapes(spark, tmp_path):
    """Shapes of equal bytes stand once in the file; nodes, meshes and materials are as glb() makes them."""
    import numpy as np

    from ashlar.operators import gltf

    corners, indices = geometry.box_mesh(1.0, 2.0, 3.0)
    shapes = spark.createDataFrame([("a", corners, indices), ("b", corners, indices), ("c", [c * 2 for c in corners[:24]], indices[:6])], "rep_id string, vertices array<double>, indices array<bigint>")
    move = [float(i % 5 == 0) for i in range(15)] + [1.0]
    rows = [("g1", "IfcWall", "a", move, [1.0, 0.0, 0.0, 1.0]), ("g2", "IfcWall", "a", None, None), ("g3", "é\"", "b", None, [1.0, 0.0, 0.0, 1.0]), ("g4", "x", "c", None, None), ("g5", "x", "none", None, None), ("g6", "x", "c", None, None)]
    path = str(tmp_path / "out" / "m.glb")
    gltf.write_glb(spark.createDataFrame(rows, "guid string, entity string, rep_id string, matrix array<double>, colour array<double>"), shapes, path)
    head, body = gltf.read_glb(open(path, "rb").read())
    old, _ = gltf.read_glb(gltf.glb([dict(zip(("guid", "entity", "rep_id", "matrix", "colour"), r, strict=True)) for r in rows], {r.rep_id: (np.array(r.vertices), np.array(r.indices)) for r in shapes.collect()}))
    assert (len(head["nodes"]), len(head["meshes"]), len(head["materials"])) == (len(old["nodes"]), len(old["meshes"]), 1) == (5, 4, 1)
    assert len(head["accessors"]) == 4 and len(old["accessors"]) == 6
    assert len(body) == head["buffers"][0]["byteLength"] == sum(v["byteLength"] + -v["byteLength"] % 4 for v in head["bufferViews"])

    def drawn(h):
        return {n["name"]: (n["extras"], n.get("matrix"), h["accessors"][p["attributes"]["POSITION"]]["max"], h["accessors"][p["indices"]]["count"], h["materials"][p["material"]] if "material" in p else None) for n in h["nodes"] for p in h["meshes"][n["mesh"]]["primitives"]}

    assert drawn(head) == drawn(old)
    at = head["bufferViews"][head["accessors"][head["meshes"][head["nodes"][0]["mesh"]]["primitives"][0]["attributes"]["POSITION"]]["bufferView"]]
    assert np.frombuffer(body, "<f4", 24, at["byteOffset"]).tolist() == corners
    empty = str(tmp_path / "empty.glb")
    gltf.write_glb(spark.createDataFrame(rows, "guid string, entity string, rep_id string, matrix array<double>, colour array<double>"), shapes.limit(0), empty)
    head, body = gltf.read_glb(open(empty, "rb").read())
    assert head["scenes"] == [{"nodes": []}] and "nodes" not in head


def test_subset_deals_out_anchors_without_texts(spark, monkeypatch):
    """A relationship with many anchors is one row with its text; a row for each anchor holds ids only."""
    from ashlar.operators import subset
    from ashlar.operators.durable import durable

    n = 40
    walls = [(10 + i, "IFCWALL", f"'{i:022d}',$") for i in range(n)]
    rows = [(1, "IFCPROJECT", "'P000000000000000000000',$"), (2, "IFCBUILDING", "'N000000000000000000000',$,#3"), (3, "IFCLABEL", "'x'"), *walls, (500, "IFCRELCONTAINEDINSPATIALSTRUCTURE", "'e000000000000000000000',$,$,$,(" + ",".join(f"#{10 + i}" for i in range(n)) + "),#2")]
    records = spark.createDataFrame([(i, i, t, a, f"#{i}={t}({a});") for i, t, a in rows], "ord long, step_id long, type string, args string, raw string")
    tables = []
    monkeypatch.setattr(subset, "durable", lambda df: tables.append(durable(df)) or tables[-1])
    out = {r.step_id: r.raw for r in subset.subset(records, [f"{i:022d}" for i in (3, 7)]).collect()}
    assert sorted(out) == [1, 2, 3, 13, 17, 500]
    assert out[500].endswith(",(#13,#17),#2);")
    assert all(t.dtypes and not {"raw", "pulled", "others"} & set(t.columns) for t in tables if "anchor_id" in t.columns)
