"""Cutting, swapping, rules, tools and the source on small cases worked out by hand."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar import tools
from ashlar.example import example_model
from ashlar.functions import classes, cuts, solids, step_text, units
from ashlar.operators import gltf, rules, swap
from ashlar.sources import step


def volume(m):
    c = m[0][m[1]] - m[0][0] if len(m[1]) else np.zeros((0, 3, 3))
    return float(np.einsum("ij,ij->", c[:, 0], np.cross(c[:, 1], c[:, 2])) / 6)


def area(m):
    c = m[0][m[1]]
    return float(np.linalg.norm(np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0]), axis=1).sum() / 2)


def at(m, *d):
    return m[0] + np.array(d, float), m[1]


WALL = solids.box(5, 0.3, 3)


@pytest.mark.parametrize(
    ("cutters", "left", "skin"),
    [
        ([at(solids.box(1, 0.3, 1), 1, 0, 1)], 4.2, 34.0),
        ([at(solids.box(1, 1, 1), 1, -0.3, 1)], 4.2, 34.0),
        ([at(solids.box(1, 1, 1), 1, -0.3, 1), at(solids.box(1, 1, 2), 3, -0.3, 0)], 3.6, 31.2),
        ([at(solids.box(1, 0.1, 1), 1, 0, 1)], 4.4, 35.2),
        ([at(solids.box(1, 1, 1), 1, -0.3, 1), at(solids.box(1, 1, 1), 1.5, -0.3, 1.5)], 3.975, 33.1),
        ([at(solids.box(1, 1, 1), 1, -0.3, 1)] * 2, 4.2, 34.0),
        ([at(solids.box(1, 1, 1), 1, -0.3, 1), at(solids.box(1, 1, 1), 2, -0.3, 1)], 3.9, 32.6),
        ([at(solids.box(1, 1, 1), 1, 5, 1)], 4.5, 34.8),
        ([at(solids.box(1, 1, 1), 1, 0.3, 1)], 4.5, 34.8),
        ([at(solids.box(1, 0.1, 1), 1, 0.1, 1)], 4.4, 37.2),
        ([at(solids.box(9, 9, 9), -1, -1, -1)], 0.0, 0.0),
    ],
)
def test_walls_without_their_openings(cutters, left, skin):
    m, outcome = cuts.cut(WALL, [("block", c) for c in cutters])
    assert outcome == ("cut" if left else "emptied")
    assert volume(m) == pytest.approx(left) and (not left or area(m) == pytest.approx(skin))


def test_cuts_that_are_left_alone():
    hollow = solids.extrude(np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float), [np.array([(1, 1), (3, 1), (3, 3), (1, 3)], float)], np.array([0, 0, 3.0]))
    assert cuts.cut(WALL, [("x", hollow)])[1] == "cutter_not_convex"
    assert cuts.cut((WALL[0], WALL[1][:-1]), [("x", WALL)])[1] == "host_open"
    assert cuts.cut(WALL, [("x", (WALL[0], WALL[1][:0]))])[1] == "cutter_empty"
    assert cuts.cut(WALL, [])[1] == "untouched"
    assert volume(cuts.cut(hollow, [("x", at(solids.box(1, 10, 1), 0, -1, 1))])[0]) == pytest.approx(32)


@pytest.mark.parametrize(("agree", "left"), [(True, 3.0), (False, 1.5)])
def test_half_spaces_take_their_solid_side(agree, left):
    flag = ".T." if agree else ".F."
    made = solids.Items({1: ("IFCHALFSPACESOLID", f"#2,{flag}"), 2: ("IFCPLANE", "#3"), 3: ("IFCAXIS2PLACEMENT3D", "#4,$,$"), 4: ("IFCCARTESIANPOINT", "(0.,0.,1.)")}).mesh(1)
    m, _ = cuts.cut(WALL, [(t, (v, f)) for t, v, f in made])
    assert volume(m) == pytest.approx(left)


def test_modes_by_schema():
    assert [classes.mode_of(e, s) for e, s in (("IfcKerb", "IFC4X3_ADD2"), ("IfcKerb", "IFC4"), ("IfcFlowSegment", "IFC2X3"), ("IfcBuiltElement", "ifc4x3"), ("IfcBuildingElement", "IFC4"), ("IfcBurner", "IFC4"))] == ["measure", "skip", "linear", "measure", "measure", "count"]
    assert [classes.resolve_schema(s) for s in ("IFC4X3_TC1", "IFC4_ADD2", "ifc2x3", "UNKNOWN", "", None)] == ["IFC4X3", "IFC4", "IFC2X3", None, None, None]
    assert "IFCKERB" in classes.product_names("IFC4X3") and "IFCKERB" not in classes.product_names("IFC4")
    with pytest.raises(ValueError):
        classes.subtypes("IfcNothing")


def test_units():
    assert units.factor("mm") == pytest.approx(1000) and units.factor("native", 0.3048) == pytest.approx(1 / 0.3048) and units.factor(2.5) == 2.5
    assert units.name_of(0.3048) == "ft" and units.name_of(None) == "unknown"
    with pytest.raises(ValueError):
        units.factor("parsec")


def test_strings_decode_in_the_jvm_as_in_python(spark):
    bodies = ["", "plain", "it''s", "a\\\\b", "\\S\\i", "\\X\\E9\\X\\00x", "\\X2\\00E9D83DDE00\\X0\\!", "\\X2\\D83D0041DE00\\X0\\", "\\X2\\D83DD83DDE00DE00\\X0\\", "\\X4\\0001F60000000041\\X0\\", "\\X4\\0000D80000110000\\X0\\", "\\X2\\\\X0\\", "\\PA\\x", "\\X2\\00e\\X0\\", "\\", "a\\", "\\S\\é", "''\\X\\41''", "\\q'"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", step_text.decode_string(F.col("b")).alias("t")).collect()
    for r in rows:
        assert r.t == step_text.decode_text(bodies[r.i]), bodies[r.i]


def test_fields_split_as_token_by_token(spark):
    bodies = ["'g',$,'A''s; /* #9=X(); */ (y)',$", "'a',(#1,#2),.T.,1.5", "", " ", "$", ",a", "a,", ",", "(1,(2,(3,(4,5)))),'x'", " 'it''s' ,('a,b',(1,2)),$ , #5", None, "IFCLABEL('x, ''y'')'),$", "a/*c,d*/,b", "x,'un", "((1.,2.),(3.,4.)),((1,2),(2,3))", "(" + "1," * 3000 + "1),x", "',', ')('", "a\n,\tb"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", step_text.split_fields("b").alias("f"), step_text.string(F.get(step_text.split_fields(F.col("b")), F.lit(0))).alias("s")).collect()
    for r in rows:
        assert r.f == (None if bodies[r.i] is None else step_text.split_args(bodies[r.i])), bodies[r.i]
    assert {r.s for r in rows} == {None, "g", "a", "it's", ","}


def test_pieces_of_a_file_hold_every_record_once():
    tricky = b"ISO;\nHEADER;\nFILE_NAME('DATA;','x;');\n/* DATA; ; */\nENDSEC;\nDATA;\n" + b"".join(b"#%d=IFCX('it''s; #5=Y();' /* ; ' */,%d);\n" % (i, i) for i in range(1, 60)) + b"ENDSEC;\nEND-ISO-10303-21;\n"
    whole = list(step.scan(tricky))
    assert len(whole) == 59
    for every in (1, 40, 333, 10**6):
        for block in (1, 7, 64, 10**6):
            pieces = step.cuts(io.BytesIO(tricky), every, block)
            assert [(*r[:4], r[4].rstrip()) for a, b in pieces for r in step.scan(tricky[a:b], 0, b - a, a)] == [(*r[:4], r[4].rstrip()) for r in whole], (every, block)


def test_walks_stop_at_their_limit_and_at_cycles(spark):
    from ashlar.operators import graph

    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("c1", "c2"), ("c2", "c1"), ("x", "c1"), ("y", "n30"), ("z", "top"), ("self", "self")]
    hops, wanted = spark.createDataFrame(chain, "guid string, hop string"), spark.createDataFrame([("n40",), ("top",), ("n20",)], "guid string")
    nodes = spark.createDataFrame([(a,) for a, _ in chain] + [("alone",)], "guid string")
    for limit in (1, 2, 16, 25):
        got = {r.guid: r.found for r in graph.first_above(nodes, hops, wanted, limit).collect()}
        up, marks = dict(chain), {"n40", "top", "n20"}
        for start, found in got.items():
            at, want = start, None
            for _ in range(limit):
                at = up.get(at)
                if at in marks:
                    want = at
                    break
            assert found == want, (start, limit)


def test_swapped_text():
    tri = swap.body_records(10, [(0, 0, 0), (1, 0, 0), (0, 1e-7, 0)], [(0, 1, 2)], True)
    assert tri[0] == (10, "IFCCARTESIANPOINTLIST3D", "((0.0,0.0,0.0),(1.0,0.0,0.0),(0.0,1.E-07,0.0))") and tri[-1][2] == "#10,$,.T.,((1,2,3)),$"
    old = swap.body_records(10, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)], False)
    assert [t for _, t, _ in old] == ["IFCCARTESIANPOINT"] * 3 + ["IFCPOLYLOOP", "IFCFACEOUTERBOUND", "IFCFACE", "IFCCLOSEDSHELL", "IFCFACETEDBREP"]


def test_gltf_shares_shapes_and_colours():
    v, f = solids.box(1, 1, 1)
    rows = [{"guid": g, "entity": "IfcWall", "rep_id": "r", "matrix": None, "colour": c} for g, c in (("a", (1, 0, 0, 1)), ("b", (1, 0, 0, 1)), ("c", None))]
    head, body = gltf.read_glb(gltf.glb([*rows, {"guid": "d", "entity": "x", "rep_id": "none"}], {"r": (v, f)}))
    assert (len(head["nodes"]), len(head["meshes"]), len(head["materials"]), len(head["accessors"])) == (3, 2, 1, 2)
    assert np.frombuffer(body[:96], "<f4").reshape(-1, 3).tolist() == v.tolist()
    with pytest.raises(ValueError):
        gltf.read_glb(b"glTF\1\0\0\0\0\0\0\0")


def test_rules(spark, tmp_path):
    path = tmp_path / "rule.yaml"
    path.write_text("prefix: 'C - '\noverrides:\n  Plan U1: Sea\nidempotent_labels: [Sea]\n")
    rows = spark.createDataFrame([("A", "Plan 01", 0.0, "1"), ("A", "Plan U1", -3500.0, "2"), ("B", "C - Plan 2", 3000.0, "3")], "model_name string, storey_name string, elevation_mm double, storey_guid string")
    got = {r.storey_guid: r.label for r in rules.federated_floors(rows, rule=rules.rule_from_yaml(str(path))).collect()}
    assert got == {"1": "C - Plan 1", "2": "Sea", "3": "C - Plan 2"}
    rules.register_rule("loud", lambda c: c.most_common_name.upper())
    assert {r.storey_guid: r.label for r in rules.federated_floors(rows, rule="loud").collect()}["1"] == "PLAN 01" and "default" in rules.known_rules()
    with pytest.raises(KeyError):
        rules.get_rule("none")
    path.write_text("prefx: x\n")
    with pytest.raises(ValueError):
        rules.rule_from_yaml(str(path))


def test_example_model_and_tools(spark, tmp_path):
    m = example_model(spark, str(tmp_path / "house.ifc"))
    wall = "Wall000000000000000001"
    ask = lambda name, **a: json.loads(tools.call(m, name, **a))
    assert ask("types") == {"IfcOpeningElement": 1, "IfcWall": 1} and ask("storey_of", guid=wall) == "Storey0000000000000001"
    assert [r["ancestor_guid"] for r in ask("ancestors", guid=wall)["rows"]] == ["Storey0000000000000001", "Building00000000000001", "Site000000000000000001", "Project000000000000001"]
    assert ask("psets", guid=wall)["rows"][0]["value"] == "True" and ask("product", guid="none") is None
    net, gross = (m.mesh_qto(cut)[0].where(F.col("guid") == wall).first() for cut in (True, False))
    assert net.volume_m3 == pytest.approx(4 * 0.3 * 2.5 - 0.3) and gross.volume_m3 == pytest.approx(3.0)
    assert m.mesh(wall, "m").count() == 1 and m.segments().where("source = 'block'").count() == 2
    with pytest.raises(ValueError):
        tools.call(m, "no such tool")
    with pytest.raises(ValueError):
        m.hotswap(wall, [], [], str(tmp_path / "x"))
    with pytest.raises(ValueError):
        m.hotswap("none", [(0, 0, 0)] * 3, [(0, 1, 2)], str(tmp_path / "x"))
    stats = m.hotswap(wall, *[x.tolist() for x in solids.box(1000.0, 1000.0, 1000.0)], str(tmp_path / "swapped"))
    assert stats["records_gc"] == 1 and stats["records_new"] == 2
