"""STEP text from end to end: own small files with rows worked out by hand."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.api import open_model
from ashlar.functions import solids
from ashlar.functions import step_text as st
from ashlar.operators import geometry, meshes
from ashlar.operators.index import Tables
from ashlar.sources import step

HEAD = "ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION(('a','b'),'2;1');\nFILE_NAME('m.ifc','2024-01-01T00:00:00',('me'),('org'),'pre','sys','auth');\nFILE_SCHEMA(('{schema}'));\nENDSEC;\nDATA;\n"


def guid(n):
    return f"{n:022d}"


def write(path, body, schema="IFC4", end="ENDSEC;\nEND-ISO-10303-21;\n"):
    path.write_bytes((HEAD.format(schema=schema) + body + end).encode("utf-8"))
    return str(path)


SPINE = f"""#1=IFCPROJECT('{guid(1)}',$,'P',$,$,$,$,(),#8);
#2=IFCSITE('{guid(2)}',$,'Site',$,$,$,$,$,.ELEMENT.,$,$,0.,$,$);
#3=IFCBUILDING('{guid(3)}',$,'B',$,$,$,$,$,.ELEMENT.,$,$,$);
#4=IFCBUILDINGSTOREY('{guid(4)}',$,'Ground',$,$,$,$,$,.ELEMENT.,0.);
#5=IFCBUILDINGSTOREY('{guid(5)}',$,'First',$,$,$,$,$,.ELEMENT.,3000.);
#6=IFCRELAGGREGATES('{guid(6)}',$,$,$,#1,(#2));
#7=IFCRELAGGREGATES('{guid(7)}',$,$,$,#2,(#3));
#8=IFCUNITASSIGNMENT((#9,#19));
#9=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.);
#19=IFCSIUNIT(*,.AREAUNIT.,$,.SQUARE_METRE.);
#10=IFCRELAGGREGATES('{guid(10)}',$,$,$,#3,(#4,#5));
#11=IFCWALL('{guid(11)}',$,'W1',$,'Basic wall',#70,#60,'t1',.SOLIDWALL.);
#12=IFCWALL('{guid(12)}',$,'W; ''2''/* no comment */',$,$,$,$,'t2',$);
#13=IFCSLAB('{guid(13)}',$,'S\\X2\\00E50061\\X0\\\\X\\E5\\S\\e',$,$,$,$,$,.FLOOR.);
#14=IFCRELCONTAINEDINSPATIALSTRUCTURE('{guid(14)}',$,$,$,(#11,#12),#4);
#15=IFCRELCONTAINEDINSPATIALSTRUCTURE('{guid(15)}',$,$,$,(#13),#5); /* ENDSEC; #99=IFCWALL('x'); */
#16=IFCBUILDINGELEMENTPART('{guid(16)}',$,'Part',$,$,$,$,$,$);
#17=IFCRELAGGREGATES('{guid(17)}',$,$,$,#11,(#16));
"""
FACTS = f"""#20=IFCPROPERTYSINGLEVALUE('IsExternal',$,IFCBOOLEAN(.T.),$);
#21=IFCPROPERTYSINGLEVALUE('Fire',$,IFCLABEL('EI''60'),$);
#22=IFCPROPERTYENUMERATEDVALUE('Status',$,(IFCLABEL('NEW'),IFCLABEL('OLD')),$);
#23=IFCPROPERTYBOUNDEDVALUE('Temp',$,IFCREAL(30.),IFCREAL(10.),$,IFCREAL(20.));
#24=IFCPROPERTYTABLEVALUE('Curve',$,(IFCREAL(1.),IFCREAL(2.)),(IFCREAL(5.),IFCREAL(6.)),$,$,$,$);
#25=IFCCOMPLEXPROPERTY('Group',$,'use',(#21,#20));
#26=IFCPROPERTYSET('{guid(26)}',$,'Pset_WallCommon',$,(#20,#21,#22,#23,#24,#25));
#27=IFCRELDEFINESBYPROPERTIES('{guid(27)}',$,$,$,(#11),#26);
#28=IFCPROPERTYSINGLEVALUE('IsExternal',$,IFCBOOLEAN(.F.),$);
#29=IFCPROPERTYSINGLEVALUE('Extra',$,IFCINTEGER(7),$);
#30=IFCPROPERTYSET('{guid(30)}',$,'Pset_WallCommon',$,(#28,#29));
#31=IFCWALLTYPE('{guid(31)}',$,'Type A',$,$,(#30),$,$,$,.SOLIDWALL.);
#32=IFCRELDEFINESBYTYPE('{guid(32)}',$,$,$,(#11,#12),#31);
#33=IFCQUANTITYLENGTH('Length',$,$,5.,$);
#34=IFCQUANTITYAREA('Area',$,#19,7.5,$);
#35=IFCQUANTITYCOUNT('N',$,$,12.,$);
#36=IFCPHYSICALCOMPLEXQUANTITY('Layers',$,(#33),'d',$,$);
#37=IFCELEMENTQUANTITY('{guid(37)}',$,'Qto',$,$,(#33,#34,#35,#36));
#38=IFCRELDEFINESBYPROPERTIES('{guid(38)}',$,$,$,(#11),#37);
#40=IFCMATERIAL('Concrete',$,$);
#41=IFCMATERIAL('Wool',$,$);
#42=IFCMATERIALLAYER(#40,100.,$,$,$,$,$);
#43=IFCMATERIALLAYER(#41,13.,$,$,$,$,$);
#44=IFCMATERIALLAYERSET((#42,#43),'set',$);
#45=IFCMATERIALLAYERSETUSAGE(#44,.AXIS2.,.POSITIVE.,0.,$);
#46=IFCRELASSOCIATESMATERIAL('{guid(46)}',$,$,$,(#11),#45);
#47=IFCRELASSOCIATESMATERIAL('{guid(47)}',$,$,$,(#12),#40);
#48=IFCRELASSOCIATESMATERIAL('{guid(48)}',$,$,$,(#13),#19);
#50=IFCCLASSIFICATION('src','ed',$,'NS 3451',$,$,$);
#51=IFCCLASSIFICATIONREFERENCE($,'2','Top',#50,$,$);
#52=IFCCLASSIFICATIONREFERENCE('loc','23','Sub',#51,$,$);
#53=IFCCLASSIFICATIONREFERENCE($,'9','Loop',#53,$,$);
#54=IFCRELASSOCIATESCLASSIFICATION('{guid(54)}',$,$,$,(#11),#52);
#55=IFCRELASSOCIATESCLASSIFICATION('{guid(55)}',$,$,$,(#12),#53);
#56=IFCRELASSOCIATESCLASSIFICATION('{guid(56)}',$,$,$,(#13),#50);
"""
SHAPE = """#60=IFCPRODUCTDEFINITIONSHAPE($,$,(#61));
#61=IFCSHAPEREPRESENTATION($,'Body','SweptSolid',(#62));
#62=IFCEXTRUDEDAREASOLID(#63,$,#65,4.);
#63=IFCRECTANGLEPROFILEDEF(.AREA.,$,$,2.,3.);
#65=IFCDIRECTION((0.,0.,1.));
#70=IFCLOCALPLACEMENT(#71,#72);
#71=IFCLOCALPLACEMENT($,#73);
#72=IFCAXIS2PLACEMENT3D(#74,$,$);
#73=IFCAXIS2PLACEMENT3D(#75,#65,#76);
#74=IFCCARTESIANPOINT((1.,0.,0.));
#75=IFCCARTESIANPOINT((10.,20.,30.));
#76=IFCDIRECTION((0.,1.,0.));
"""


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = write(tmp_path_factory.mktemp("ifc") / "m.ifc", SPINE + FACTS + SHAPE)
    return open_model(spark, path)


def test_records_and_header(model, spark, tmp_path):
    assert model.records.count() == len([x for x in (SPINE + FACTS + SHAPE).splitlines() if x.startswith("#")])
    assert model.header["schema"] == "IFC4" and model.header["description"] == ["a", "b"] and model.header["originating_system"] == "sys"
    walls = step.read_step(spark, model.path).where("type = 'IFCWALL'")
    assert walls.count() == 2
    packed = tmp_path / "m.ifczip"
    with zipfile.ZipFile(packed, "w") as z:
        z.write(model.path, "inner.ifc")
        z.writestr("note.txt", "x" * 10_000)
    assert step.read_step(spark, str(packed)).count() == model.records.count() == step.read_step_anywhere(spark, str(packed)).count()
    cut = write(tmp_path / "cut.ifc", SPINE, end="")
    with pytest.raises(Exception, match="truncated"):
        step.read_step(spark, cut).count()


def test_products_and_graph(model):
    rows = {r.guid: r for r in model.products.collect()}
    assert rows[guid(12)].name == "W; '2'/* no comment */" and rows[guid(13)].name == "Såaåå"
    assert (rows[guid(11)].predefined_type, rows[guid(12)].predefined_type) == ("SOLIDWALL", None)
    assert {g: r.storey_guid for g, r in rows.items()} == {guid(11): guid(4), guid(12): guid(4), guid(13): guid(5), guid(16): guid(4)}
    assert (rows[guid(11)].type_name, rows[guid(11)].type_source, rows[guid(13)].type_source) == ("Type A", "ifctype", "none")
    assert {r.guid: r.elevation for r in model.storeys.collect()} == {guid(4): 0.0, guid(5): 3000.0}
    assert [r.ancestor_guid for r in model.ancestors(guid(16)).collect()] == [guid(11), guid(4), guid(3), guid(2), guid(1)]
    assert {r.descendant_guid for r in model.products_in(guid(3)).collect()} == {guid(k) for k in (11, 12, 13, 16)}
    assert model.unit_scale == 0.001 and model.length_unit == "mm" and model.duplicate_step_ids == 0
    assert model.by_type("ifcwall").count() == 2 and model.filter(mode="count").count() == 1
    with pytest.raises(ValueError):
        model.filter(mode="nope")
    with pytest.raises(ValueError):
        model.by_type("IfcNothing")


def test_property_rows(model):
    rows = {(r.guid, r.prop_name): (r.value, r.value_type, r.source) for r in model.psets.collect()}
    w = guid(11)
    assert rows[w, "IsExternal"] == ("True", "IFCBOOLEAN", "instance") and rows[w, "Fire"][0] == "EI'60"
    assert rows[w, "Status"][0] == "NEW, OLD" and rows[w, "Temp"][0] == "10...30.@20." and rows[w, "Curve"][0] == "1.=>5., 2.=>6."
    assert rows[w, "Group.Fire"][0] == "EI'60" and rows[w, "Group.IsExternal"][0] == "True"
    assert rows[w, "Extra"] == ("7", "IFCINTEGER", "type") and rows[guid(12), "IsExternal"] == ("False", "IFCBOOLEAN", "type")
    q = {(r.guid, r.quantity_name): (r.value, r.quantity_type, r.unit_step_id) for r in model.quantities.collect()}
    assert q == {(w, "Length"): ("5", "Length", 9), (w, "Area"): ("7.5", "Area", 19), (w, "N"): ("12", "Count", None), (w, "Layers.Length"): ("5", "Length", 9)}


def test_material_and_classification_rows(model):
    m = sorted((r.guid, r.role, r.layer_index, r.material_name, r.layer_thickness_mm and round(r.layer_thickness_mm, 6)) for r in model.materials.collect() if r.guid != guid(13))
    assert m == [(guid(11), "layer", 0, "Concrete", 100.0), (guid(11), "layer", 1, "Wool", 13.0), (guid(12), "direct", -1, "Concrete", None)]
    assert [(r.role, r.material_name) for r in model.materials.where(F.col("guid") == guid(13)).collect()] == [("unknown", None)]
    c = {r.guid: (r.system_name, r.identification) for r in model.classifications.collect()}
    assert c == {guid(11): ("NS 3451", "23"), guid(12): (None, "9"), guid(13): ("NS 3451", None)}


def test_meshes_and_take_off(model):
    world = model.meshes().collect()
    assert [r.source for r in world] == ["extrusion"]
    v = np.array(world[0].vertices).reshape(-1, 3)
    assert np.allclose(v.min(0), [8.5, 20, 30]) and np.allclose(v.max(0), [11.5, 22, 34])
    products, found = model.mesh_qto()
    row = products.first()
    assert row.mesh_quality == "closed" and row.volume == pytest.approx(24e-9) and row.area == pytest.approx(52e-6)
    assert found.count() == 6


def test_cache_summary_diff_and_subset(model, spark, tmp_path):
    again = open_model(spark, model.path, cache_dir=str(tmp_path / "cache"))
    again.write_cache()
    assert again._cached() and again.products.count() == 4
    assert model.summary()["products"] == 4 and model.schemas()["psets"]["value"] == "string"
    other = open_model(spark, write(tmp_path / "o.ifc", SPINE.replace("'W1'", "'W9'").replace(f"#13=IFCSLAB('{guid(13)}'", f"#13=IFCSLAB('{guid(99)}'") + FACTS))
    d = model.diff(other)
    assert (d["added"], d["removed"], d["changed"], d["added_guids"]) == (1, 1, 1, [guid(99)])
    assert model.diff(model) == {"added": 0, "added_guids": [], "removed": 0, "removed_guids": [], "changed": 0, "changed_guids": [], "type_deltas": {}}
    model.subset([guid(12)], str(tmp_path / "sub"))
    part = next((tmp_path / "sub").glob("*.txt"))
    small = open_model(spark, str(part))
    assert {r.guid for r in small.products.collect()} == {guid(12)}
    assert "(#12),#4" in part.read_text() and small.psets.count() == 2
    ids = {r.step_id for r in small.records.collect()}
    dangling = small.records.select(F.explode(st.all_refs(F.col("args"))).alias("r")).distinct().collect()
    assert {r.r for r in dangling} <= ids
    with pytest.raises(ValueError, match="unknown ids"):
        model.subset(["nope"], str(tmp_path / "no"))


def test_duplicates_and_units(spark, tmp_path):
    twice = open_model(spark, write(tmp_path / "d.ifc", f"#1=IFCWALL('{guid(1)}',$,'old',$,$,$,$,$,$);\n#1=IFCWALL('{guid(1)}',$,'new',$,$,$,$,$,$);\n"))
    assert [r.name for r in twice.products.collect()] == ["new"] and twice.duplicate_step_ids == 1
    foot = "#1=IFCUNITASSIGNMENT((#2));\n#2=IFCCONVERSIONBASEDUNIT(#5,.LENGTHUNIT.,'FOOT',#3);\n#3=IFCMEASUREWITHUNIT(IFCLENGTHMEASURE(0.3048),#4);\n#4=IFCSIUNIT(*,.LENGTHUNIT.,$,.METRE.);\n#5=IFCDIMENSIONALEXPONENTS(1,0,0,0,0,0,0);\n"
    assert open_model(spark, write(tmp_path / "f.ifc", foot)).unit_scale == pytest.approx(0.3048)
    broken = write(tmp_path / "b.ifc", foot.replace("#3=", "#33="))
    assert open_model(spark, broken).unit_scale is None
    with pytest.raises(ValueError):
        open_model(spark, broken, strict=True)
    door = f"#1=IFCDOOR('{guid(1)}',$,'d',$,$,$,$,'t',2.,1.,.DOOR.,.SINGLE.,$);\n#2=IFCWALL('{guid(2)}',$,'w',$,$,$,$,.X.);\n"
    assert {r.guid: r.predefined_type for r in open_model(spark, write(tmp_path / "n.ifc", door)).products.collect()}[guid(1)] == "DOOR"
    assert {r.predefined_type for r in open_model(spark, write(tmp_path / "o.ifc", door, "IFC2X3")).products.where("entity = 'IfcWall'").collect()} == {None}


@pytest.mark.parametrize(
    ("body", "root", "volume"),
    [
        ("#1=IFCBLOCK($,2.,3.,4.);", 1, 24),
        ("#1=IFCRIGHTCIRCULARCYLINDER($,2.,1.);", 1, 2 * 12 * np.sin(np.pi / 12)),
        ("#1=IFCRECTANGULARPYRAMID($,2.,3.,4.);", 1, 8),
        ("#1=IFCEXTRUDEDAREASOLID(#2,$,#3,5.);#2=IFCRECTANGLEHOLLOWPROFILEDEF(.AREA.,$,$,4.,4.,1.,$,$);#3=IFCDIRECTION((0.,0.,-1.));", 1, 60),
        ("#1=IFCEXTRUDEDAREASOLID(#2,$,#3,1.);#2=IFCISHAPEPROFILEDEF(.AREA.,$,$,4.,6.,1.,1.,$);#3=IFCDIRECTION((0.,0.,1.));", 1, 12),
        ("#1=IFCTRIANGULATEDFACESET(#2,$,.T.,((1,3,2),(1,2,4),(2,3,4),(1,4,3)),$);#2=IFCCARTESIANPOINTLIST3D(((0.,0.,0.),(1.,0.,0.),(0.,1.,0.),(0.,0.,1.)));", 1, 1 / 6),
        ("#1=IFCREVOLVEDAREASOLID(#2,$,#3,6.283185307179586);#2=IFCRECTANGLEPROFILEDEF(.AREA.,$,#6,1.,1.);#3=IFCAXIS1PLACEMENT(#4,#5);#4=IFCCARTESIANPOINT((0.,0.,0.));#5=IFCDIRECTION((0.,1.,0.));#6=IFCAXIS2PLACEMENT2D(#7,$);#7=IFCCARTESIANPOINT((2.,0.));", 1, 4 * np.pi),
    ],
)
def test_solids_have_their_volume(body, root, volume):
    records = {i: (t, a) for _, i, t, a, _ in step.scan(("DATA;\n" + body + "\nENDSEC;").encode())}
    ((_, v, t),) = solids.Items(records).mesh(root)
    c = v[t]
    got = np.einsum("ij,ij->", c[:, 0], np.cross(c[:, 1], c[:, 2])) / 6
    assert got == pytest.approx(volume, rel=0.01)


def test_geometry_states(spark):
    cube, faces = geometry.box_mesh(1, 1, 1)
    far = [x + 1e6 for x in cube]
    soup = [c for f in np.array(faces).reshape(-1, 3) for i in f for c in cube[3 * i : 3 * i + 3]]
    rows = [("cube", cube, faces), ("open", cube, faces[6:]), ("soup", soup, list(range(36))), ("far", far, faces), ("flat", [0.0, 0, 0, 1, 0, 0, 0, 1, 0], [0, 1, 2])]
    m = spark.createDataFrame([(g, [float(x) for x in v], i) for g, v, i in rows], "guid string, vertices array<double>, indices array<bigint>")
    assert {r.guid: r.mesh_quality for r in geometry.quality(m).collect()} == {"cube": "closed", "open": "open_shell", "soup": "closed", "far": "closed", "flat": "degenerate"}
    v = {r.guid: r for r in geometry.volumes(m).collect()}
    assert v["cube"].method == "mesh" and v["cube"].volume_m3 == pytest.approx(1) and v["far"].volume_m3 == pytest.approx(1)
    assert v["open"].prism_bound == pytest.approx(1, rel=0.02)
    s = geometry.surface_summary(geometry.surfaces(geometry.triangles(m))).where("guid = 'cube'").first()
    assert (s.surface_count, s.largest) == (6, pytest.approx(1))
    assert meshes.obj_text(m.where("guid = 'cube'")).first().value.count("\nf ") == 12


def test_clash_kinds(spark):
    from ashlar.operators import clash

    at = {"A": (0, 0, 0), "B": (0.5, 0.5, 0.5), "C": (1.5, 0.5, 0.5), "D": (0, 1.505, 0), "E": (50, 0, 0)}
    rows = [(i, g, "IfcWall", *geometry.box_mesh(1, 1, 1, p)) for i, (g, p) in enumerate(at.items())]
    m = spark.createDataFrame([(i, g, e, [float(x) for x in v], f) for i, g, e, v, f in rows], "id long, guid string, entity string, vertices array<double>, indices array<bigint>")
    boxes = geometry.bounds(m).join(m.select("id", "guid", "entity"), "guid")
    got = {(r.guid_a + r.guid_b): (r.kind, round(r.min_distance_m, 3)) for r in clash.clash(boxes, m.select("id", "vertices", "indices"), 0.01).collect()}
    assert got == {"AB": ("hard", 0.0), "BC": ("hard", 0.0), "BD": ("clearance", 0.005)}


def test_floors(spark):
    from ashlar.operators import summaries

    rows = spark.createDataFrame([("m", "Plan 01", 0.0, "a"), ("m", "Plan 01", 50.0, "b"), ("m", "Plan 02", 200.0, "c")], "model_name string, storey_name string, elevation_mm double, storey_guid string")
    clustered = summaries.cluster_elevations(rows, 100.0)
    assert {r.storey_guid: r.cluster for r in clustered.collect()} == {"a": 0, "b": 0, "c": 1}
    assert [(r.label, r.n) for r in summaries.floor_labels(clustered, prefix="C - ", overrides={"Plan 2": "Roof"}).orderBy("cluster").collect()] == [("C - Plan 1", 2), ("Roof", 1)]


def test_streamed_files(spark, tmp_path):
    from ashlar.streaming import index_stream

    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.ifc", SPINE)
    seen = []
    index_stream(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, _: seen.extend(r.guid for r in df.collect())).awaitTermination(120)
    assert set(seen) == {guid(k) for k in (11, 12, 13, 16)}


def test_tables_of_nothing(spark):
    empty = Tables(spark.createDataFrame([], step.RECORDS))
    assert empty.products().count() == 0 == empty.psets().count() and empty.unit_scale().first()[0] is None
