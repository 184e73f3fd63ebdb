"""Parts as products with bodies, one of each form of solid, written as a STEP file and meshed again.

Sizes come from p_size, so the SQL beside each query states volumes and areas in closed form: circles are 32-sided in
profiles, solids of revolution have 24 sides, spheres 12 bands.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Model
from ..operators import geometry, meshes
from ..operators.durable import shared_dir
from ..operators.index import Tables
from ..sources import step
from .step_model import HEAD, guid

#: Records of one part's body: {b} is the first of its 100 step ids, {a} its size plus one.
#: Profiles stand at +20 and are 3 deep; +30 to +79 are free for each form; +10 is the item.
_PROFILES = {
    "rectangle": "RECTANGLEPROFILEDEF(.AREA.,$,$,{a}.,2.)",
    "rounded": "ROUNDEDRECTANGLEPROFILEDEF(.AREA.,$,$,{a}.,2.,0.5)",
    "hollow": "RECTANGLEHOLLOWPROFILEDEF(.AREA.,$,$,{a4}.,{a4}.,1.,$,$)",
    "circle": "CIRCLEPROFILEDEF(.AREA.,$,$,{a}.)",
    "ring": "CIRCLEHOLLOWPROFILEDEF(.AREA.,$,$,{a4}.,1.)",
    "ellipse": "ELLIPSEPROFILEDEF(.AREA.,$,$,{a}.,2.)",
    "i": "ISHAPEPROFILEDEF(.AREA.,$,$,{a4}.,{a4}.,1.,1.,$)",
    "l": "LSHAPEPROFILEDEF(.AREA.,$,$,{a4}.,{a4}.,1.,$,$,$)",
    "u": "USHAPEPROFILEDEF(.AREA.,$,$,{a4}.,{a4}.,1.,1.,$,$,$)",
    "t": "TSHAPEPROFILEDEF(.AREA.,$,$,{a4}.,{a4}.,1.,1.,$,$,$,$,$)",
    "z": "ZSHAPEPROFILEDEF(.AREA.,$,$,{a4}.,{a4}.,1.,1.,$,$)",
    "closed": "ARBITRARYCLOSEDPROFILEDEF(.AREA.,$,#{b+30});#{b+30}=IFCPOLYLINE((#{b+31},#{b+32},#{b+33},#{b+31}));#{b+31}=IFCCARTESIANPOINT((0.,0.));#{b+32}=IFCCARTESIANPOINT(({a}.,0.));#{b+33}=IFCCARTESIANPOINT((0.,2.))",
    "voided": "ARBITRARYPROFILEDEFWITHVOIDS(.AREA.,$,#{b+30},(#{b+40}));#{b+30}=IFCPOLYLINE((#{b+31},#{b+32},#{b+33},#{b+34},#{b+31}));#{b+31}=IFCCARTESIANPOINT((0.,0.));#{b+32}=IFCCARTESIANPOINT(({a4}.,0.));#{b+33}=IFCCARTESIANPOINT(({a4}.,{a4}.));#{b+34}=IFCCARTESIANPOINT((0.,{a4}.));"
    "#{b+40}=IFCPOLYLINE((#{b+41},#{b+42},#{b+43},#{b+44},#{b+41}));#{b+41}=IFCCARTESIANPOINT((1.,1.));#{b+42}=IFCCARTESIANPOINT((2.,1.));#{b+43}=IFCCARTESIANPOINT((2.,2.));#{b+44}=IFCCARTESIANPOINT((1.,2.))",
    "arc": "ARBITRARYCLOSEDPROFILEDEF(.AREA.,$,#{b+30});#{b+30}=IFCINDEXEDPOLYCURVE(#{b+31},(IFCLINEINDEX((1,2)),IFCARCINDEX((2,3,1))),.F.);#{b+31}=IFCCARTESIANPOINTLIST2D(((-{a}.,0.),({a}.,0.),(0.,{a}.)))",
    "composite": "ARBITRARYCLOSEDPROFILEDEF(.AREA.,$,#{b+30});#{b+30}=IFCCOMPOSITECURVE((#{b+31},#{b+32}),.F.);#{b+31}=IFCCOMPOSITECURVESEGMENT(.CONTINUOUS.,.T.,#{b+33});#{b+32}=IFCCOMPOSITECURVESEGMENT(.CONTINUOUS.,.F.,#{b+34});#{b+33}=IFCPOLYLINE((#{b+35},#{b+36},#{b+37}));"
    "#{b+34}=IFCPOLYLINE((#{b+35},#{b+38},#{b+37}));#{b+35}=IFCCARTESIANPOINT((0.,0.));#{b+36}=IFCCARTESIANPOINT(({a}.,0.));#{b+37}=IFCCARTESIANPOINT(({a}.,2.));#{b+38}=IFCCARTESIANPOINT((0.,2.))",
}
_CORNERS = "".join(f"#{{b+{30 + 4 * k + 2 * j + i}}}=IFCCARTESIANPOINT(({'{a}.' if i else '0.'},{'2.' if j else '0.'},{'3.' if k else '0.'}));" for k in (0, 1) for j in (0, 1) for i in (0, 1))
_SIDES = ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))
_SHELL = _CORNERS + "".join(f"#{{b+{40 + 3 * n}}}=IFCPOLYLOOP(({','.join(f'#{{b+{30 + c}}}' for c in side)}));#{{b+{41 + 3 * n}}}=IFCFACEOUTERBOUND(#{{b+{40 + 3 * n}}},.T.);#{{b+{42 + 3 * n}}}=IFCFACE((#{{b+{41 + 3 * n}}}));" for n, side in enumerate(_SIDES))
_FACES = ",".join(f"#{{b+{42 + 3 * n}}}" for n in range(6))
_BLOCK = "IFCBLOCK(#{b+21},{a}.,2.,3.);#{b+21}=IFCAXIS2PLACEMENT3D(#{b+22},$,$);#{b+22}=IFCCARTESIANPOINT((0.,0.,0.))"
_SECOND = "#{b+60}=IFCBLOCK(#{b+21},1.,1.,1.);"
_POINTS = "({})".format(",".join(f"({'{a}.' if i else '0.'},{'2.' if j else '0.'},{'3.' if k else '0.'})" for k in (0, 1) for j in (0, 1) for i in (0, 1)))
_BODIES = {name: f"IFCEXTRUDEDAREASOLID(#{{b+20}},$,#{{b+29}},3.);#{{b+29}}=IFCDIRECTION((0.,0.,1.));#{{b+20}}=IFC{text}" for name, text in _PROFILES.items()} | {
    "block": _BLOCK,
    "cylinder": "IFCRIGHTCIRCULARCYLINDER($,3.,{a}.)",
    "cone": "IFCRIGHTCIRCULARCONE($,3.,{a}.)",
    "sphere": "IFCSPHERE($,{a}.)",
    "pyramid": "IFCRECTANGULARPYRAMID($,{a}.,2.,3.)",
    "brep": "IFCFACETEDBREP(#{b+20});#{b+20}=IFCCLOSEDSHELL((" + _FACES + "));" + _SHELL[:-1],
    "fbsm": "IFCFACEBASEDSURFACEMODEL((#{b+20}));#{b+20}=IFCCONNECTEDFACESET((" + _FACES + "));" + _SHELL[:-1],
    "sbsm": "IFCSHELLBASEDSURFACEMODEL((#{b+20}));#{b+20}=IFCOPENSHELL((" + _FACES + "));" + _SHELL[:-1],
    "triangulated": "IFCTRIANGULATEDFACESET(#{b+20},$,.T.,(" + ",".join(f"({p[0] + 1},{p[1] + 1},{p[2] + 1}),({p[0] + 1},{p[2] + 1},{p[3] + 1})" for p in _SIDES) + "),$);#{b+20}=IFCCARTESIANPOINTLIST3D(" + _POINTS + ")",
    "polygonal": "IFCPOLYGONALFACESET(#{b+20},.T.,(" + ",".join(f"#{{b+{40 + n}}}" for n in range(6)) + "),$);#{b+20}=IFCCARTESIANPOINTLIST3D(" + _POINTS + ");" + ";".join(f"#{{b+{40 + n}}}=IFCINDEXEDPOLYGONALFACE(({','.join(str(c + 1) for c in side)}))" for n, side in enumerate(_SIDES)),
    "mapped": "IFCMAPPEDITEM(#{b+50},#{b+54});#{b+50}=IFCREPRESENTATIONMAP(#{b+21},#{b+51});#{b+51}=IFCSHAPEREPRESENTATION($,'Body','CSG',(#{b+53}));#{b+54}=IFCCARTESIANTRANSFORMATIONOPERATOR3D($,$,#{b+22},2.,$);#{b+53}=" + _BLOCK,
    "difference": "IFCBOOLEANCLIPPINGRESULT(.DIFFERENCE.,#{b+59},#{b+60});" + _SECOND + "#{b+59}=" + _BLOCK,
    "union": "IFCCSGSOLID(#{b+58});#{b+58}=IFCBOOLEANRESULT(.UNION.,#{b+59},#{b+60});" + _SECOND + "#{b+59}=" + _BLOCK,
    "halfspace": "IFCHALFSPACESOLID(#{b+50},.T.);#{b+50}=IFCPLANE(#{b+21});#{b+21}=IFCAXIS2PLACEMENT3D(#{b+22},$,$);#{b+22}=IFCCARTESIANPOINT((0.,0.,0.))",
    "revolved": "IFCREVOLVEDAREASOLID(#{b+20},$,#{b+50},6.283185307179586);#{b+20}=IFCRECTANGLEPROFILEDEF(.AREA.,$,#{b+23},2.,3.);#{b+23}=IFCAXIS2PLACEMENT2D(#{b+24},$);#{b+24}=IFCCARTESIANPOINT(({a4}.,0.));#{b+50}=IFCAXIS1PLACEMENT(#{b+51},#{b+52});#{b+51}=IFCCARTESIANPOINT((0.,0.,0.));#{b+52}=IFCDIRECTION((0.,1.,0.))",
    "curves": "IFCGEOMETRICCURVESET((#{b+50}));#{b+50}=IFCPOLYLINE((#{b+51},#{b+52}));#{b+51}=IFCCARTESIANPOINT((0.,0.));#{b+52}=IFCCARTESIANPOINT(({a}.,0.))",
    "bounded": "IFCPOLYGONALBOUNDEDHALFSPACE(#{b+50},.T.,#{b+21},#{b+30});#{b+50}=IFCPLANE(#{b+21});#{b+21}=IFCAXIS2PLACEMENT3D(#{b+22},$,$);#{b+22}=IFCCARTESIANPOINT((0.,0.,0.));#{b+30}=IFCPOLYLINE((#{b+31},#{b+32},#{b+33},#{b+34},#{b+31}));#{b+31}=IFCCARTESIANPOINT((0.,0.));#{b+32}=IFCCARTESIANPOINT(({a}.,0.));#{b+33}=IFCCARTESIANPOINT(({a}.,2.));#{b+34}=IFCCARTESIANPOINT((0.,2.))",
    "unknown": "IFCSURFACECURVESWEPTAREASOLID($,$,$,$,$,$)",
    "none": "",
}
FORMS = list(_BODIES)
ROOM, FIRST = 100, 1_000_000


def _body(text: str) -> F.Column:
    """A form's records with its numbers put in, for a row with b and a."""
    import re

    parts = []
    for piece in re.split(r"(\{[^}]*\})", text):
        if piece in ("{a}", "{a4}"):
            parts.append((F.col("a") + (4 if piece == "{a4}" else 0)).cast("string"))
        elif piece.startswith("{b"):
            parts.append((F.col("b") + int(piece[2:-1] or 0)).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, raw): a product for each part, its placement under a common one, and its body."""
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    rows = part.select("p_partkey", (F.col("p_partkey") * ROOM + FIRST).alias("b"), (F.col("p_size") + 1).alias("a"), (F.col("p_partkey") % len(FORMS)).cast("int").alias("form"))
    body = reduce(lambda acc, i: acc.when(F.col("form") == i, _body(_BODIES[FORMS[i]])), range(len(FORMS)), F.when(F.lit(False), ""))
    ref = lambda n: F.concat(F.lit("#"), (F.col("b") + n).cast("string"))
    g = F.concat(F.lit("'"), guid("B", "p_partkey"), F.lit("'"))
    bare = F.col("form") == FORMS.index("none")
    lines = F.concat_ws(
        ";", F.concat(ref(0), F.lit("=IFCBUILDINGELEMENTPROXY("), g, F.lit(",$,$,$,$,"), ref(1), F.lit(","), F.when(bare, "$").otherwise(ref(4)), F.lit(",$,$)")),
        F.concat(ref(1), F.lit("=IFCLOCALPLACEMENT(#11,"), ref(2), F.lit(")")), F.concat(ref(2), F.lit("=IFCAXIS2PLACEMENT3D("), ref(3), F.lit(",#14,#15)")), F.concat(ref(3), F.lit("=IFCCARTESIANPOINT(("), (F.col("p_partkey") % 7).cast("string"), F.lit(".,0.,0.))")),
        *[F.when(~bare, x) for x in (F.concat(ref(4), F.lit("=IFCPRODUCTDEFINITIONSHAPE($,$,("), ref(5), F.lit(","), ref(6), F.lit("))")), F.concat(ref(5), F.lit("=IFCSHAPEREPRESENTATION($,'Axis','Curve2D',(#16))")), F.concat(ref(6), F.lit("=IFCSHAPEREPRESENTATION($,'Body','Any',("), ref(10), F.lit("))")), F.concat(ref(10), F.lit("="), body))],
    )
    # Bodies hold no semicolon within a record, so they part records; no string of theirs holds one either.
    each = rows.select("b", F.posexplode(F.split(lines, ";")).alias("k", "line")).where("line <> ''").select((F.col("b") + F.col("k")).cast("long").alias("ord"), F.concat("line", F.lit(";")).alias("raw"))
    fixed = [
        "#1=IFCPROJECT('P000000000000000000000',$,'Project',$,$,$,$,$,#3);", "#2=IFCSIUNIT(*,.LENGTHUNIT.,$,.METRE.);", "#3=IFCUNITASSIGNMENT((#2));", "#11=IFCLOCALPLACEMENT($,#12);", "#12=IFCAXIS2PLACEMENT3D(#13,$,$);", "#13=IFCCARTESIANPOINT((10.,20.,30.));",
        "#14=IFCDIRECTION((0.,0.,1.));", "#15=IFCDIRECTION((0.,1.,0.));", "#16=IFCPOLYLINE((#17,#18));", "#17=IFCCARTESIANPOINT((0.,0.));", "#18=IFCCARTESIANPOINT((1.,0.));",
    ]
    return each.unionByName(spark.createDataFrame([(i, r) for i, r in enumerate(fixed)], "ord long, raw string"))


_files: dict[tuple[str, str], str] = {}
_tables: dict[tuple[str, str], Tables] = {}


def step_file(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _files:
        path = f"{shared_dir(spark)}/ashlar-step/shapes-{uuid.uuid4().hex}"
        step.write_step(records(spark, sf_dir), HEAD, path)
        _files[key] = path
    return _files[key]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = Tables(step.read_step(spark, step_file(spark, sf_dir)), "IFC4")
    return _tables[key]


def q_shape_take_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles, volume and area of each fragment of each product, in the product's own frame."""
    made = meshes.product_meshes(tables(spark, sf_dir), "local").where(~F.col("source").startswith("unhandled")).withColumn("guid", F.concat_ws("/", "guid", "source"))
    rows = geometry.take_off(geometry.triangles(made)).withColumn("p", F.split("guid", "/"))
    return rows.select(F.col("p")[0].alias("guid"), F.col("p")[1].alias("source"), (F.round("volume", 2) + 0.0).alias("volume"), (F.round("area", 2) + 0.0).alias("area"))


def q_shape_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in the world of the blocks, which are turned a quarter and moved by two placements."""
    made = meshes.product_meshes(tables(spark, sf_dir), "world").where("source = 'block'")
    return geometry.bounds(made).select("guid", *[F.round(f"{m}_{x}", 4).alias(f"{m}_{x}") for m in ("min", "max") for x in "xyz"], F.round("aabb_volume", 4).alias("aabb_volume"))


def q_shape_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume decision on each product's merged mesh: closed solids keep their own volume."""
    forms = [FORMS.index(f) for f in ("rectangle", "hollow", "circle", "i", "voided", "block", "cylinder", "cone", "pyramid", "brep", "fbsm", "sbsm", "triangulated", "polygonal", "mapped")]
    wanted = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet").where((F.col("p_partkey") % len(FORMS)).isin(*forms)).select(guid("B", "p_partkey").alias("guid"))
    whole = meshes.merged(meshes.product_meshes(tables(spark, sf_dir), "local").join(wanted, "guid", "left_semi"))
    return geometry.volumes(whole).select("guid", "mesh_quality", F.round("volume_m3", 2).alias("volume_m3"), "method")


def q_shape_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the merged meshes that have several."""
    sized = meshes.sized_fragments(tables(spark, sf_dir)).where(F.col("source").rlike("^(boolean_|csg_branch)"))
    return meshes.segments_of(sized).select("guid", F.col("segment_index").cast("int").alias("segment_index"), "source", F.col("index_start").cast("long").alias("index_start"), "triangle_count")


def q_shape_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without a mesh by reason, and all others."""
    t = tables(spark, sf_dir)
    items = meshes.body_items(t)
    made = meshes.item_meshes(t, items).groupBy("item_id").agg(F.bool_and(F.col("source").startswith("unhandled")).alias("unhandled"))
    rows = items.join(made, "item_id", "left").select("guid", F.coalesce("reason", F.when(F.col("unhandled"), "item_unhandled"), F.lit("meshed")).alias("reason"))
    return rows.groupBy("reason").agg(F.count_distinct("guid").alias("n"))


def q_shape_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments and triangles by provenance."""
    return meshes.by_source(meshes.product_meshes(tables(spark, sf_dir), "local"))


def q_shape_obj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of OBJ text of each block, as written and read again."""
    path = f"{shared_dir(spark)}/ashlar-step/obj-{uuid.uuid4().hex}"
    made = meshes.product_meshes(tables(spark, sf_dir), "world").where("source = 'block'")
    meshes.obj_text(meshes.merged(made)).orderBy("guid").coalesce(1).select("value").write.text(path)
    return spark.read.text(path).groupBy(F.substring("value", 1, 2).alias("line")).agg(F.count("*").alias("n"))


def q_shape_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-table layout as written and read through its view: instances, shapes, shared shapes and triangles."""
    from ..operators.substrate import read_view

    path = f"{shared_dir(spark)}/ashlar-step/bundle-{uuid.uuid4().hex}"
    Model(spark, step_file(spark, sf_dir)).bundle(path)
    view = read_view(spark, path)
    return view.agg(F.count("*").alias("instances"), F.count("rep_id").alias("shaped"), F.count_distinct("rep_id").alias("shapes"), F.sum(F.coalesce(F.size("indices") / 3, F.lit(0))).cast("long").alias("triangles"), F.sum(F.when(F.col("rep_id").isNotNull(), F.size("segments"))).cast("long").alias("segments"))


def q_shape_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each block's middle lies from its placement."""
    t = tables(spark, sf_dir)
    made = meshes.product_meshes(t, "world").where("source = 'block'")
    rows = meshes.drift_report(t, made)
    return rows.select("guid", F.round("drift_distance", 4).alias("drift_distance"), F.round("drift_ratio", 4).alias("drift_ratio"), "severity")


_G = "concat('B', lpad(CAST(p_partkey AS VARCHAR), 21, '0'))"
_R32, _R24 = "(16 * sin(2 * pi() / 32))", "(12 * sin(2 * pi() / 24))"
_P32, _P24 = "(64 * sin(pi() / 32))", "(48 * sin(pi() / 24))"
#: Source, volume and area of each form in terms of the size a and s = a + 4; prisms by their profile's area and outline.
_PRISMS = {
    "rectangle": ("a * 2", "2 * (a + 2)"), "rounded": ("a * 2", "2 * (a + 2)"), "hollow": ("s * s - (s - 2) * (s - 2)", "4 * s + 4 * (s - 2)"), "circle": (f"a * a * {_R32}", f"a * {_P32}"), "ring": (f"(s * s - (s - 1) * (s - 1)) * {_R32}", f"(2 * s - 1) * {_P32}"),
    "i": ("2 * s + (s - 2)", "4 * s + 2 * (s - 1)"), "l": ("s + (s - 1)", "4 * s"), "u": ("s + 2 * (s - 1)", "4 * s + 2 * (s - 1)"), "t": ("s + (s - 1)", "4 * s"), "z": ("s + 2 * (s - 1)", "4 * s + 2 * (s - 1)"), "closed": ("a", "a + 2 + sqrt(a * a + 4)"), "voided": ("s * s - 1", "4 * s + 4"),
    "arc": ("a * a * 8 * sin(pi() / 16)", "2 * a + a * 32 * sin(pi() / 32)"), "composite": ("a * 2", "2 * (a + 2)"),
}
_BOX = ("a * 6", "2 * (2 * a + 3 * a + 6)")
_SIDE24 = "sqrt(9 + power(a * cos(pi() / 24), 2))"
_RADIUS = "CASE WHEN {j} IN (0, 12) THEN 0 ELSE cos(pi() * ({j} / 12.0 - 0.5)) END"
_SOLIDS = {
    "block": ("block", *_BOX), "cylinder": ("rightcircularcylinder", f"3 * a * a * {_R24}", f"2 * a * a * {_R24} + 3 * a * {_P24}"), "cone": ("rightcircularcone", f"a * a * {_R24}", f"a * a * {_R24} + 0.5 * a * {_P24} * {_SIDE24}"), "pyramid": ("rectangularpyramid", "2 * a", "2 * a + a * sqrt(10) + 2 * sqrt(9 + a * a / 4.0)"),
    "brep": ("brep", *_BOX), "fbsm": ("faceset_fbsm", *_BOX), "sbsm": ("faceset_sbsm", *_BOX), "triangulated": ("faceset", *_BOX), "polygonal": ("faceset", *_BOX), "mapped": ("block", "48 * a", "8 * (2 * a + 3 * a + 6)"), "halfspace": ("halfspace_agree", "1.6e9", "2 * 1.6e9 + 4 * 40000"), "curves": ("curve_set", "0", "0"), "bounded": ("halfspace_bounded_agree", "a * 2 * 20000", "4 * a + 2 * (a + 2) * 20000"),
    "revolved": ("revolved", f"3 * (power(s + 1, 2) - power(s - 1, 2)) * {_R32}", f"2 * (power(s + 1, 2) - power(s - 1, 2)) * {_R32} + 3 * 2 * s * {_P32}"),
}
_ROWS = [(f, "extrusion", f"3 * ({area})", f"2 * ({area}) + 3 * ({line})") for f, (area, line) in _PRISMS.items()] + [(f, *x) for f, x in _SOLIDS.items()]
_ROWS += [(f, tag, v, s) for f, tags in (("difference", ("boolean_base|block", "boolean_cutter|block")), ("union", ("csg_branch|boolean_base|block", "csg_branch|boolean_added|block"))) for tag, (v, s) in zip(tags, (_BOX, ("1", "6")), strict=True)]
_BAND = "list_transform(range(0, 12), lambda j: {})"
_RJ = "(CASE WHEN j = 0 THEN 0 ELSE cos(pi() * (j / 12.0 - 0.5)) END)"
_RK = "(CASE WHEN j = 11 THEN 0 ELSE cos(pi() * ((j + 1) / 12.0 - 0.5)) END)"
_HJ = "(sin(pi() * ((j + 1) / 12.0 - 0.5)) - sin(pi() * (j / 12.0 - 0.5)))"
_SPHERE_V = f"a * a * a * {_R24} / 3 * list_sum(" + _BAND.format(f"{_HJ} * ({_RJ} * {_RJ} + {_RJ} * {_RK} + {_RK} * {_RK})") + ")"
_SPHERE_A = f"a * a * {_P24} / 2 * list_sum(" + _BAND.format(f"({_RJ} + {_RK}) * sqrt({_HJ} * {_HJ} + power(({_RJ} - {_RK}) * cos(pi() / 24), 2))") + ")"
_OVAL = "list_sum(list_transform(range(0, 32), lambda j: sqrt(power(a * (cos(2 * pi() * (j + 1) / 32) - cos(2 * pi() * j / 32)), 2) + power(2 * (sin(2 * pi() * (j + 1) / 32) - sin(2 * pi() * j / 32)), 2))))"
_ROWS.append(("ellipse", "extrusion", f"6 * a * {_R32}", f"4 * a * {_R32} + 3 * {_OVAL}"))
_ROWS.append(("sphere", "sphere", _SPHERE_V, _SPHERE_A))
_PARTS = f"WITH p AS (SELECT {_G} AS guid, p_partkey, CAST(p_size + 1 AS DOUBLE) AS a, CAST(p_size + 5 AS DOUBLE) AS s, p_partkey % {len(FORMS)} AS form FROM part), solids AS (" + " UNION ALL ".join(
    f"SELECT guid, p_partkey, form, '{tag}' AS source, CAST({v} AS DOUBLE) AS volume, CAST({s} AS DOUBLE) AS area FROM p WHERE form = {FORMS.index(f)}" for f, tag, v, s in _ROWS
) + ")\n"
_KEPT = ", ".join(str(FORMS.index(f)) for f in ("rectangle", "hollow", "circle", "i", "voided", "block", "cylinder", "cone", "pyramid", "brep", "fbsm", "sbsm", "triangulated", "polygonal", "mapped"))
_BLOCKS = f"form = {FORMS.index('block')} OR form = {FORMS.index('mapped')}"
_BY_FORM = lambda *forms: "form IN (" + ", ".join(str(FORMS.index(f)) for f in forms) + ")"
#: Triangles of the forms: a prism of n corners has 4n - 4, and each hole of m corners adds 4m + 4.
_FACETS = {
    "extrusion": {"rectangle": 12, "rounded": 12, "hollow": 32, "circle": 124, "ring": 256, "ellipse": 124, "i": 44, "l": 20, "u": 28, "t": 28, "z": 28, "closed": 8, "voided": 32, "arc": 64, "composite": 12}, "block": {"block": 12, "mapped": 12}, "rightcircularcylinder": {"cylinder": 96}, "rightcircularcone": {"cone": 48}, "sphere": {"sphere": 528}, "rectangularpyramid": {"pyramid": 6},
    "brep": {"brep": 12}, "faceset_fbsm": {"fbsm": 12}, "faceset_sbsm": {"sbsm": 12}, "faceset": {"triangulated": 12, "polygonal": 12}, "boolean_base|block": {"difference": 12}, "boolean_cutter|block": {"difference": 12}, "csg_branch|boolean_base|block": {"union": 12}, "csg_branch|boolean_added|block": {"union": 12},
    "halfspace_agree": {"halfspace": 12}, "halfspace_bounded_agree": {"bounded": 12}, "revolved": {"revolved": 256}, "curve_set": {"curves": 1}, "unhandled:IFCSURFACECURVESWEPTAREASOLID": {"unknown": 0},
}
_COUNTED = "counted AS (" + " UNION ALL ".join(f"SELECT '{source}' AS source, guid, CAST({n} AS BIGINT) AS triangles FROM p WHERE form = {FORMS.index(f)}" for source, forms in _FACETS.items() for f, n in forms.items()) + ")"
QUERIES = {f.__name__: f for f in (q_shape_take_off, q_shape_world, q_shape_volumes, q_shape_segments, q_shape_reasons, q_shape_sources, q_shape_obj, q_shape_bundle, q_shape_drift)}
SQL = {
    "q_shape_take_off": _PARTS + f"SELECT guid, source, round(volume, 2) + 0.0 AS volume, round(area, 2) + 0.0 AS area FROM solids",
    "q_shape_world": _PARTS + f"SELECT guid, 10.0 + p_partkey % 7 - 2 * k AS min_x, CAST(20 AS DOUBLE) AS min_y, CAST(30 AS DOUBLE) AS min_z, CAST(10 + p_partkey % 7 AS DOUBLE) AS max_x, 20 + a * k AS max_y, 30.0 + 3 * k AS max_z, 6 * a * k * k * k AS aabb_volume FROM (SELECT *, CAST(CASE form WHEN {FORMS.index('mapped')} THEN 2 ELSE 1 END AS DOUBLE) AS k FROM p WHERE {_BLOCKS})",
    "q_shape_volumes": _PARTS + f"SELECT guid, 'closed' AS mesh_quality, round(volume, 2) AS volume_m3, 'mesh' AS method FROM solids WHERE form IN ({_KEPT})",
    "q_shape_segments": _PARTS + f"SELECT guid, CAST(CASE WHEN source LIKE '%base%' THEN 0 ELSE 1 END AS INTEGER) AS segment_index, source, CAST(CASE WHEN source LIKE '%base%' THEN 0 ELSE 36 END AS BIGINT) AS index_start, CAST(12 AS BIGINT) AS triangle_count FROM solids WHERE {_BY_FORM('difference', 'union')}",
    "q_shape_reasons": _PARTS + f"SELECT CASE WHEN {_BY_FORM('none')} THEN 'no_representation' WHEN {_BY_FORM('unknown')} THEN 'item_unhandled' ELSE 'meshed' END AS reason, count(*) AS n FROM p GROUP BY ALL",
    "q_shape_obj": _PARTS + f"SELECT 'g ' AS line, count(*) AS n FROM p WHERE {_BLOCKS} UNION ALL SELECT 'v ', 8 * count(*) FROM p WHERE {_BLOCKS} UNION ALL SELECT 'f ', 12 * count(*) FROM p WHERE {_BLOCKS}",
    "q_shape_sources": _PARTS + f", {_COUNTED} SELECT source, count(*) AS fragments, count(DISTINCT guid) AS products, CAST(sum(triangles) AS BIGINT) AS triangles FROM counted GROUP BY source",
    "q_shape_bundle": _PARTS + f", {_COUNTED} SELECT (SELECT count(*) FROM p) AS instances, count(DISTINCT guid) AS shaped, count(DISTINCT guid) AS shapes, CAST(sum(triangles) AS BIGINT) AS triangles, count(*) AS segments FROM counted WHERE triangles > 0",
    "q_shape_drift": _PARTS + f"""SELECT guid, round(d, 4) AS drift_distance, round(d / ext, 4) AS drift_ratio, CASE WHEN d < 0.01 OR d / ext <= 2 THEN 'ok' WHEN d / ext <= 10 THEN 'warn' ELSE 'error' END AS severity
FROM (SELECT guid, k * sqrt(1 + a * a / 4 + 2.25) AS d, k * greatest(a, 3) AS ext FROM (SELECT *, CASE form WHEN {FORMS.index('mapped')} THEN 2.0 ELSE 1.0 END AS k FROM p WHERE {_BLOCKS}))""",
}
