"""Parts as walls with windows and sloping ends, written as a STEP file, cut and taken off, with closed-form SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, openings
from ..operators.durable import durable, shared_dir
from ..operators.index import Tables
from ..sources import step
from .shape_model import FIRST, ROOM, _body
from .step_model import HEAD, guid

#: The wall is a by 1 by 3; windows are unit cubes through it. {b} is the part's first step id.
_WALL = "#{b}=IFCWALL({g},$,$,$,$,#{b+1},#{b+4},$,$);#{b+1}=IFCLOCALPLACEMENT($,#{b+2});#{b+2}=IFCAXIS2PLACEMENT3D(#{b+3},#14,#15);#{b+3}=IFCCARTESIANPOINT((7.,5.,0.));#{b+4}=IFCPRODUCTDEFINITIONSHAPE($,$,(#{b+5}));#{b+5}=IFCSHAPEREPRESENTATION($,'Body','Any',(#{b+6}));"
_BOX = "=IFCEXTRUDEDAREASOLID(#{b+20},#{b+23},#14,3.);#{b+20}=IFCRECTANGLEPROFILEDEF(.AREA.,$,#{b+21},{a}.,1.);#{b+21}=IFCAXIS2PLACEMENT2D(#{b+22},$);#{b+22}=IFCCARTESIANPOINT((0.,0.));#{b+23}=IFCAXIS2PLACEMENT3D(#13,$,$);"
_SLOPE = "#{b+6}=IFCBOOLEANCLIPPINGRESULT(.DIFFERENCE.,#{b+7},#{b+30});#{b+30}=IFCHALFSPACESOLID(#{b+31},.F.);#{b+31}=IFCPLANE(#{b+32});#{b+32}=IFCAXIS2PLACEMENT3D(#{b+33},$,$);#{b+33}=IFCCARTESIANPOINT((0.,0.,2.));"
_WINDOW = "#{b+%d}=IFCOPENINGELEMENT('%s{k}',$,$,$,$,#{b+%d},#{b+%d},$,$);#{b+%d}=IFCLOCALPLACEMENT(#{b+1},#{b+%d});#{b+%d}=IFCAXIS2PLACEMENT3D(#{b+%d},$,$);#{b+%d}=IFCCARTESIANPOINT((%s,0.,1.));#{b+%d}=IFCPRODUCTDEFINITIONSHAPE($,$,(#{b+%d}));#{b+%d}=IFCSHAPEREPRESENTATION($,'Body','CSG',(#16));#{b+%d}=IFCRELVOIDSELEMENT('%s{k}',$,$,$,#{b},#{b+%d});"


def _window(n: int, x: str) -> str:
    at = 40 + 10 * n
    return _WINDOW % (at, f"w{n}", at + 1, at + 4, at + 1, at + 2, at + 2, at + 3, at + 3, x, at + 4, at + 5, at + 5, at + 6, f"v{n}", at)


_FORMS = [_WALL + "#{b+6}" + _BOX + _window(0, "-1."), _WALL + "#{b+6}" + _BOX + _window(0, "-1.") + _window(1, "1."), _WALL + _SLOPE + "#{b+7}" + _BOX, _WALL + _SLOPE + "#{b+7}" + _BOX + _window(0, "-1."), _WALL + "#{b+6}" + _BOX]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    rows = part.select("p_partkey", (F.col("p_partkey") * ROOM + FIRST).alias("b"), (F.col("p_size") + 4).alias("a"), (F.col("p_partkey") % len(_FORMS)).cast("int").alias("form"))
    rows = rows.withColumns({"g": F.concat(F.lit("'"), guid("B", "p_partkey"), F.lit("'")), "k": F.lpad(F.col("p_partkey").cast("string"), 20, "0")})
    text = F.coalesce(*[F.when(F.col("form") == i, F.replace(F.replace(_body(t), F.lit("{g}"), F.col("g")), F.lit("{k}"), F.col("k"))) for i, t in enumerate(_FORMS)])
    each = rows.select("b", F.posexplode(F.split(text, ";")).alias("at", "line")).where("line <> ''").select((F.col("b") + F.col("at")).cast("long").alias("ord"), F.concat("line", F.lit(";")).alias("raw"))
    fixed = [
        "#1=IFCPROJECT('P000000000000000000000',$,'Project',$,$,$,$,$,#3);", "#2=IFCSIUNIT(*,.LENGTHUNIT.,$,.METRE.);", "#3=IFCUNITASSIGNMENT((#2));", "#13=IFCCARTESIANPOINT((0.,0.,0.));", "#14=IFCDIRECTION((0.,0.,1.));", "#15=IFCDIRECTION((0.,1.,0.));", "#16=IFCBLOCK(#17,1.,1.,1.);",
        "#17=IFCAXIS2PLACEMENT3D(#18,$,$);", "#18=IFCCARTESIANPOINT((-0.5,-0.5,-0.5));",
    ]
    return each.unionByName(spark.createDataFrame([(i, r) for i, r in enumerate(fixed)], "ord long, raw string"))


_net: dict[tuple[str, str], DataFrame] = {}


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _net:
        path = f"{shared_dir(spark)}/ashlar-step/cuts-{uuid.uuid4().hex}"
        step.write_step(records(spark, sf_dir), HEAD, path)
        _net[key] = durable(openings.net_meshes(Tables(step.read_step(spark, path), "IFC4")))
    return _net[key]


def q_net_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net volume and skin of each wall."""
    rows = geometry.take_off(geometry.triangles(_cut(spark, sf_dir)))
    return rows.select("guid", F.round("volume", 4).alias("volume"), F.round("area", 4).alias("area"), F.round("area_top", 4).alias("area_top"))


def q_cut_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openings.cut_stats(_cut(spark, sf_dir))


def q_halfspace_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the vectors cut by a sloping half-space that takes a known prism off each: what is left of their volume."""
    box, indices = geometry.box_mesh(1.0, 1.0, 1.0)
    slab, _ = geometry.box_mesh(40.0, 40.0, 1.0, (-20.0, -20.0, 0.0))
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select(F.concat(F.lit("M"), F.col("vec_id").cast("string")).alias("guid"), *[(F.abs(F.col("embedding")[k].cast("double")) + 0.1).alias(c) for k, c in enumerate("xyz")])
    idx = F.array(*[F.lit(i).cast("bigint") for i in indices])
    host = rows.select("guid", F.lit("host").alias("role"), F.lit(1).cast("long").alias("item"), F.lit("box").alias("source"), F.array(*[F.lit(c) * F.col("xyz"[i % 3]) for i, c in enumerate(box)]).alias("vertices"), idx.alias("indices"))
    # The solid lies above the plane z = height / 2 + x * height / (4 * width): a slab sheared along x.
    low = F.array(*[F.lit(c) if i % 3 < 2 else F.lit(c) + F.col("z") / 2 + F.lit(slab[i - 2]) * F.col("z") / 4 / F.col("x") for i, c in enumerate(slab)])
    cutter = rows.select("guid", F.lit("cutter"), F.lit(1).cast("long"), F.lit("boolean_cutter|wedge"), low, idx)
    none = F.lit(None).cast("array<double>")
    parts = host.union(cutter).withColumns({"frame": none, "host_frame": none})
    net = openings.cut_parts(parts)
    return geometry.take_off(geometry.triangles(net)).select("guid", F.round("volume", 6).alias("volume"))


_G = "concat('B', lpad(CAST(p_partkey AS VARCHAR), 21, '0'))"
_W = f"WITH w AS (SELECT {_G} AS guid, CAST(p_size + 4 AS DOUBLE) AS a, p_partkey % 5 AS form FROM part), s AS (SELECT *, CASE WHEN form IN (2, 3) THEN 2.0 ELSE 3.0 END AS h, CASE form WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n FROM w)"
QUERIES = {f.__name__: f for f in (q_net_walls, q_cut_outcomes, q_halfspace_clip)}
SQL = {
    # A window reaches from 0.5 to 1.5 in height and halfway out of neither face: it takes a unit cube, two unit faces, and gives four.
    "q_net_walls": _W + "SELECT guid, round(a * h - n, 4)::DOUBLE AS volume, round(2 * (a + a * h + h) - 2 * n + 4 * n, 4)::DOUBLE AS area, round(a + n, 4)::DOUBLE AS area_top FROM s",
    "q_cut_outcomes": _W + "SELECT CASE WHEN form = 4 THEN 'untouched' ELSE 'cut' END AS outcome, count(*) AS products, CAST(sum(n + CASE WHEN form IN (2, 3) THEN 1 ELSE 0 END) AS BIGINT) AS cutters FROM s GROUP BY ALL",
    "q_halfspace_clip": "SELECT concat('M', vec_id) AS guid, round(x * y * least(z, 5.0 / 8 * z), 6) AS volume FROM (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) + 0.1 AS x, abs(CAST(embedding[2] AS DOUBLE)) + 0.1 AS y, abs(CAST(embedding[3] AS DOUBLE)) + 0.1 AS z FROM embeddings)",
}
