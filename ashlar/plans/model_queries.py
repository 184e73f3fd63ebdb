"""The model object on the STEP files of the driver tables: caches, colours, glTF, body replacement, streams; with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Model
from ..functions.solids import box
from ..operators import geometry, gltf, styles
from ..operators.durable import durable, shared_dir
from ..operators.index import Tables
from ..sources import step
from ..streaming import net_stream, products_of, stream_records
from . import shape_model, step_model
from . import queries as q


def q_model_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table as read from a cache that was just written, with whether the cache held: as it is, with a table cut short, and made anew."""
    path, cache = step_model.step_file(spark, sf_dir), f"{shared_dir(spark)}/ashlar-cache/{uuid.uuid4().hex}"
    model = Model(spark, path, cache_dir=cache)
    before = model._cached()
    model.write_cache()
    kept = Model(spark, path, cache_dir=cache)
    valid = kept._cached()
    names = ("products", "storeys", "voids", "psets", "quantities")
    rows = [(name, kept.table(name).count()) for name in names]
    voids = f"{cache}/{kept.header['cache_key']}/voids"
    first = kept.table("voids").first()
    short = durable(kept.table("voids").where(F.col("opening_guid") != (first.opening_guid if first else "")))
    short.write.mode("overwrite").parquet(voids)
    damaged = Model(spark, path, cache_dir=cache)._cached()
    return spark.createDataFrame([(name, n, before, valid, damaged) for name, n in rows], "name string, n long, before boolean, valid boolean, damaged boolean")


def q_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of a model's own answers: unit, duplicates, kin of one product, a product card, a difference to itself."""
    m = Model(spark, step_model.step_file(spark, sf_dir), strict=True)
    c = "C" + "4".zfill(21)
    card, diff = m.card(c, 3), m.diff(m)
    answers = {
        "unit": m.length_unit, "resolved": m.unit_resolved, "duplicates": m.duplicate_step_ids, "ancestors": m.ancestors(c).count(), "descendants": m.descendants(c).count(), "products_in": m.products_in(c).count(), "psets": len(card["psets"]), "truncated": card["psets_truncated"],
        "added": diff["added"], "changed": diff["changed"], "deltas": len(diff["type_deltas"]), "walls": m.by_type("ifcwall").count(), "counted": m.filter(mode="count").count(),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in answers.items()], "name string, value string")


def _coloured(spark: SparkSession, sf_dir: str) -> Tables:
    """The shapes with a styled item on each block, and a styled material on the products without one by their part key."""
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet").select("p_partkey", (F.col("p_partkey") * shape_model.ROOM + shape_model.FIRST).alias("b"), (F.col("p_size") % 5).alias("k"), (F.col("p_partkey") % len(shape_model.FORMS)).alias("form"))
    line = lambda n, *text: F.concat(F.lit("#"), (F.col("b") + n).cast("string"), *[F.lit(t) if isinstance(t, str) else t for t in text], F.lit(";"))
    ref = lambda n: F.concat(F.lit("#"), (F.col("b") + n).cast("string"))
    styled = part.where(F.col("form") == shape_model.FORMS.index("block")).select("b", F.posexplode(F.array(
        line(90, "=IFCSTYLEDITEM(", ref(10), ",(", ref(91), "),$)"), line(91, "=IFCPRESENTATIONSTYLEASSIGNMENT((", ref(92), "))"), line(92, "=IFCSURFACESTYLE($,.BOTH.,(", ref(93), "))"),
        line(93, "=IFCSURFACESTYLERENDERING(", ref(94), ",0.25,$,$,$,$,$,$,.FLAT.)"), line(94, "=IFCCOLOURRGB($,", (F.col("k") / 10 + F.lit(0.8)).cast("decimal(3,1)").cast("string"), ",0.5,0.)"),
    )).alias("i", "raw"))
    brown = [
        "#30=IFCMATERIAL('brown',$,$);", "#31=IFCMATERIALDEFINITIONREPRESENTATION($,$,(#32),#30);", "#32=IFCSTYLEDREPRESENTATION($,$,$,(#33));", "#33=IFCSTYLEDITEM($,(#34),$);", "#34=IFCSURFACESTYLE($,.BOTH.,(#35));", "#35=IFCSURFACESTYLESHADING(#36,$);", "#36=IFCCOLOURRGB($,0.4,0.2,0.1);",
    ]
    refs = part.where("p_partkey % 2 = 0").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: F.concat(F.lit("#"), b.cast("string"))), ",").alias("refs"))
    of = refs.select(F.lit(60).cast("long").alias("ord"), F.concat(F.lit("#37=IFCRELASSOCIATESMATERIAL('m000000000000000000000',$,$,$,("), "refs", F.lit("),#30);")).alias("raw"))
    more = styled.select((F.col("b") + 90 + F.col("i")).cast("long").alias("ord"), "raw").unionByName(spark.createDataFrame([(50 + i, r) for i, r in enumerate(brown)], "ord long, raw string")).unionByName(of)
    path = f"{shared_dir(spark)}/ashlar-step/colours-{uuid.uuid4().hex}"
    step.write_step(shape_model.records(spark, sf_dir).unionByName(more), step_model.HEAD, path)
    return Tables(step.read_step(spark, path), "IFC4")


def q_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each coloured product's colour: its item's, else its material's; parts are cut to 0 .. 1."""
    from ..operators import meshes

    t = _coloured(spark, sf_dir)
    items = meshes.body_items(t).where("item_id IS NOT NULL")
    return styles.product_colours(t, items).select("guid", *[F.round(F.col("colour")[i], 4).alias(c) for i, c in enumerate(("red", "green", "blue", "opacity"))])


def q_gltf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a written .glb holds: nodes, meshes, triangles and bytes that its accessors account for."""
    path = f"{shared_dir(spark)}/ashlar-gltf/{uuid.uuid4().hex}.glb"
    Model(spark, shape_model.step_file(spark, sf_dir)).write_gltf(path)
    files, inner = step.store(path)
    with files.open_input_stream(inner) as f:
        head, body = gltf.read_glb(f.read(), without=("name", "extras", "matrix", "attributes"))
    triangles = sum(head["accessors"][p["indices"]]["count"] // 3 for m in head["meshes"] for p in m["primitives"])
    whole = sum(v["byteLength"] + -v["byteLength"] % 4 for v in head["bufferViews"]) == len(body) == head["buffers"][0]["byteLength"]
    return spark.createDataFrame([(len(head["nodes"]), len(head["meshes"]), triangles, whole)], "nodes long, meshes long, triangles long, whole boolean")


def q_hotswap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box in place of one part's body in the written file: records gone and new, and the take-off of what is read back."""
    path = f"{shared_dir(spark)}/ashlar-step/swapped-{uuid.uuid4().hex}"
    at = shape_model.FORMS.index("closed")
    wanted = "B" + str(at).zfill(21)
    v, f = box(2.0, 3.0, 4.0)
    model = Model(spark, shape_model.step_file(spark, sf_dir))
    stats = model.hotswap(wanted, v.tolist(), f.tolist(), path)
    from ..operators import meshes

    again = Tables(step.read_step(spark, path), "IFC4")
    made = geometry.take_off(geometry.triangles(meshes.product_meshes(again, "local", [wanted])))
    counts = again.records.agg(F.count("*").alias("n")).crossJoin(F.broadcast(model.tables.records.agg(F.count("*").alias("n_before"))))  # one row each
    return made.crossJoin(F.broadcast(counts)).select("guid", F.round("volume", 4).alias("volume"), F.round("area", 4).alias("area"), F.lit(stats["records_gc"]).cast("long").alias("records_gc"), F.lit(stats["records_new"]).cast("long").alias("records_new"), (F.col("n_before") - F.col("n")).alias("fewer"))


def q_stream_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of files that arrive in a folder, all files of a micro-batch at once."""
    base = f"{shared_dir(spark)}/ashlar-stream/{uuid.uuid4().hex}"
    step.write_step(step_model.records(spark, sf_dir), step_model.HEAD, f"{base}/in", part=8 << 20, apart=True)
    stream_records(spark, f"{base}/in/part-*").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/marks").trigger(availableNow=True).start().awaitTermination()
    return products_of(spark.read.parquet(f"{base}/out")).groupBy("entity", "mode").agg(F.count("*").alias("n"))


def q_stream_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and their openings from a stream, one file each, the openings first: boxes with a corner cut off."""
    base = f"{shared_dir(spark)}/ashlar-stream/{uuid.uuid4().hex}"
    corners, indices = geometry.box_mesh(1.0, 1.0, 1.0)
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("guid"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("a"))
    idx = F.array(*[F.lit(i).cast("bigint") for i in indices])
    part = lambda role, size: rows.select("guid", F.lit(role).alias("role"), F.lit(1).cast("long").alias("item"), F.lit(role).alias("source"), F.transform(F.array(*map(F.lit, corners)), lambda c: c * size).alias("vertices"), idx.alias("indices"), F.lit(1).cast("long").alias("expected"))
    part("opening", F.col("a") / 2).write.parquet(f"{base}/in/k=1")
    part("host", F.col("a")).write.parquet(f"{base}/in/k=2")
    shape = "guid string, role string, item long, source string, vertices array<double>, indices array<bigint>, expected long"
    arriving = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/k=*")
    net_stream(arriving).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/marks").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("guid string, vertices array<double>, indices array<bigint>, outcome string").parquet(f"{base}/out")
    took = geometry.take_off(geometry.triangles(out))
    return out.select("guid", "outcome").join(took, "guid").select("guid", "outcome", F.round("volume", 4).alias("volume"), F.round("area", 4).alias("area"))


_C = "concat('C', lpad(CAST({} AS VARCHAR), 21, '0'))"
_B, _M, _P = (shape_model.FORMS.index(f) for f in ("block", "mapped", "closed"))
_K = "greatest(0.0, least(1.0, 0.8 + p_size % 5 / 10.0))"
QUERIES = {f.__name__: f for f in (q_model_cache, q_model_summary, q_colours, q_gltf, q_hotswap_text, q_stream_products, q_stream_cuts)}
SQL = {
    "q_model_cache": "SELECT *, false AS before, true AS valid, false AS damaged FROM (SELECT 'products' AS name, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'storeys', count(*) FROM supplier UNION ALL SELECT 'voids', count(*) FROM orders WHERE o_orderpriority = '2-HIGH' "
    "UNION ALL SELECT 'psets', 5 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) + (SELECT count(*) + count(*) FILTER (WHERE c_custkey % 3 <> 0) FROM customer JOIN part ON p_partkey = c_custkey) UNION ALL SELECT 'quantities', 2 * count(*) FROM orders)",
    "q_model_summary": "WITH o AS (SELECT count(*) AS n FROM orders WHERE o_custkey = 4) SELECT * FROM (VALUES ('unit', 'ft'), ('resolved', 'True'), ('ancestors', '4'), ('psets', '3'), ('truncated', 'True'), ('added', '0'), ('changed', '0'), ('deltas', '0')) t(name, value) UNION ALL SELECT 'duplicates', CAST(count(*) AS VARCHAR) FROM region UNION ALL SELECT 'descendants', CAST(n AS VARCHAR) FROM o UNION ALL SELECT 'products_in', CAST(n AS VARCHAR) FROM o "
    "UNION ALL SELECT 'walls', CAST((SELECT count(*) FROM customer WHERE c_mktsegment = 'AUTOMOBILE') + (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS VARCHAR) UNION ALL SELECT 'counted', CAST((SELECT count(*) FROM customer WHERE c_mktsegment IN ('FURNITURE', 'HOUSEHOLD')) + (SELECT count(*) FROM orders WHERE o_orderpriority = '5-LOW') AS VARCHAR)",
    "q_colours": f"SELECT concat('B', lpad(CAST(p_partkey AS VARCHAR), 21, '0')) AS guid, CAST(CASE WHEN p_partkey % {len(shape_model.FORMS)} = {_B} THEN {_K} ELSE 0.4 END AS DOUBLE) AS red, CAST(CASE WHEN p_partkey % {len(shape_model.FORMS)} = {_B} THEN 0.5 ELSE 0.2 END AS DOUBLE) AS green, CAST(CASE WHEN p_partkey % {len(shape_model.FORMS)} = {_B} THEN 0 ELSE 0.1 END AS DOUBLE) AS blue, CAST(CASE WHEN p_partkey % {len(shape_model.FORMS)} = {_B} THEN 0.75 ELSE 1 END AS DOUBLE) AS opacity FROM part WHERE p_partkey % 2 = 0 OR p_partkey % {len(shape_model.FORMS)} = {_B}",
    "q_gltf": shape_model._PARTS + f", {shape_model._COUNTED} SELECT count(DISTINCT guid) AS nodes, count(DISTINCT guid) AS meshes, CAST(sum(triangles) AS BIGINT) AS triangles, true AS whole FROM counted WHERE triangles > 0",
    # The profile's prism goes with its direction, profile, polyline and three points; the set and its points come in.
    "q_hotswap_text": f"SELECT concat('B', lpad('{_P}', 21, '0')) AS guid, CAST(24 AS DOUBLE) AS volume, CAST(52 AS DOUBLE) AS area, CAST(7 AS BIGINT) AS records_gc, CAST(2 AS BIGINT) AS records_new, CAST(5 AS BIGINT) AS fewer",
    "q_stream_products": step_model.STEP_SQL + f"SELECT entity, {step_model._MODES} AS mode, count(*) AS n FROM products GROUP BY ALL",
    "q_stream_cuts": "SELECT concat('S', s_suppkey) AS guid, 'cut' AS outcome, round(a * a * a * 7 / 8, 4) AS volume, round(6 * a * a, 4) AS area FROM (SELECT s_suppkey, CAST(s_suppkey % 5 + 1 AS DOUBLE) AS a FROM supplier)",
}
