"""Model: one STEP file's tables, graph, take-off and writers behind one object."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classes, units
from .operators import clash, facts, geometry, gltf, graph, meshes, openings, reports, styles, subset, substrate, summaries, swap
from .operators.durable import durable, once_each
from .operators.index import Tables
from .sources import step

#: The form of the cache; another one makes a cache void.
CACHE_LAYOUT = 2
FACTS = ("psets", "quantities", "materials", "classifications")
TABLES = ("products", "storeys", "aggregates", "contained_in", "storey_building", "voids", "types", "psets", "quantities", "materials", "classifications")


class Model:
    """Each table is worked out on first use and kept as a checkpoint."""

    def __init__(self, spark: SparkSession, path: str, strict: bool = False, cache_dir: str | None = None):
        self.spark, self.path, self.cache_dir = spark, path, cache_dir
        self._valid: bool | None = None
        self._about: tuple[str, Tables] | None = None
        self.header = step.header(path)
        self.records = durable(step.read_step(spark, path))
        self.tables = Tables(self.records, self.header["schema"] or "IFC4")
        if strict:
            self._check()

    def _check(self) -> None:
        if classes.resolve_schema(self.header["schema"]) is None:
            raise ValueError(f"unknown schema {self.header['schema']!r}")
        has = not self.records.where("type = 'IFCCONVERSIONBASEDUNIT' AND args LIKE '%LENGTHUNIT%'").isEmpty()
        if has and self.unit_scale is None:
            raise ValueError("the length unit does not resolve")

    def table(self, name: str) -> DataFrame:
        """A table by name, from the cache where it is valid."""
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
        if self.cache_dir and self._valid is None:
            self._valid = self._cached()
        if self.cache_dir and self._valid:
            return self.spark.read.parquet(f"{self._cache_path()}/{name}")
        return self.tables.denormalised() if name == "products" else getattr(self.tables, name)()

    def _cache_path(self) -> str:
        return f"{self.cache_dir.rstrip('/')}/{self.header['cache_key']}"

    def _cached(self) -> bool:
        """True if every gate holds: a manifest that parses, this layout, the file's size, time and key, and each table with its rows and columns.

        The tables are one unit: if one is missing, cut short or of other columns, none is used.
        """
        try:
            files, inner = step.store(f"{self._cache_path()}/manifest.json")
            with files.open_input_stream(inner) as f:
                kept = json.loads(f.read())
            if kept.get("layout") != CACHE_LAYOUT or any(kept.get(k) != self.header[k] for k in ("size_bytes", "mtime_ns", "cache_key", "schema")):
                return False
            for name in TABLES:
                rows = self.spark.read.parquet(f"{self._cache_path()}/{name}")
                if kept["tables"][name] != {"rows": rows.count(), "columns": rows.columns}:
                    return False
        except (OSError, ValueError, KeyError, TypeError, AnalysisException, Py4JJavaError):
            return False  # unreadable counts as absent: the tables are worked out anew
        return True

    def write_cache(self) -> str:
        """All tables as zstd Parquet under the file's key; the manifest comes last and makes them valid."""
        path, self_cached = self._cache_path(), self.cache_dir
        self.cache_dir = None
        files, inner = step.store(f"{path}/manifest.json")
        if files.get_file_info(inner).type.name == "File":
            files.delete_file(inner)
        held = {}
        try:
            for name in TABLES:
                self.table(name).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
                written = self.spark.read.parquet(f"{path}/{name}")
                held[name] = {"rows": written.count(), "columns": written.columns}
        finally:
            self.cache_dir = self_cached
        with files.open_output_stream(inner) as f:
            f.write(json.dumps({k: self.header[k] for k in ("size_bytes", "mtime_ns", "cache_key", "schema")} | {"layout": CACHE_LAYOUT, "tables": held}).encode())
        self._valid = None
        return path

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @property
    def unit_scale(self) -> float | None:
        return self.tables.unit_scale().first()[0]

    @property
    def length_unit(self) -> str:
        return units.name_of(self.unit_scale)

    @property
    def duplicate_step_ids(self) -> int:
        return step.duplicate_ids(self.records).agg(F.coalesce(F.sum("duplicates"), F.lit(0))).first()[0]

    # --- queries

    def types_count(self) -> DataFrame:
        return summaries.entity_counts(self.products)

    def filter(self, entity: str | None = None, mode: str | None = None, storey_guid: str | None = None) -> DataFrame:
        """Products that match each given value; unknown modes and entities raise."""
        if mode is not None and mode not in ("count", "measure", "linear", "skip"):
            raise ValueError(f"unknown mode {mode!r}")
        if entity is not None:
            classes.subtypes(entity, self.tables.schema)
        rows = self.products
        for column, value in (("entity", entity), ("mode", mode), ("storey_guid", storey_guid)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        return rows

    def by_type(self, entity: str, include_subtypes: bool = True) -> DataFrame:
        names = classes.subtypes(entity, self.tables.schema)
        return self.products.where(F.col("entity").isin(*(names if include_subtypes else [n for n in names if n.lower() == entity.lower()])))

    def product(self, guid: str) -> dict | None:
        row = self.products.where(F.col("guid") == guid).first()
        return row.asDict() if row else None

    def parent(self, guid: str) -> DataFrame:
        return self.tables.parent_of().where(F.col("guid") == guid)

    def children(self, guid: str) -> DataFrame:
        return self._children().where(F.col("parent_guid") == guid)

    def _children(self) -> DataFrame:
        """graph.children(), worked out once: a walk joins it level by level."""
        if "_children" not in self.tables.made:
            self.tables.made["_children"] = durable(graph.children(self.aggregates, self.contained_in))
        return self.tables.made["_children"]

    def ancestors(self, guid: str) -> DataFrame:
        up = self.tables.parent_of().select(F.col("guid").alias("src"), F.col("parent_guid").alias("dst"))
        return graph.reach_from(guid, up).select(F.col("src").alias("guid"), F.col("dst").alias("ancestor_guid"), "depth").orderBy("depth")

    def descendants(self, guid: str) -> DataFrame:
        down = self._children().select(F.col("parent_guid").alias("src"), F.col("child_guid").alias("dst"))
        return graph.reach_from(guid, down).select(F.col("src").alias("guid"), F.col("dst").alias("descendant_guid"), "depth").orderBy("depth", "descendant_guid")

    def products_in(self, guid: str) -> DataFrame:
        return graph.products_in(self.descendants(guid), self.products)

    def storey_of(self, guid: str) -> str | None:
        row = self.products.where(F.col("guid") == guid).select("storey_guid").first()
        return row[0] if row else None

    def spaces(self) -> DataFrame:
        return self.products.where("entity = 'IfcSpace'").select("guid", "step_id", "name", "storey_guid", "storey_name")

    def type_summary(self, sample_guids: int = 3) -> DataFrame:
        return summaries.type_summary(self.products, sample_guids)

    def type_bank(self) -> DataFrame:
        return summaries.type_bank(self.products, self.materials, self.classifications)

    def find(self, table: str, guid: str | None = None, limit: int = 200, **equal: str) -> DataFrame:
        return facts.filter_facts(self.table(table) if guid is None else self._facts(table, guid), guid, limit, **equal)

    def _facts(self, table: str, guid: str) -> DataFrame:
        """A table with all of an item's rows: a cached or known one, else worked out for this item alone."""
        if table not in FACTS or self.cache_dir or table in self.tables.made:
            return self.table(table)
        if self._about is None or self._about[0] != guid:
            self._about = guid, self.tables.about(guid)
        return getattr(self._about[1], table)()

    def card(self, guid: str, limit: int = 50) -> dict:
        """All that is known about one product."""
        out = {"product": self.product(guid)}
        for name in ("psets", "quantities", "materials", "classifications"):
            rows = [r.asDict() for r in self.find(name, guid, limit + 1).collect()]
            out[name], out[f"{name}_truncated"] = rows[:limit], len(rows) > limit
        out["ancestors"] = [r.ancestor_guid for r in self.ancestors(guid).collect()]
        return out

    def diff(self, other: Model, sample: int = 5) -> dict:
        """Counts and samples of added, removed and changed products, and the counts of types that differ."""
        left, right = self.products, other.products
        lists = {"added": summaries.added(left, right), "removed": summaries.removed(left, right), "changed": summaries.changed(left, right).select("guid").distinct()}
        out: dict = {}
        for name, rows in lists.items():
            rows = durable(rows.select("guid"))
            out[name] = rows.count()
            ordered = rows.orderBy("guid")
            out[f"{name}_guids"] = [r.guid for r in (ordered.limit(sample) if sample else ordered).collect()]
        out["type_deltas"] = {r.entity: (r.n_left, r.n_right, r.delta) for r in summaries.count_deltas(left, right).collect()}
        return out

    def summary(self) -> dict:
        top = {r.entity: r.n for r in self.types_count().orderBy(F.desc("n"), "entity").limit(20).collect()}
        return {"path": self.path, "schema": self.header["schema"], "types": top, **{name: self.table(name).count() for name in TABLES}}

    def schemas(self) -> dict[str, dict[str, str]]:
        """Column types of every table."""
        return {name: dict(self.table(name).dtypes) for name in TABLES}

    def preview(self, table: str, n: int = 5) -> DataFrame:
        rows = self.table(table)
        return rows.orderBy(*rows.columns).limit(n)

    # --- geometry

    def meshes(self, frame: str = "world", unit: str | float | None = None, cut_openings: bool = False, keep_cutters: bool = False, guids: list[str] | None = None) -> DataFrame:
        """Fragments of products in a frame (world, local, item), in file units or another unit.

        With cut_openings the frame is local and each product is one net fragment; stand-in cutters are left out unless
        keep_cutters says so. World coordinates are taken relative to global_shift().
        """
        if cut_openings:
            rows = openings.net_meshes(self.tables).withColumn("source", F.lit("net"))
            rows = rows.where(F.col("guid").isin(*guids)) if guids is not None else rows
        else:
            rows = meshes.product_meshes(self.tables, frame, guids)
            rows = rows if keep_cutters else reports.strip_synthetic(rows)
            if frame == "world":
                shift = [v or 0.0 for v in self.global_shift().first()]
                if any(shift):
                    rows = rows.withColumn("vertices", F.transform("vertices", lambda x, i: x - F.element_at(F.array(*map(F.lit, shift)), (i % 3 + 1).cast("int"))))
        return rows if unit is None else meshes.scaled(rows, (self.unit_scale or 1.0) * units.factor(unit, self.unit_scale or 1.0))

    def mesh(self, guid: str, unit: str | float | None = None) -> DataFrame:
        """One product's mesh in absolute world coordinates; only its own items are read."""
        rows = meshes.merged(meshes.product_meshes(self.tables, "world", [guid]))
        return rows if unit is None else meshes.scaled(rows, (self.unit_scale or 1.0) * units.factor(unit, self.unit_scale or 1.0))

    def global_shift(self) -> DataFrame:
        """One row (x, y, z), see reports.global_shift()."""
        at = self.tables.products().select("ord", "placement_id").join(meshes.placements(self.tables), "placement_id")
        return reports.global_shift(at.select("ord", *[F.get("matrix", F.lit(4 * i + 3)).alias(c) for i, c in enumerate("xyz")]), self.unit_scale or 1.0)

    def segments(self) -> DataFrame:
        return meshes.segments(meshes.merged(self.meshes()))

    def drift(self) -> DataFrame:
        """Distance of each product's middle from its placement, with severities; demoted where the whole model is baked."""
        return geometry.demoted(meshes.drift_report(self.tables, meshes.product_meshes(self.tables, "world")))

    @property
    def world_coordinate_baked(self) -> bool:
        return geometry.world_baked(meshes.drift_report(self.tables, meshes.product_meshes(self.tables, "world"))).first()[0]

    @property
    def unit_resolved(self) -> bool:
        return self.unit_scale is not None

    def mesh_qto(self, cut_openings: bool = True) -> tuple[DataFrame, DataFrame]:
        """(products, surfaces) in metres: take-off of each product's merged mesh, net of openings or without stand-in cutters."""
        scale = self.unit_scale or 1.0
        if cut_openings:
            whole = openings.net_meshes(self.tables)
        else:
            whole = meshes.merged(meshes.product_meshes(self.tables, "local").where(~F.col("source").rlike("halfspace|boolean_cutter")))
        whole = durable(meshes.scaled(whole.where(F.size("indices") >= 3), scale))
        tris = geometry.triangles(whole)
        found = geometry.surfaces(tris)
        return geometry.take_off(tris).join(geometry.volumes(whole), "guid").join(geometry.surface_summary(found), "guid", "left"), found

    def mesh_stats(self) -> DataFrame:
        named = meshes.merged(meshes.product_meshes(self.tables, "world")).join(self.products.select("guid", "entity"), "guid")
        return reports.product_stats(named)

    def write_gltf(self, path: str) -> None:
        """The model as binary glTF; shapes that products share are stored once."""
        fragments = durable(self.meshes("item"))
        shapes, of = substrate.representations(fragments)
        at = self.tables.products().select("guid", "entity", "placement_id").join(meshes.placements(self.tables), "placement_id", "left")
        rows = of.join(at, "guid").join(styles.product_colours(self.tables, fragments), "guid", "left").select("guid", "entity", "rep_id", "matrix", "colour")
        gltf.write_glb(rows, shapes.select("rep_id", "vertices", "indices"), path)

    def hotswap(self, guid: str, vertices: list, triangles: list, path: str) -> dict:
        """Writes the model with a product's body replaced; what was done."""
        rows, stats = swap.hotswap(once_each(self.records, "file_id", "step_id"), guid, vertices, triangles, self.tables.schema)
        step.write_step(rows, step_head(self.header), path)
        return stats | {"path": path}

    def point_cloud(self, per_m2: float = 1000.0, seed: int = 42) -> DataFrame:
        return geometry.point_cloud(geometry.triangles(meshes.merged(self.meshes(unit="m"))), per_m2, seed)

    def point_cloud_chunks(self, per_m2: float = 1000.0, seed: int = 42, chunk: int = 1_000_000):
        """The point cloud as lists of rows, fetched partition by partition."""
        rows = []
        for row in self.point_cloud(per_m2, seed).toLocalIterator(prefetchPartitions=True):
            rows.append(row)
            if len(rows) == chunk:
                yield rows
                rows = []
        if rows:
            yield rows

    def write_obj(self, path: str) -> None:
        meshes.obj_text(meshes.merged(self.meshes())).orderBy("guid").coalesce(1).select("value").write.mode("overwrite").text(path)

    def bundle(self, path: str) -> None:
        """The nested two-table layout: instances with their facts, representations by item."""
        fragments = durable(self.meshes("item"))
        reps, of = substrate.representations(fragments)
        rows = substrate.nest(self.products.join(of, "guid", "left"), {n: self.table(n) for n in ("psets", "quantities", "materials", "classifications")})
        substrate.write_bundle(rows, reps, path)

    def clash(self, tolerance: float = 0.0, include: list[str] | None = None, exclude_self: list[str] | None = None) -> DataFrame:
        whole = durable(meshes.merged(self.meshes()))
        named = self.products.select("guid", "entity", F.col("step_id").alias("id"))
        boxes = geometry.bounds(whole).join(named, "guid")
        return clash.clash(boxes, whole.join(named, "guid").select("id", "vertices", "indices"), tolerance, include, exclude_self)

    def subset(self, guids: list[str], path: str) -> None:
        """A self-contained STEP file of the given items and what they need."""
        rows = subset.subset(step.entity_table(self.records), guids)
        step.write_step(rows, step_head(self.header), path)


def step_head(header: dict) -> str:
    text = lambda s: "'" + (s or "").replace("'", "''") + "'"
    many = lambda xs: "(" + ",".join(map(text, xs or [""])) + ")"
    h = header
    return f"ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION({many(h['description'])},'2;1');\nFILE_NAME({text(h['name'])},{text(h['time_stamp'])},{many(h['author'])},{many(h['organization'])},{text(h['preprocessor_version'])},{text(h['originating_system'])},{text(h['authorisation'])});\nFILE_SCHEMA(({text(h['schema'])}));\nENDSEC;\nDATA;"


def open_model(spark: SparkSession, path: str, **options) -> Model:
    return Model(spark, path, **options)
