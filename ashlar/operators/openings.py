"""Net bodies: products without their openings and without the cutters inside their own representation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cuts
from ..functions.memo import Memo
from ..functions.solids import moved
from . import meshes
from .durable import durable
from .index import Tables

#: Hosts that a worker has cut, by all that goes into a cut.
_CUTS = Memo()
IN_REPRESENTATION = "(^|\\|)boolean_cutter(\\||$)"


def cut_parts(parts: DataFrame) -> DataFrame:
    """(guid, vertices, indices, outcome, n_cutters) of hosts from parts(guid, role, item, source, vertices, indices, frame, host_frame).

    role is host, cutter (which cuts host parts of its own item) or opening (which cuts all host parts, and is brought from frame into
    host_frame, both 4 x 4 matrices by rows). Hosts are independent, so each is one group of its own few parts. A host
    part that cannot be cut stays whole; outcome lists what became of the parts, each word once.
    """

    def cut(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, str] | None:
        mesh = lambda r: (r["vertices"].reshape(-1, 3), r["indices"].reshape(-1, 3))
        openings = []
        for r in rows:
            if r["role"] == "opening":
                v, f = mesh(r)
                into = np.linalg.inv(r["host_frame"].reshape(4, 4)) @ r["frame"].reshape(4, 4)
                openings.append((r["source"], (moved(v, into), f)))
        out_v, out_f, outcomes, at = [], [], set(), 0
        for r in rows:
            if r["role"] != "host":
                continue
            own = [(c["source"], mesh(c)) for c in rows if c["role"] == "cutter" and c["item"] == r["item"]]
            (v, f), outcome = cuts.cut(mesh(r), own + openings)
            outcomes.add(outcome)
            out_v.append(v)
            out_f.append(f + at)
            at += len(v)
        return (np.concatenate(out_v).ravel().astype(float), np.concatenate(out_f).ravel().astype(np.int64), "|".join(sorted(outcomes))) if out_v else None

    def made(guid: str, fields: tuple[pa.Array, ...]) -> Iterator[tuple]:
        role, item, source = (f.to_pylist() for f in fields[:3])
        numbers = [[None if x is None else np.array(x.values, kind) for x in map(lambda x: x if x.is_valid else None, f)] for f, kind in zip(fields[3:], (float, np.int64, float, float), strict=True)]
        rows = [dict(zip(("role", "item", "source", "vertices", "indices", "frame", "host_frame"), r, strict=True)) for r in zip(role, item, source, *numbers, strict=True)]
        rows.sort(key=lambda r: (r["role"], r["item"], r["source"]))
        place = {x: n for n, x in enumerate(dict.fromkeys(r["item"] for r in rows))}
        text = lambda x: None if x is None else x.tobytes()
        key = tuple((r["role"], place[r["item"]], r["source"], *(text(r[c]) for c in ("vertices", "indices", "frame", "host_frame"))) for r in rows)
        found = _CUTS.get(key, lambda: cut(rows), lambda m: sum(len(x) for k in key for x in k[3:] if x) + (m[0].nbytes + m[1].nbytes if m else 0))
        if found:
            yield guid, *found, sum(r["role"] != "host" for r in rows)

    schema = pa.schema([("guid", pa.string()), ("vertices", pa.list_(pa.float64())), ("indices", pa.list_(pa.int64())), ("outcome", pa.string()), ("n_cutters", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meshes.in_batches((row for batch in batches for guid, fields in meshes.groups(batch) for row in made(guid, fields)), schema)

    part = F.struct("role", "item", "source", "vertices", "indices", "frame", "host_frame")
    return parts.groupBy("guid").agg(F.collect_list(part).alias("parts")).mapInArrow(run, "guid string, vertices array<double>, indices array<bigint>, outcome string, n_cutters long")


def net_meshes(tables: Tables) -> DataFrame:
    """(guid, vertices, indices, outcome, n_cutters): one mesh a product in its own frame, openings taken out and left out as products.

    Only products with a cutter are handed to Python; the rest are merged in the JVM with outcome untouched.
    """
    local = durable(meshes.product_meshes(tables, "local"))
    frames = tables.products().select("guid", "placement_id").join(meshes.placements(tables), "placement_id").select("guid", "matrix")
    one = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    pairs = tables.voids().where("opening_guid <> host_guid").distinct()
    bodies = local.join(pairs.select(F.col("opening_guid").alias("guid")).distinct(), "guid", "left_anti")
    cutter = F.col("source").rlike(IN_REPRESENTATION)
    common = F.col("source").rlike(r"(^|\|)boolean_common(\||$)")
    none = F.lit(None).cast("array<double>")
    own = bodies.where(~common).select("guid", F.when(cutter, "cutter").otherwise("host").alias("role"), F.col("item_id").alias("item"), "source", "vertices", "indices", none.alias("frame"), none.alias("host_frame"))
    side = lambda x, name: frames.select(F.col("guid").alias(x), F.col("matrix").alias(name))
    placed = pairs.join(side("opening_guid", "frame"), "opening_guid", "left").join(side("host_guid", "host_frame"), "host_guid", "left")
    holes = placed.join(local.where(~cutter).select(F.col("guid").alias("opening_guid"), "item_id", "source", "vertices", "indices"), "opening_guid")
    holes = holes.select(F.col("host_guid").alias("guid"), F.lit("opening").alias("role"), F.col("item_id").alias("item"), "source", "vertices", "indices", F.coalesce("frame", one).alias("frame"), F.coalesce("host_frame", one).alias("host_frame"))
    parts = durable(own.unionByName(holes.join(own.select("guid").distinct(), "guid", "left_semi")))
    touched = durable(parts.where("role <> 'host'").select("guid").distinct())
    whole = meshes.merged(bodies.where(~cutter & ~common).join(touched, "guid", "left_anti")).select("guid", "vertices", "indices", F.lit("untouched").alias("outcome"), F.lit(0).cast("long").alias("n_cutters"))
    return whole.unionByName(cut_parts(parts.join(touched, "guid", "left_semi")))


def cut_stats(net: DataFrame) -> DataFrame:
    """(outcome, products, cutters) of net_meshes()."""
    return net.groupBy("outcome").agg(F.count("*").alias("products"), F.sum("n_cutters").alias("cutters"))
