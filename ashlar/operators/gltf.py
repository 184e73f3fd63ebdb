"""Binary glTF of merged meshes: one node a product, shared shapes once, positions as 32-bit floats."""

from __future__ import annotations

import hashlib
import json
import shutil
import struct
import tempfile
from collections.abc import Callable, Iterator
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.step import store
from .durable import durable


def glb(products: list[dict], shapes: dict[str, tuple[np.ndarray, np.ndarray]]) -> bytes:
    """A .glb from products (guid, entity, rep_id, matrix by rows or None, colour or None) and shapes by rep_id.

    A node has its product's matrix, so shapes that several products share are stored once. Colours are materials,
    each once; guid and entity are a node's extras.
    """
    chunks, views, accessors, meshes, index = [], [], [], [], {}
    offset = 0

    def put(data: bytes, target: int) -> int:
        nonlocal offset
        views.append({"buffer": 0, "byteOffset": offset, "byteLength": len(data), "target": target})
        chunks.append(data + b"\0" * (-len(data) % 4))
        offset += len(chunks[-1])
        return len(views) - 1

    for rep, (v, f) in shapes.items():
        points = np.asarray(v, "<f4").reshape(-1, 3)
        small = len(points) < 65536
        accessors.append({"bufferView": put(points.tobytes(), 34962), "componentType": 5126, "count": len(points), "type": "VEC3", "min": points.min(0).tolist(), "max": points.max(0).tolist()})
        accessors.append({"bufferView": put(np.asarray(f, "<u2" if small else "<u4").tobytes(), 34963), "componentType": 5123 if small else 5125, "count": int(np.size(f)), "type": "SCALAR"})
        index[rep] = len(accessors) - 2
    colours: dict[tuple, int] = {}
    by_shape: dict[tuple, int] = {}
    nodes = []
    for p in products:
        if p["rep_id"] not in index:
            continue
        colour = tuple(p["colour"]) if p.get("colour") else None
        if colour is not None:
            colours.setdefault(colour, len(colours))
        key = (p["rep_id"], colour)
        if key not in by_shape:
            at = index[p["rep_id"]]
            part = {"attributes": {"POSITION": at}, "indices": at + 1} | ({"material": colours[colour]} if colour is not None else {})
            meshes.append({"primitives": [part]})
            by_shape[key] = len(meshes) - 1
        node = {"mesh": by_shape[key], "name": p["guid"], "extras": {"guid": p["guid"], "entity": p["entity"]}}
        if p.get("matrix"):
            node["matrix"] = np.asarray(p["matrix"], float).reshape(4, 4).T.ravel().tolist()
        nodes.append(node)
    head = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(nodes)))}], "nodes": nodes, "meshes": meshes, "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": offset}]}
    if colours:
        head["materials"] = [{"pbrMetallicRoughness": {"baseColorFactor": list(c)}} for c in colours]
    text = json.dumps({k: v for k, v in head.items() if v != []}).encode()
    text += b" " * (-len(text) % 4)
    body = b"".join(chunks)
    return b"glTF" + struct.pack("<II", 2, 20 + len(text) + (8 + len(body) if body else 0)) + struct.pack("<I", len(text)) + b"JSON" + text + (struct.pack("<I", len(body)) + b"BIN\0" + body if body else b"")


def read_glb(data: bytes, without: tuple[str, ...] = ()) -> tuple[dict, bytes]:
    """The head and the buffer of a .glb; names in `without` are left out wherever they stand in the head."""
    magic, version, length = data[:4], *struct.unpack("<II", data[4:12])
    if magic != b"glTF" or version != 2 or length != len(data):
        raise ValueError("no binary glTF of version 2")
    n = struct.unpack("<I", data[12:16])[0]
    hook = (lambda d: {k: v for k, v in d.items() if k not in without}) if without else None
    return json.loads(data[20 : 20 + n], object_hook=hook), data[28 + n :]


def _numbered(rows: DataFrame, *order: str, size: str | None = None) -> DataFrame:
    """rows with at, their place in the order, and before, the sum of size of the rows before them.

    Rows are sorted in ranges, so only one total a range comes to the driver.
    """
    placed = durable(rows.withColumn("_n", F.col(size).cast("long") if size else F.lit(1).cast("long")).sort(*order).withColumn("_range", F.spark_partition_id()))
    bases, at, before = [], 0, 0
    for r in placed.groupBy("_range").agg(F.count("*").alias("rows"), F.sum("_n").alias("n")).orderBy("_range").collect():
        bases.append((r[0], at, before))
        at, before = at + r.rows, before + r.n
    start = F.broadcast(rows.sparkSession.createDataFrame(bases, "_range int, _at long, _before long"))  # a row a range
    within = Window.partitionBy("_range").orderBy(*order)
    so_far = F.coalesce(F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.join(start, "_range").withColumns({"at": F.col("_at") + F.row_number().over(within) - 1, "before": F.col("_before") + so_far})
    return durable(out.drop("_range", "_n", "_at", "_before"))


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 4)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each shape(rep_id, vertices, indices) with a key that equal ones share."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            points = batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, 3)
            faces = batch.column(2)[i].values.to_numpy(zero_copy_only=False).astype("<u2" if len(points) < 65536 else "<u4")
            a, b = points.tobytes(), faces.tobytes()
            key = hashlib.sha256(struct.pack("<QQ", len(a), len(b)) + a + b).digest()
            rows.append((batch.column(0)[i].as_py(), key, _padded(a) + _padded(b), len(a), len(b), len(points), len(faces), points.min(0).tolist(), points.max(0).tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKED.types, strict=True)], schema=_PACKED)


_PACKED = pa.schema([("rep_id", pa.string()), ("key", pa.binary()), ("data", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("points", pa.int64()), ("indices", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def _views(r: dict) -> list[dict]:
    second = r["before"] + r["n_a"] + -r["n_a"] % 4
    return [{"buffer": 0, "byteOffset": r["before"], "byteLength": r["n_a"], "target": 34962}, {"buffer": 0, "byteOffset": second, "byteLength": r["n_b"], "target": 34963}]


def _accessors(r: dict) -> list[dict]:
    return [
        {"bufferView": 2 * r["at"], "componentType": 5126, "count": r["points"], "type": "VEC3", "min": r["low"], "max": r["high"]},
        {"bufferView": 2 * r["at"] + 1, "componentType": 5123 if r["points"] < 65536 else 5125, "count": r["indices"], "type": "SCALAR"},
    ]


def _mesh(r: dict) -> list[dict]:
    part = {"attributes": {"POSITION": 2 * r["shape"]}, "indices": 2 * r["shape"] + 1} | ({"material": r["material"]} if r["material"] is not None else {})
    return [{"primitives": [part]}]


def _node(r: dict) -> list[dict]:
    node = {"mesh": r["mesh"], "name": r["guid"], "extras": {"guid": r["guid"], "entity": r["entity"]}}
    if r["matrix"]:
        node["matrix"] = np.asarray(r["matrix"], float).reshape(4, 4).T.ravel().tolist()
    return [node]


def _material(r: dict) -> list[dict]:
    return [{"pbrMetallicRoughness": {"baseColorFactor": r["colour"]}}]


def _spooled(rows: DataFrame, order: str, made: Callable[[dict], list[dict]] | None) -> IO[bytes]:
    """A file on the driver's disk with what made() gives for rows in order, as JSON values parted by commas, or with their bytes.

    Texts are made by the executors and come partition by partition, a megabyte or so a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for r in batch.to_pylist():
                held += [r["data"]] if made is None else [json.dumps(x, separators=(",", ":")).encode() for x in made(r)]
                n += len(held[-1])
                if n > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([(b"," if made else b"").join(held)], pa.binary())], names=["text"])
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([(b"," if made else b"").join(held)], pa.binary())], names=["text"])

    out = tempfile.TemporaryFile()
    for r in rows.sort(order).mapInArrow(run, "text binary").toLocalIterator(prefetchPartitions=True):
        if made is not None and out.tell():
            out.write(b",")
        out.write(r[0])
    return out


def write_glb(products: DataFrame, shapes: DataFrame, path: str) -> None:
    """One file for a model, from products(guid, entity, rep_id, matrix, colour) and shapes(rep_id, vertices, indices).

    Shapes of equal bytes are stored once. Executors pack them and make the text of the head; the driver puts the pieces one behind the other, on disk.
    A .glb counts its bytes in 32 bits; a model that needs more raises.
    """
    packed = durable(shapes.select("rep_id", "vertices", "indices").mapInArrow(_packed, "rep_id string, key binary, data binary, n_a long, n_b long, points long, indices long, low array<double>, high array<double>"))
    # Rows of one key are the same in all columns.
    content = durable(packed.drop("rep_id").dropDuplicates(["key"]))
    at = _numbered(content.drop("data").withColumn("size", F.col("n_a") + F.pmod(-F.col("n_a"), F.lit(4)) + F.col("n_b") + F.pmod(-F.col("n_b"), F.lit(4))), "key", size="size")
    shown = durable(products.select("guid", "entity", "rep_id", "matrix", F.when(F.size("colour") > 0, F.col("colour")).alias("colour")).join(packed.select("rep_id", "key"), "rep_id"))
    colours = _numbered(shown.where("colour IS NOT NULL").select("colour").distinct(), "colour")
    kinds = shown.select("rep_id", "key", "colour").distinct().join(at.select("key", F.col("at").alias("shape")), "key").join(colours.select("colour", F.col("at").alias("material")), "colour", "left")
    drawn = _numbered(kinds.select("rep_id", "shape", "material"), "rep_id", "material")
    of = drawn.select("rep_id", F.col("material").alias("_material"), F.col("at").alias("mesh"))
    nodes = shown.join(colours.select("colour", F.col("at").alias("material")), "colour", "left").join(of, "rep_id").where("material <=> _material").select("guid", "entity", "matrix", "mesh")
    parts = {"nodes": _spooled(nodes, "guid", _node), "meshes": _spooled(drawn, "at", _mesh), "accessors": _spooled(at, "at", _accessors), "bufferViews": _spooled(at, "at", _views), "materials": _spooled(colours, "at", _material)}
    body = _spooled(content.select("key", "data"), "key", None)
    n, size = shown.count(), body.tell()
    scene = b",".join(b"%d" % i for i in range(n))
    start = b'{"asset":{"version":"2.0"},"scene":0,"scenes":[{"nodes":[' + scene + b"]}]," + f'"buffers":[{{"byteLength":{size}}}]'.encode()
    held = {name: f for name, f in parts.items() if f.tell()}
    length = len(start) + 1 + sum(len(name) + 6 + f.tell() for name, f in held.items())
    gap = -length % 4
    total = 20 + length + gap + (8 + size if size else 0)
    if total >= 1 << 32:
        raise ValueError(f"the model needs {total} bytes; a .glb holds less than 4 GB")
    files, inner = store(path)
    files.create_dir(inner.rpartition("/")[0], recursive=True)
    with files.open_output_stream(inner) as out:
        out.write(b"glTF" + struct.pack("<II", 2, total) + struct.pack("<I", length + gap) + b"JSON" + start)
        for name, f in held.items():
            f.seek(0)
            out.write(f',"{name}":['.encode())
            shutil.copyfileobj(f, out, 1 << 20)
            out.write(b"]")
        out.write(b"}" + b" " * gap)
        if size:
            out.write(struct.pack("<I", size) + b"BIN\0")
            body.seek(0)
            shutil.copyfileobj(body, out, 1 << 20)
    for f in (*parts.values(), body):
        f.close()
