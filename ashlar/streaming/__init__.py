"""Streams of models: files that arrive in a folder become appended rows, and hosts that wait for their openings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.classes import CHANGES, resolve_schema
from ..operators.index import product_rows
from ..sources.step import RECORDS, batches_of, check_trailer, header_fields, scan, unwrap


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of STEP files as they appear in a folder of any store that Spark lists, with schema, the known schema of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = unwrap(content.as_py())
                check_trailer(raw)
                schema = resolve_schema(header_fields(raw[:65536])["schema"]) or "IFC4"
                for rows in batches_of(name.as_py(), scan(raw)):
                    yield rows.append_column("schema", pa.array([schema] * rows.num_rows, pa.string()))

    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(shape).load(folder)
    return files.select("path", "content").mapInArrow(run, RECORDS + ", schema string")


def products_of(records: DataFrame) -> DataFrame:
    """Products of records(file_id, schema, ..) of many files at once; of a step id that stands twice the last value counts."""
    merged = records.groupBy("file_id", "schema", "step_id").agg(F.min("ord").alias("ord"), F.max_by(F.struct("type", "args"), "ord").alias("r"))
    flat = merged.select("file_id", "schema", "ord", "step_id", F.upper("r.type").alias("type"), "r.args")
    return reduce(DataFrame.unionByName, [product_rows(flat.where(F.col("schema") == s), s) for s in CHANGES])


def index_stream(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    """Calls sink(products with file_id, number) once for each micro-batch of arriving files."""
    writer = stream_records(spark, folder).writeStream.foreachBatch(lambda batch, number: sink(products_of(batch), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def net_stream(parts: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """(guid, vertices, indices, outcome) of hosts whose parts arrive in any order.

    parts(guid, role, item, source, vertices, indices, expected): expected says how many cutters a host has. A host is kept
    in the state store until it and all its cutters are there, or, with wait_ms, until nothing came for so long; then it is cut as it stands.
    """
    import numpy as np

    from ..functions import cuts

    def made(guid: str, held: list) -> pd.DataFrame:
        mesh = lambda p: (np.array(p["vertices"], float).reshape(-1, 3), np.array(p["indices"], np.int64).reshape(-1, 3))
        hosts, cutters = [p for p in held if p["role"] == "host"], [(p["source"], mesh(p)) for p in held if p["role"] != "host"]
        rows = [cuts.cut(mesh(p), cutters) for p in sorted(hosts, key=lambda p: (p["item"], p["source"]))]
        return pd.DataFrame({"guid": [guid] * len(rows), "vertices": [v.ravel() for (v, _), _ in rows], "indices": [f.ravel() for (_, f), _ in rows], "outcome": [o for _, o in rows]})

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                held += [r | {"vertices": list(map(float, r["vertices"])), "indices": list(map(int, r["indices"])), "item": int(r["item"]), "expected": int(r["expected"])} for r in frame.drop(columns="guid").to_dict("records")]
            there = sum(p["role"] != "host" for p in held)
            if there == len(held) or there < max(p["expected"] for p in held):
                state.update((json.dumps(held),))
                if wait_ms is not None:
                    state.setTimeoutDuration(wait_ms)
                return
        if state.exists:
            state.remove()
        yield made(key[0], held)

    return parts.groupBy("guid").applyInPandasWithState(run, "guid string, vertices array<double>, indices array<bigint>, outcome string", "held string", "append", GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
