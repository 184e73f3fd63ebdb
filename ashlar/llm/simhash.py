"""SimHash fingerprints and near-duplicate groups by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, stage, table
from .components import hamming, link_buckets

SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of a text, as a signed integer.

    Words are runs of anything but ASCII white space after A-Z are lower-cased; shingles of `width`
    words, repeats included, are joined by one space; fewer words give one shingle. A bit is set where
    more than half of the XXH64 values (seed 42) have it. Null, empty and blank texts give zero.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    count = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, count)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) for each row of docs; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp long")


def block_masks(distinct: int, max_distance: int = 4) -> list[int]:
    """Masks of which two fingerprints within max_distance share at least one.

    64 bits are cut into m blocks; close pairs agree on m - max_distance of them, so each choice
    of that many blocks is a key. m follows the number of fingerprints so that a key has 64 times more
    values than there are fingerprints and random collisions stay rare; every m finds every close pair.
    """
    for m in range(max_distance + 2, max_distance + 6):
        bits = 64 * (m - max_distance) // m
        if 1 << bits > 64 * distinct:
            break
    ends = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << ends[i + 1]) - 1) ^ ((1 << ends[i]) - 1) for i in range(m)]
    return [sum(c) for c in combinations(blocks, m - max_distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(docs: DataFrame, max_distance: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) for every row of docs; see near_duplicates().

    component names the group by one of its fingerprints. Equal fingerprints collapse first, so groups
    of copies cost one row. Dense groups of different fingerprints are contracted around hubs before any pair
    is written (link_buckets).
    """
    fps = stage(fingerprints(docs, width), "simhash")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    masks = block_masks(nodes.count(), max_distance)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    members = nodes.select(F.explode(keys).alias("bucket"), F.col("fp").alias("node"))
    near = link_buckets(members, lambda x, y: hamming(F.col(f"node_{x}"), F.col(f"node_{y}")) <= max_distance, "simhash")
    labelled = nodes.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = labelled.select("fp", "component").join(smallest, "component")
    return fps.join(ids, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, max_distance: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Documents whose fingerprints differ in at most max_distance bits are linked; component_id is the
    smallest doc_id that links reach. Rows without doc_id take part but never name a component; a
    component of such rows alone has a null id. Repeated rows come back as often as they came in, an
    empty table gives an empty result, and further columns of docs are ignored.
    """
    return linked(docs, max_distance, width).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each_group(docs: DataFrame, max_distance: int = 4, width: int = 4) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id.

    Rows without doc_id come after those that have one; rows of one doc_id go by a hash of their text.
    Of rows equal in both one stays.
    """
    rows = linked(docs, max_distance, width).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"), F.col("n"))).alias("k")).select("k.*")
    names = spare(docs, "_doc", "_hash")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    kept = stage(best.select(key.alias(names[0]), F.col("text_hash").alias(names[1]), "n"), "simhash-kept")
    own = docs.withColumns(dict(zip(names, (key, F.xxhash64("text")), strict=True)))
    out = own.join(kept.select(*names), names, "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates(names)
    return out.select(*docs.columns)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates over documents: 4-word shingles, at most 4 differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 4)


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
SQL: dict[str, str] = {}
