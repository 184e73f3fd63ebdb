"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

#: Points of each shard on the ring.
VIRTUAL_NODES = 64
#: The ring is cut into this many equal sectors, each with a short list of its points.
SECTORS = 1 << 12
#: Parts of an arc, and rows from which a part is cut further by a row number.
PARTS, PART_ROWS = 16, 100_000


def capacities(rows: int, shards: int, load: float = 1.0) -> list[int]:
    """Rows that each shard may hold. load 1 shares out exactly; above 1 each gets that multiple of the mean."""
    if load <= 1.0:
        return [rows // shards + (i < rows % shards) for i in range(shards)]
    return [-int(-load * rows // shards)] * shards


def route(arcs: list[tuple[int, int]], ring: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Deals the rows of each arc of the ring; arcs lists (arc, rows), ring the shard of each arc's point.

    An arc's rows go to the shard of the point that ends it as far as there is room; the rest continue
    clockwise to the next point whose shard is not full. Gives (arc, first rank, rows, shard, first slot);
    there are at most as many entries as arcs and shards together.
    """
    used, plan = [0] * len(room), []
    for arc, rows in sorted(arcs):
        rank, at = 0, arc
        while rank < rows:
            shard = ring[at % len(ring)]
            taken = min(rows - rank, room[shard] - used[shard])
            if taken:
                plan.append((arc, rank, taken, shard, used[shard]))
                used[shard] += taken
                rank += taken
            at += 1
            if at > arc + len(ring):
                raise ValueError("the shards have less room than there are rows")
    return plan


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from values in the plan itself."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    shape = ", ".join(f.replace(" ", ": ", 1) for f in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{shape}>>")))


def _ring(spark: SparkSession, shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of every point, by position; shards times virtual rows."""
    points = spark.range(shards * virtual).select(F.xxhash64(F.lit("point"), (F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards)).alias("position"), (F.col("id") % shards).cast("int").alias("shard"))
    return sorted((r.position, r.shard) for r in points.collect())


def bounded_ring(docs: DataFrame, shards: int, key: str = "doc_id", load: float = 1.0, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of docs.

    The key's hash places a row on the ring; rows that find a shard full go on clockwise, so no shard
    exceeds its capacity (load times the mean; at load 1 counts differ by one at most) and only
    overflowing rows leave the shard that plain consistent hashing gives. slot numbers a shard's rows
    without gaps. size is the text's UTF-8 bytes plus 16, text_crc32 its unsigned CRC (null counts as
    empty). Null keys share one place on the ring; repeated keys and rows are dealt like any others;
    an empty table gives an empty result; other columns are not read.

    Which rows of an over-full arc go on is settled by counts of the arcs alone (shards times
    virtual, on the driver) and each row's rank in its arc. Ranks come from parts of an arc, and a part
    with many rows (a key may hold a third of them) is cut by row numbers, so no task gathers an arc.
    """
    spark = docs.sparkSession
    ring = _ring(spark, shards, virtual)
    sectors = _sectors(spark, [p for p, _ in ring])
    rows = stage(
        docs.select(
            F.col(key).alias("_key"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(key).alias("position"),
            F.monotonically_increasing_id().alias("row"),
        ).select("*", _part().alias("part")),
        "ring",
    )
    placed = rows.withColumn("sector", _sector(F.col("position"))).join(F.broadcast(sectors), "sector").withColumn("arc", (F.col("base") + F.size(F.filter("points", lambda p: p < F.col("position")))) % len(ring)).drop("sector", "base", "points")
    cells = placed.groupBy("arc", "part").agg(F.count("*").alias("n"))
    crowded = cells.where(F.col("n") > PART_ROWS).select("arc", "part", F.ceil(F.col("n") / PART_ROWS).alias("cuts"))
    # At most one row for each arc and part: shards x virtual x PARTS.
    placed = placed.join(F.broadcast(crowded), ["arc", "part"], "left").withColumn("cut", F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("row"), "cuts")).otherwise(0)).drop("cuts")
    counts = stage(placed.groupBy("arc", "part", "cut").agg(F.count("*").alias("n")), "ring-counts")
    arcs = [(int(r.arc), int(r.n)) for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()]
    plan = route(arcs, [s for _, s in ring], capacities(sum(n for _, n in arcs), shards, load))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("arc").orderBy("part", "cut").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "part", "cut").orderBy("position", "_key", "text_crc32", "size", "row")) - 1)
    ranked = ranked.join(before.select("arc", "part", "cut", F.coalesce("before", F.lit(0)).alias("before")), ["arc", "part", "cut"]).withColumn("rank", F.col("rank") + F.col("before"))
    routes = _rows(spark, plan, "arc bigint, first bigint, taken bigint, shard int, slot bigint").groupBy("arc").agg(F.collect_list(F.struct("first", "taken", "shard", "slot")).alias("routes"))
    mine = F.filter("routes", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["taken"]))[0]
    out = ranked.join(F.broadcast(routes), "arc").withColumn("mine", mine)
    return out.select(F.col("_key").alias(key), "size", "text_crc32", F.col("mine.shard").alias("shard"), (F.col("mine.slot") + F.col("rank") - F.col("mine.first")).alias("slot"))


def _part() -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), "position", "text_crc32", "size"), F.lit(PARTS)).cast("int")


def _sector(position: Column) -> Column:
    return F.shiftrightunsigned(position, 64 - SECTORS.bit_length() + 1)


def _sectors(spark: SparkSession, positions: list[int]) -> DataFrame:
    """(sector, base, points): the points of each sector and the index of the first point at or after its start.

    Signed positions in rising order start with the upper half of the unsigned ones; the sector of a
    position follows its bits, so the index counts points in signed order within each sector.
    """
    shift = 64 - (SECTORS.bit_length() - 1)
    lists: dict[int, list[int]] = {}
    for p in positions:
        lists.setdefault((p % (1 << 64)) >> shift, []).append(p)
    order = [*range(SECTORS // 2, SECTORS), *range(SECTORS // 2)]
    out, base = [], 0
    for sector in order:
        points = lists.get(sector, [])
        out.append((sector, base, points))
        base += len(points)
    return _rows(spark, out, "sector bigint, base bigint, points array<bigint>")


def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 40 shards of counts at most one apart (law rows)."""
    out = bounded_ring(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_bounded_ring": op1_bounded_ring}
SQL: dict[str, str] = {}
