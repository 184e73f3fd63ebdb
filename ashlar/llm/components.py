"""Connected components over an edge table, and lossless linking of bucketed candidates."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, stage


#: Edges that a task writes while components are contracted; few edges are not dealt over many small files.
TASK_EDGES = 100_000


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps, each a map-side combined min per node and a join,
    so that no node's neighbours are ever gathered in one task. Self loops and repeated edges do no
    harm; an empty edge table gives an empty result; nulls in a or b are dropped.
    """
    kind = dict(edges.dtypes)["a"]
    now = stage(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{label}-edges",
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = stage(small.coalesce(max(edges.sparkSession.sparkContext.defaultParallelism, mark[0] // TASK_EDGES)), f"{label}-edges")
        discard(now)
        now = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct().select(F.col("node").cast(kind), F.col("component").cast(kind))


class Exact(Protocol):
    """Decides on pairs for which a cheap necessary condition holds."""

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) that hold."""

    def to_giant(self, few: DataFrame, many: DataFrame) -> DataFrame:
        """(a, b): components cx of rows of few(bucket, part, node_x, cx, giant, ..) of which some row of many(bucket, part, node_y, ..) holds, and giant."""


#: Members of a bucket that meet the others in one task; larger buckets are dealt out by salt.
SALTED = 4096


def sorted_join(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A join of exploded tables that no side of is broadcast.

    Spark takes a table to be no larger after an explode than before, and would send millions of rows through the driver.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def shared_buckets(members: DataFrame, label: str) -> DataFrame:
    """(bucket, node, lo, hi) of the buckets of members(bucket, node) with more than one node, as a written table.

    lo and hi are a bucket's smallest and largest node. Each node stands once in a bucket.
    """
    ends = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    return stage(sorted_join(members, ends, "bucket"), f"{label}-members")


def link_buckets(members: DataFrame, near: Callable[[str, str], Column], label: str, light: DataFrame | None = None, exact: Exact | None = None) -> DataFrame:
    """(node, component) over all pairs of nodes that share a bucket of members(bucket, node) and are near.

    near(x, y) is the condition on columns `c_x` and `c_y` for each column c of light(node, ..). exact decides on the pairs that
    are near; without it near decides. Every member is first tested
    against the smallest and the largest node of its bucket, and these two leave it: they have met
    everyone. What holds is contracted, and a bucket whose members are all in one component is closed. In each open
    bucket the members outside its largest component are then tested against that one, which puts out a
    row a member however many it is near to, and the largest component leaves too. What still spans several
    components is tested pair by pair. A pair left untested has both ends in one component already, so the
    result equals that of testing every pair of every bucket, without writing the square of a dense one.
    Nodes without a pair that holds are absent.
    """
    spark = members.sparkSession
    held = shared_buckets(members, label)
    known = (lambda df: df.join(light, "node")) if light is not None else (lambda df: df)
    columns = light.columns if light is not None else ["node"]
    side = lambda df, x, *extra: df.select(*extra, *[F.col(c).alias(f"{c}_{x}") for c in columns])
    order = F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")
    holds = exact or (lambda pairs: pairs)

    ends = held.select(F.col("node").alias("x"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    if light is None:
        tested = ends.select(F.col("a").alias("node_x"), F.col("b").alias("node_y"))
    else:
        tested = ends.join(side(light, "x"), F.col("a") == F.col("node_x")).join(side(light, "y"), F.col("b") == F.col("node_y"))
    found = _merge(None, holds(stage(tested.where(near("x", "y")).select(*order), f"{label}-ends")), label)
    free_shuffles(spark)
    state = _open_buckets(held.where("node <> lo AND node <> hi").select("bucket", "node"), found, label)
    discard(held)

    sizes = state.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    giant = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("giant"), F.sum("n").alias("size"))
    dealt = stage(known(state.join(giant, "bucket").withColumn("parts", F.ceil(F.col("size") / SALTED).cast("int"))), f"{label}-dealt")
    discard(state)
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    few = side(dealt.where("component <> giant"), "x", "bucket", part, F.col("component").alias("cx"), "giant")
    many = side(dealt.where("component = giant"), "y", "bucket", parts)
    linked = sorted_join(few, many, (few.bucket == many.bucket) & (few.part == many.part) & near("x", "y"), "left_semi")
    if exact is None:
        linked = linked.select(F.col("cx").alias("a"), F.col("giant").alias("b"))
    else:
        linked = exact.to_giant(stage(linked, f"{label}-drawn"), many)
    found = _merge(found, linked.distinct(), label)
    free_shuffles(spark)
    rest = _open_buckets(dealt.where("component <> giant").select("bucket", "node"), found, label)
    crowd = rest.groupBy("bucket").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("parts"))
    dealt_rest = known(rest.join(crowd, "bucket"))
    one, other = side(dealt_rest, "x", "bucket", part, F.col("component").alias("cx")), side(dealt_rest, "y", "bucket", parts, F.col("component").alias("cy"))
    pairs = sorted_join(one, other, (one.bucket == other.bucket) & (one.part == other.part) & (F.col("cx") < F.col("cy")) & near("x", "y")).select(*order).distinct()
    return _merge(found, holds(stage(pairs, f"{label}-pairs")), label)


def _open_buckets(members: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """(bucket, node, component) of the buckets of members(bucket, node) that span several components."""
    seen = members.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    split = seen.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return stage(seen.join(split, "bucket"), f"{label}-open")


def _merge(found: DataFrame | None, pairs: DataFrame, label: str) -> DataFrame:
    """Contracts pairs onto the components found so far."""
    if found is None:
        return stage(connected_components(pairs.select("a", "b"), label), f"{label}-found")
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    mapped = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = connected_components(mapped, label)
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = found.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = moved.join(found.select("node"), "node", "left_anti")
    return stage(old.union(fresh), f"{label}-found")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
