"""Hierarchy queries over edge tables: parents, children, ancestors, descendants, closures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

#: Hops that a walk towards a storey or building may take.
WALK_LIMIT = 16


def _order(edges: DataFrame) -> Column:
    """The place of an edge in its file; 0 for edge tables without ord, where the larger guid counts as later."""
    return F.col("ord") if "ord" in edges.columns else F.lit(0).cast("long")


def parents(aggregates: DataFrame, contained_in: DataFrame) -> DataFrame:
    """(guid, parent_guid): the aggregate parent, else the container; of several the last edge's.

    Edges may carry ord; see _order().
    """
    up = aggregates.select(F.col("child_guid").alias("guid"), F.struct(F.lit(1).alias("rank"), _order(aggregates).alias("ord"), F.col("parent_guid").alias("parent_guid")).alias("edge"))
    box = contained_in.select(F.col("product_guid").alias("guid"), F.struct(F.lit(0).alias("rank"), _order(contained_in).alias("ord"), F.col("container_guid").alias("parent_guid")).alias("edge"))
    return up.union(box).groupBy("guid").agg(F.max("edge")["parent_guid"].alias("parent_guid"))


def children(aggregates: DataFrame, contained_in: DataFrame) -> DataFrame:
    """(parent_guid, child_guid, via): contained products first, then aggregate parts; a pair once."""
    box = contained_in.select(F.col("container_guid").alias("parent_guid"), F.col("product_guid").alias("child_guid"), F.lit(0).alias("rank"))
    part = aggregates.select("parent_guid", "child_guid", F.lit(1).alias("rank"))
    return box.union(part).groupBy("parent_guid", "child_guid").agg(F.min("rank").alias("rank")).select("parent_guid", "child_guid", F.when(F.col("rank") == 0, "contained").otherwise("aggregated").alias("via"))


def reach(edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth): every node that edges(src, dst) reach from each source, at its least depth; with only(src), from those sources.

    Cycles end and a start never reaches itself. Sources that no edge leads to, which are most where edges go up, are not walked:
    they take over what the nodes that they lead to have found, by one join. Best where edges go from the many to the few.
    """
    step = durable(edges.where("src <> dst").groupBy("src").agg(F.collect_set("dst").alias("next")))
    return _lists(step, only).select("src", F.explode("above").alias("a")).select("src", "a.dst", "a.depth")


def _lists(step: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(src, above): what step(src, next), one row a source, reaches, as an array of (dst, depth)."""
    held = step.select(F.explode("next").alias("src")).distinct()
    inner = durable(step.join(held, "src", "left_semi"))
    mine = step if only is None else step.join(only, "src", "left_semi")
    each = mine.select("src", F.size("next").alias("n"), F.explode("next").alias("mid"))
    size = inner.count()
    if 2 * size > step.count():  # chains and cycles, which lose little by being peeled
        far = _levels(inner.select("src", F.explode("next").alias("dst")))
        above = far.groupBy("src").agg(F.collect_list(F.struct("dst", "depth")).alias("above"))
    else:
        above = _lists(inner) if size else inner.select("src", F.transform("next", lambda d: F.struct(d.alias("dst"), F.lit(1).alias("depth"))).alias("above"))  # no row
    further = durable(above).select(F.col("src").alias("mid"), F.transform("above", lambda a: F.struct(a["dst"].alias("dst"), (a["depth"] + 1).alias("depth"))).alias("further"))
    here = F.array(F.struct(F.col("mid").alias("dst"), F.lit(1).alias("depth")))
    joined = each.join(further, "mid", "left").select("src", "n", F.when(F.col("further").isNull(), here).otherwise(F.concat(here, "further")).alias("above"))
    one = joined.where("n = 1").select("src", F.filter("above", lambda a: a["dst"] != F.col("src")).alias("above"))
    if step.where(F.size("next") > 1).isEmpty():
        return one
    pairs = joined.where("n > 1").select("src", F.explode("above").alias("a")).where("a.dst <> src").groupBy("src", "a.dst").agg(F.min("a.depth").alias("depth"))
    return one.union(pairs.groupBy("src").agg(F.collect_list(F.struct("dst", "depth")).alias("above")))


def _levels(edges: DataFrame) -> DataFrame:
    """reach() of distinct edges by one join a level, each level cut from its lineage, until one finds nothing new."""
    step = durable(edges)
    levels = [step.withColumn("depth", F.lit(1))]
    frontier = step
    seen = step
    hop = step.select(F.col("src").alias("mid"), F.col("dst").alias("next"))
    while True:
        ahead = frontier.join(hop, frontier.dst == hop.mid).select("src", F.col("next").alias("dst")).where("src <> dst").distinct()
        frontier = durable(ahead.join(seen, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.union, levels)
        levels.append(frontier.withColumn("depth", F.lit(len(levels) + 1)))
        seen = seen.union(frontier)


def ancestors(parent_of: DataFrame) -> DataFrame:
    """(guid, ancestor_guid, depth) from parents()."""
    up = reach(parent_of.select(F.col("guid").alias("src"), F.col("parent_guid").alias("dst")))
    return up.select(F.col("src").alias("guid"), F.col("dst").alias("ancestor_guid"), "depth")


def descendants(child_edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(guid, descendant_guid, depth) from children(), each node once for each start; with only(guid), those descendants.

    Walked from below, where each node has few above it.
    """
    up = reach(child_edges.select(F.col("child_guid").alias("src"), F.col("parent_guid").alias("dst")), None if only is None else only.select(F.col("guid").alias("src")))
    return up.select(F.col("dst").alias("guid"), F.col("src").alias("descendant_guid"), "depth")


def next_hop(aggregates: DataFrame, contained_in: DataFrame) -> DataFrame:
    """(guid, hop): where a walk goes from a node: a storey container, another container, the aggregate parent."""
    up = aggregates.select(F.col("child_guid").alias("guid"), F.struct(F.lit(0).alias("rank"), _order(aggregates).alias("ord"), F.col("parent_guid").alias("hop")).alias("edge"))
    box = contained_in.select(F.col("product_guid").alias("guid"), F.struct(F.when(F.col("container_kind") == "storey", 2).otherwise(1).alias("rank"), _order(contained_in).alias("ord"), F.col("container_guid").alias("hop")).alias("edge"))
    return up.union(box).groupBy("guid").agg(F.max("edge")["hop"].alias("hop"))


def first_above(nodes: DataFrame, hops: DataFrame, wanted: DataFrame, limit: int = WALK_LIMIT) -> DataFrame:
    """(guid, found): the first node of wanted(guid) on each node's walk along hops, within limit hops; null if there is none.

    Only nodes that hold others are walked, by doubling: each round a holder takes over the answer, or the reach, of the
    one it has come to, so walks of sixteen hops take four joins. What holders find is handed down to the many that they hold by one join.
    """
    marks = wanted.select(F.col("guid").alias("found")).distinct()
    hops = durable(hops.where("hop IS NOT NULL").select("guid", "hop"))
    holders = hops.select(F.col("hop").alias("guid")).distinct()
    reach = holders.join(marks, F.col("guid") == F.col("found"), "left").join(hops, "guid", "left")
    reach = durable(reach.select("guid", "found", F.when(F.col("found").isNull(), F.col("hop")).alias("at"), F.when(F.col("found").isNull(), 1).otherwise(0).alias("dist")))
    for _ in range(max(1, limit - 1).bit_length()):
        if reach.where("at IS NOT NULL").isEmpty():
            break
        ahead = reach.select(F.col("guid").alias("at"), F.col("found").alias("found_there"), F.col("at").alias("at_there"), F.col("dist").alias("further"))
        reach = durable(reach.join(ahead, "at", "left").select("guid", F.coalesce("found", "found_there").alias("found"), F.when(F.col("found_there").isNull(), F.col("at_there")).alias("at"), (F.col("dist") + F.coalesce("further", F.lit(0))).alias("dist")))
    answers = reach.where((F.col("dist") < limit) & F.col("found").isNotNull()).select(F.col("guid").alias("hop"), "found")
    return nodes.select("guid").distinct().join(hops.join(answers, "hop").select("guid", "found"), "guid", "left").select("guid", "found")


def storey_of(products: DataFrame, aggregates: DataFrame, contained_in: DataFrame, storeys: DataFrame) -> DataFrame:
    """(guid, storey_guid): the storey that holds each product, directly or through what holds it."""
    found = first_above(products, next_hop(aggregates, contained_in), storeys)
    return found.select("guid", F.col("found").alias("storey_guid"))


def building_of(products: DataFrame, aggregates: DataFrame, contained_in: DataFrame, storey_building: DataFrame, buildings: DataFrame) -> DataFrame:
    """(guid, building_guid): a storey's building, the building container, or the nearest building above."""
    hops = next_hop(aggregates, contained_in)
    storey = storey_building.select(F.col("storey_guid").alias("guid"), F.col("building_guid").alias("b"))
    merged = hops.join(storey, "guid", "full_outer").select("guid", F.coalesce("b", "hop").alias("hop"))
    return first_above(products, merged, buildings).select("guid", F.col("found").alias("building_guid"))


def products_in(down: DataFrame, products: DataFrame) -> DataFrame:
    """descendants() that are products."""
    return down.join(products.select(F.col("guid").alias("descendant_guid")), "descendant_guid", "left_semi").select("guid", "descendant_guid", "depth")


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): starts(node) and all that edges(src, dst) lead to, frontier by frontier until one is empty.

    Each frontier is written once; what was seen before is the union of them.
    """
    seen = frontier = durable(starts.select("node").distinct())
    while True:
        ahead = edges.join(frontier, edges.src == frontier.node, "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = durable(ahead.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def reach_from(start: str, edges: DataFrame) -> DataFrame:
    """(src, dst, depth): reach() from one node alone, whose frontier is all that is joined."""
    spark = edges.sparkSession
    seen = frontier = durable(spark.createDataFrame([(start, 0)], "dst string, depth int"))
    while True:
        here = frontier.select(F.col("dst").alias("node"), "depth")
        ahead = edges.join(here, F.col("src") == F.col("node")).select("dst", (F.col("depth") + 1).alias("depth")).distinct()
        frontier = durable(ahead.join(seen.select("dst"), "dst", "left_anti"))
        if frontier.isEmpty():
            return seen.where("depth > 0").select(F.lit(start).alias("src"), "dst", "depth")
        seen = seen.union(frontier)


def chain_end(links: DataFrame, ends: DataFrame, limit: int = 32) -> DataFrame:
    """(id, end_id, depth): where following links(id, next) first meets ends(id); cycles and loose ends give null."""
    hops = links.select(F.col("id").alias("guid"), F.col("next").alias("hop"))
    marks = ends.select(F.col("id").alias("mark")).distinct()
    hops = durable(hops)
    here = links.select("id").distinct().select(F.col("id").alias("guid"), F.col("id").alias("at"))
    done: list[DataFrame] = []
    for depth in range(1, limit + 1):
        moved = here.join(hops.withColumnRenamed("guid", "at"), "at").select("guid", F.col("hop").alias("at"))
        marked = durable(moved.join(marks, F.col("at") == F.col("mark"), "left"))
        done.append(marked.where("mark IS NOT NULL").select("guid", F.col("at").alias("end_id"), F.lit(depth).alias("depth")))
        here = marked.where("mark IS NULL AND at IS NOT NULL").select("guid", "at")
        if here.isEmpty():
            break
    return links.select(F.col("id").alias("guid")).distinct().join(reduce(DataFrame.union, done), "guid", "left").withColumnRenamed("guid", "id")


def flatten(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """(root, path, value) of the leaves of nodes(id, parent, name, value): names joined by dots from the root.

    Roots have no parent; a leaf is a node with a value; nesting beyond `limit` levels is cut off.
    """
    here = nodes.where("parent IS NULL").select(F.col("id").alias("root"), "id", F.col("name").alias("path"), "value")
    out = [here.where("value IS NOT NULL")]
    below = nodes.where("parent IS NOT NULL").select(F.col("id").alias("child"), "parent", "name", F.col("value").alias("leaf"))
    for _ in range(limit):
        here = durable(here.join(below, F.col("id") == F.col("parent")).select("root", F.col("child").alias("id"), F.concat("path", F.lit("."), "name").alias("path"), F.col("leaf").alias("value")))
        if here.isEmpty():
            break
        out.append(here.where("value IS NOT NULL"))
    return reduce(DataFrame.union, out).select("root", "path", "value")


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last in the given order."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
