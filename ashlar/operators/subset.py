"""Self-contained subsets of a model: closures, relationship rules, orphan collection, rewriting of records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import step_text as step
from .durable import durable
from .graph import reachable

# For each relationship, the position of the anchor and whether it is a list, and the position of the pull.
REL_RULES = """
IFCRELAGGREGATES 5 list 4
IFCRELCONTAINEDINSPATIALSTRUCTURE 4 list 5
IFCRELDEFINESBYPROPERTIES 4 list 5
IFCRELDEFINESBYTYPE 4 list 5
IFCRELASSOCIATESMATERIAL 4 list 5
IFCRELASSOCIATESCLASSIFICATION 4 list 5
IFCRELNESTS 5 list 4
IFCRELASSIGNSTOGROUP 4 list 6
IFCRELDECLARES 5 list 4
IFCRELVOIDSELEMENT 4 one 5
IFCRELFILLSELEMENT 5 one 4
IFCRELCOVERSBLDGELEMENTS 4 one 5
IFCRELSERVICESBUILDINGS 4 one 5
"""


def rules(spark: SparkSession) -> DataFrame:
    """(type, anchor, anchor_is_list, pull) of the thirteen relationships that subsets follow."""
    rows = [(t, int(a), kind == "list", int(p)) for t, a, kind, p in (line.split() for line in REL_RULES.strip().splitlines())]
    return spark.createDataFrame(rows, "type string, anchor int, anchor_is_list boolean, pull int")


def prune_anchors(rels: DataFrame, kept: DataFrame) -> DataFrame:
    """rels(rel_id, anchor) whose anchor is among kept(node)."""
    return rels.join(kept.select(F.col("node").alias("anchor")), "anchor", "left_semi")


def orphans(refs: DataFrame, gone: DataFrame) -> DataFrame:
    """(node): what only gone(node) and orphans of theirs refer to, in refs(src, dst), to a fixpoint.

    A round counts the references of what has just gone; what has then lost as many as lead to it goes next. All other
    references are neither joined nor counted again.
    """
    dead = fresh = durable(gone.select("node").distinct())
    found = dead.where(F.lit(False))
    lost = None
    while True:
        hits = durable(refs.join(fresh, refs.src == fresh.node, "left_semi").groupBy("dst").agg(F.count("*").alias("n")).where("dst IS NOT NULL"))
        lost = hits if lost is None else durable(lost.union(hits).groupBy("dst").agg(F.sum("n").alias("n")))
        held = refs.join(hits.select("dst"), "dst", "left_semi").groupBy("dst").agg(F.count("*").alias("held"))
        over = held.join(lost, "dst").where("n = held").select(F.col("dst").alias("node"))
        fresh = durable(over.join(dead, "node", "left_anti"))
        if fresh.isEmpty():
            return found
        found = found.union(fresh)
        dead = durable(dead.union(fresh))


def resolve(records: DataFrame, guids: list[str]) -> DataFrame:
    """(node) of the records with the given ids; raises with the missing ones."""
    spark = records.sparkSession
    wanted = spark.createDataFrame([(g,) for g in guids], "guid string")
    own = records.select("step_id", step.string(F.regexp_extract("args", r"^\s*('(?:[^']|'')*')", 1)).alias("guid"))
    joined = wanted.join(own, "guid", "left")
    missing = [r.guid for r in joined.where("step_id IS NULL").limit(20).collect()]
    if missing:
        raise ValueError(f"unknown ids: {missing}")
    return joined.select(F.col("step_id").alias("node"))


@F.pandas_udf(StringType())
def splice(raw: pd.Series, position: pd.Series, keep: pd.Series) -> pd.Series:
    """Records whose list at a top-level position is cut down to the given ids; all other text stays."""

    def one(text: str, at: int, ids: list[int]) -> str:
        opening = text.index("(")
        depth, field, start, i, quoted = 0, 0, opening + 1, opening + 1, False
        while i < len(text):
            c = text[i]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                if c == "(":
                    depth += 1
                elif c == ")" and depth:
                    depth -= 1
                elif (c == "," and not depth) or (c == ")" and not depth):
                    if field == at:
                        break
                    field, start = field + 1, i + 1
            i += 1
        wanted = set(ids)
        kept = [r for r in re.findall(r"#(\d+)", text[start:i]) if int(r) in wanted]
        return text[:start] + "(" + ",".join(f"#{r}" for r in kept) + ")" + text[i:]

    return pd.Series([one(t, int(p), list(k)) for t, p, k in zip(raw, position, keep, strict=True)])


def subset(records: DataFrame, guids: list[str]) -> DataFrame:
    """records(ord, step_id, type, args, raw) that the given items need, with relationship lists cut down.

    Starts from the items, closes over forward references, then keeps each relationship any of whose
    anchors survives, pulls in its other side and what that refers to, until nothing changes.
    The project and what it refers to are kept too.
    """
    spark = records.sparkSession
    records = durable(records)
    is_rel = F.coalesce(F.col("type").startswith("IFCREL"), F.lit(False))
    forward = durable(records.where(~is_rel).select(F.col("step_id").alias("src"), F.explode(F.array_distinct(step.all_refs(F.col("args")))).alias("dst")))
    # One row a relationship is written before its anchors are dealt out, so that no text or list is copied or looked through for each of them.
    f = records.join(F.broadcast(rules(spark)), "type").withColumn("f", step.split_fields("args"))
    anchors = step.refs(F.get("f", F.col("anchor")))
    rels = durable(f.select("step_id", "anchor", "anchor_is_list", anchors.alias("anchors"), F.array_union(step.refs(F.get("f", F.col("pull"))), F.array_except(step.all_refs(F.col("args")), anchors)).alias("pulled")))
    held = durable(rels.select("step_id", F.explode("anchors").alias("anchor_id")))
    keep = reachable(resolve(records, guids).union(records.where("type = 'IFCPROJECT'").select("step_id")), forward)
    size = keep.count()
    while True:
        live = held.join(keep, F.col("anchor_id") == F.col("node"), "left_semi").select("step_id").distinct()
        pulled = rels.join(live, "step_id", "left_semi").select(F.explode("pulled").alias("node")).distinct()
        keep = reachable(keep.union(pulled).distinct(), forward)
        grown = keep.count()
        if grown == size:
            break
        size = grown
    ids = held.join(keep, F.col("anchor_id") == F.col("node"), "left_semi").groupBy("step_id").agg(F.collect_list("anchor_id").alias("ids"))
    live = rels.select("step_id", "anchor", "anchor_is_list").join(ids, "step_id")
    plain = records.where(~is_rel).join(keep, F.col("step_id") == F.col("node"), "left_semi")
    cut = records.join(live, "step_id").withColumn("raw", F.when(F.col("anchor_is_list"), splice("raw", "anchor", "ids")).otherwise(F.col("raw")))
    return plain.unionByName(cut.select(*records.columns))
