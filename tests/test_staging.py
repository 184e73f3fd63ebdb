"""Queries over lines write what they use, once; type facts and orphans move one row an item."""

import itertools

import pytest
from pyspark.sql import functions as F

from ashlar.operators import facts
from ashlar.operators.subset import orphans
from ashlar.plans import star_model
from ashlar.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
KEYS = {"l_orderkey", "l_linenumber"}


@pytest.mark.parametrize("name, more", [("q_orphan_gc", {"l_partkey", "l_suppkey"}), ("q_products_denorm", {"l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"}), ("q_ancestors", set())])
def test_only_used_columns_are_staged(spark, monkeypatch, name, more):
    class Seen(Exception):
        pass

    def look(df):
        raise Seen(set(df.columns))

    monkeypatch.setattr(star_model, "durable", look)
    with pytest.raises(Seen) as e:
        QUERIES[name](spark, SF)
    assert e.value.args[0] == KEYS | more


def test_nested_layout_reads_lines_once(spark):
    plan = QUERIES["q_substrate_nested"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" in plan and "Window" not in plan


def test_inherited_suppresses_stated_keys_only(spark):
    own = spark.createDataFrame([("a", "p", "x", "1"), ("a", "p", "x", "1"), ("b", "p", None, "2"), ("c", "q", "x", "3")], "guid string, pset string, prop string, value string")
    of_types = spark.createDataFrame([("T", "p", "x", "7"), ("T", "p", "x", "7"), ("T", "p", None, "8"), ("U", "q", "x", "9")], "guid string, pset string, prop string, value string")
    links = spark.createDataFrame([("a", "T"), ("b", "T"), ("d", "T"), ("c", "U")], "guid string, type_guid string")
    got = facts.inherited(own, of_types, links, ["pset", "prop"])
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
    handed = [("a", "p", None, "8"), ("b", "p", "x", "7"), ("b", "p", "x", "7"), ("b", "p", None, "8"), ("d", "p", "x", "7"), ("d", "p", "x", "7"), ("d", "p", None, "8")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([*map(tuple, own.collect()), *handed], key=repr)


def test_orphans_with_cycles_and_repeats(spark):
    refs = [("a", "x"), ("a", "x"), ("b", "x"), ("x", "y"), ("x", "z"), ("k", "z"), ("y", "w"), ("w", "w"), ("a", "a"), ("y", "v"), ("v", "u"), ("b", "v")]
    for gone in itertools.chain.from_iterable(itertools.combinations("abk", n) for n in range(4)):
        dead = set(gone)
        while new := {d for _, d in refs if d not in dead and all(s in dead for s, t in refs if t == d)}:
            dead |= new
        got = orphans(spark.createDataFrame(refs, "src string, dst string"), spark.createDataFrame([(g,) for g in gone], "node string")) if gone in (("a", "b"), ("a", "b", "k")) else None
        if got is not None:
            assert {r.node for r in got.select(F.col("node")).collect()} == dead - set(gone)
