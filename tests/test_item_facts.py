"""Facts of one item: the same rows as in the tables of all items, without working those out."""

from pyspark.sql import functions as F

from ashlar.api import FACTS, Model
from ashlar.plans import step_model


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_facts_of_one_item_equal_the_whole_tables(spark):
    m = Model(spark, step_model.step_file(spark, "/root/testdata/sf0.001"))
    # A layered material and an inherited grade; a grade of its own; an order's quantities.
    guids = ["C" + "2".zfill(21), "C" + "3".zfill(21), m.voids.agg(F.min("opening_guid")).first()[0]]
    found = {(g, t): rows(m.find(t, g, 1000)) for g in guids for t in FACTS}
    assert not set(FACTS) & set(m.tables.made)
    assert found == {(g, t): rows(m.table(t).where(F.col("guid") == g)) for g in guids for t in FACTS}
    assert all(found[g, t] for g in guids[:2] for t in ("psets", "materials", "classifications")) and found[guids[2], "quantities"]
    assert rows(m.find("psets", "nobody")) == []


def test_walks_read_edges_that_were_worked_out_once(spark):
    m = Model(spark, step_model.step_file(spark, "/root/testdata/sf0.001"))
    c = "C" + "4".zfill(21)
    m.descendants(c), m.ancestors(c)
    assert {"_children", "parent_of"} <= set(m.tables.made)
