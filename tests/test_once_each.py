"""Ids that stand twice are merged without moving the rest."""

import pytest

from ashlar.operators import durable as module
from ashlar.operators.durable import durable, once_each
from ashlar.operators.index import Tables
from ashlar.sources import step

SCHEMA = "file_id string, ord long, step_id long, type string, args string, raw string"
ROWS = [("f", 1, 7, "IFCA", "1", "a"), ("f", 2, 8, "IFCB", "2", "b"), ("f", 3, 7, "IFCC", "3", "c"), ("g", 1, 7, "IFCD", "4", "d"), ("g", 2, 9, "IFCE", "5", "e")]


@pytest.mark.parametrize("limit", [1000, 0])
def test_the_last_value_stands_at_the_first_place(spark, monkeypatch, limit):
    monkeypatch.setattr(module, "TWICE", limit)
    rows = durable(spark.createDataFrame(ROWS, SCHEMA))
    for keys, want in ((("file_id", "step_id"), step.entity_table(rows)), (("step_id",), None)):
        some = rows if want is not None else rows.where("file_id = 'f'")
        got = once_each(some, *keys)
        assert got.columns == rows.columns
        expected = [tuple(r) for r in want.select(*rows.columns).collect()] if want is not None else [("f", 1, 7, "IFCC", "3", "c"), ("f", 2, 8, "IFCB", "2", "b")]
        assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_records_are_neither_shuffled_nor_sorted_for_repeated_ids(spark):
    t = Tables(spark.createDataFrame(ROWS[:3], SCHEMA))
    assert sorted(tuple(r) for r in t.records.collect()) == [(1, 7, "IFCC", "3"), (2, 8, "IFCB", "2")]
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = durable(spark.createDataFrame(ROWS, SCHEMA))
    assert once_each(rows.where("step_id > 7"), "step_id").count() == 2
    assert "Exchange" not in text(once_each(rows, "file_id", "step_id")) and "Exchange" not in text(t.records)


def test_a_body_is_replaced_without_shuffling_the_model_first(spark, monkeypatch):
    from ashlar import api
    from ashlar.plans import shape_model

    m = api.Model(spark, shape_model.step_file(spark, "/root/testdata/sf0.001"))
    seen = []
    monkeypatch.setattr(api.swap, "hotswap", lambda records, *_: seen.append(records) or (records, {}))
    monkeypatch.setattr(api.step, "write_step", lambda *_: None)
    m.hotswap("B" + "0" * 21, [], [], "unused")
    # The model's own table goes in; a merged copy of it would be another file.
    assert set(seen[0].inputFiles()) == set(m.records.inputFiles())
