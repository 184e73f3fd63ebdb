"""Tables that grow by an explode are joined without a broadcast, however small Spark takes them to be."""

import pytest
from pyspark.sql import functions as F

from ashlar.llm import components


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that components writes, by label."""
    seen = {}
    write = components.stage

    def spy(df, label):
        seen.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(components, "stage", spy)
    return seen


def test_exploded_members_are_not_broadcast(spark, plans):
    nodes = components.stage(spark.range(200).select(F.xxhash64("id").alias("fp"), F.col("id").alias("i")), "nodes")
    members = nodes.select(F.explode(F.array(*[F.col("i").bitwiseAND(F.lit(~(1 << k))) * 64 + k for k in range(8)])).alias("bucket"), F.col("i").alias("node"))
    found = components.link_buckets(members, lambda x, y: components.hamming(F.col(f"node_{x}"), F.col(f"node_{y}")) <= 1, "x")
    assert {r.component for r in found.collect()} == {0} and found.count() == 200
    for label in ("x-members", "x-pairs"):
        assert "SortMergeJoin" in plans[label][0]
    assert "Broadcast" not in plans["x-members"][0]
