"""The cache query shortens a table without gathering it in the driver."""

from pyspark.sql import DataFrame

from ashlar.plans.catalog import QUERIES


def test_no_table_is_collected(spark, monkeypatch):
    sizes = []
    plain = DataFrame.collect if not hasattr(spark.range(1), "_jdf") else type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: sizes.append(len(rows := plain(self))) or rows)
    got = QUERIES["q_model_cache"](spark, "/root/testdata/sf0.001")
    assert max(sizes, default=0) <= 20
    rows = {r.name: (r.n, r.before, r.valid, r.damaged) for r in got.toLocalIterator()}
    assert rows["voids"][0] > 20 and rows["voids"][1:] == (False, True, False)
