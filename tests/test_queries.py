"""Every query of the engine against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ashlar.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def check(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    same = lambda rows: sorted((tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert same(got.select(*columns).collect()) == same(want.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    check(spark, con, name)


@pytest.mark.parametrize("name", ["q_type_summary", "q_parent", "q_step_parse", "q_step_decode", "q_value_format", "q_mesh_surfaces", "q_mesh_quality", "q_clash_broad", "q_point_cloud", "q_floors_rule", "q_diff_changed"])
def test_generated_code_equals_sql(spark, con, name):
    """The session of the tests interprets expressions; these run as the code that sessions generate by default."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
    try:
        check(spark, con, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_entry_and_lists(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
