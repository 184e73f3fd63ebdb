"""A balance of minus zero, or just below it, reads the same from the file as from its SQL."""

import glob
import os

import duckdb

from ashlar.plans import step_model

SF = "/root/testdata/sf0.001"


def test_balances_that_round_to_minus_zero(spark, tmp_path):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[:-8]
        pick = "SELECT * REPLACE (CASE c_custkey WHEN 1 THEN CAST('-0.0' AS DOUBLE) WHEN 2 THEN -0.001 WHEN 3 THEN 0.0 WHEN 4 THEN -0.01 ELSE c_acctbal END AS c_acctbal)" if name == "customer" else "SELECT *"
        con.execute(f"COPY ({pick} FROM '{path}') TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = step_model.q_step_psets(spark, f"file://{tmp_path}").where("prop_name = 'Balance'").select("guid", "value")
    want = con.execute(f"SELECT guid, value FROM ({step_model.SQL['q_step_psets']}) WHERE prop_name = 'Balance'").fetchall()
    assert "-0.00" in {v for _, v in want}
    assert sorted(map(tuple, got.collect())) == sorted(want)
