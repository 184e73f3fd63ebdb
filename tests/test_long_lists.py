"""Relationships that list very many items: memory of the scan, and what is copied for each item."""

import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ashlar.functions import step_text
from ashlar.operators import styles
from ashlar.operators.index import Tables, dealt

SCAN = """
import resource
from ashlar.sources import step
raw = ("#37=IFCRELASSOCIATESMATERIAL('m',$,$,$,(" + ",".join(f"#{i}" for i in range(1000000, 1300000)) + "),#30);").encode()
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
before = peak()
assert [len(r[3]) for r in step.scan(raw, 0, len(raw))] == [len(raw) - len("#37=IFCRELASSOCIATESMATERIAL();")]
print((peak() - before) // 1024)
"""


def test_a_long_record_is_scanned_in_little_memory():
    out = subprocess.run([sys.executable, "-c", SCAN], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 100  # MB, for a record of 3


def test_lists_are_one_token():
    body = "'a (b, c)',$,(#1,#2,#3),((1.,2.),(3.,4.)),IFCLABEL('x, (y'),/* (,) */ .T."
    assert step_text.split_args(body) == ["'a (b, c)'", "$", "(#1,#2,#3)", "((1.,2.),(3.,4.))", "IFCLABEL('x, (y')", ".T."]
    assert "(#1,#2,#3)" in step_text._TOKEN.findall(body)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        (1, "IFCMATERIAL", "'brown',$,$"), (2, "IFCRELASSOCIATESMATERIAL", "'m',$,$,$,(#10,#11),#1"), (3, "IFCRELAGGREGATES", "'a',$,$,$,#10,(#11)"),
        (10, "IFCWALL", "'A000000000000000000000',$,$,$,$,$,$,$"), (11, "IFCWALL", "'B000000000000000000000',$,$,$,$,$,$,$"),
    ]
    return Tables(spark.createDataFrame([("f", i, i, t, a, "") for i, t, a in rows], "file_id string, ord long, step_id long, type string, args string, raw string"))


def test_lists_are_dealt_without_the_fields_beside_them(spark, tables):
    """A list's elements would each be written with all fields of the record, which is the square of its length."""
    rows = dealt(tables.of("IFCRELASSOCIATESMATERIAL"), step_text.refs(F.get("f", F.lit(4))), "item", "ord", place="at")
    assert [tuple(r) for r in rows.orderBy("at").collect()] == [(2, 0, 10), (2, 1, 11)]
    for df in (rows, tables._edges("IFCRELAGGREGATES", 4, 5), styles.material_colours(tables)):
        generates = re.findall(r"Generate explode\(.*?\), \[(.*?)\], (?:true|false)", df._jdf.queryExecution().executedPlan().toString().replace("posexplode", "explode"))
        assert [kept for kept in generates if re.search(r"\bf#", kept)] == []
    names = sorted(tuple(r) for r in tables.materials().select("guid", "role", "material_name").collect())
    assert names == [("A" + "0" * 21, "direct", "brown"), ("B" + "0" * 21, "direct", "brown")]
