"""What writing a table between steps costs besides its rows."""

import os
import subprocess
import sys
from pathlib import Path

from ashlar.llm.common import stage

PROGRAM = """
import sys
from pyspark.sql import SparkSession
from ashlar.llm.common import stage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
assert sorted(r.id for r in stage(spark.range(5), "five").collect()) == [0, 1, 2, 3, 4]
assert stage(spark.range(0), "none").count() == 0
"""

HELD = """
import re, sys
from pyspark.sql import SparkSession
from ashlar.llm.common import stage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
stage(spark.range(5), "five").count()
jvm = spark.sparkContext._jvm
status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"
resident = lambda: int(re.search("VmRSS:[^0-9]+([0-9]+)", open(status).read())[1]) / 1024
tools = [jvm.java.util.zip.Deflater(9) for _ in range(800)]
for i, tool in enumerate(tools):
    if i % 40:
        tool.end()
before = resident()
stage(spark.range(5), "five")
print("HELD", before, resident())
"""


def test_tables_have_no_side_files(spark):
    folder = Path(stage(spark.range(9).repartition(3), "nine")._ashlar_path.removeprefix("file:"))
    names = sorted(x.name for x in folder.rglob("*"))
    assert names and all(x.startswith("part-") and x.endswith(".parquet") for x in names)


def test_the_driver_runs_no_process_for_a_table(tmp_path):
    log, tools = tmp_path / "log", tmp_path / "tools"
    tools.mkdir()
    (tools / "chmod").write_text(f'#!/bin/sh\necho "$*" >> {log}\nPATH=/usr/bin:/bin exec chmod "$@"\n')
    (tools / "chmod").chmod(0o755)
    root = Path(__file__).resolve().parents[2]
    env = os.environ | {"PATH": f"{tools}:{os.environ['PATH']}", "PYTHONPATH": str(root)}
    subprocess.run([sys.executable, "-c", PROGRAM, f"file://{tmp_path}/shared"], env=env, cwd=tmp_path, check=True, capture_output=True, timeout=200)
    of_tables = [x for x in log.read_text().splitlines() if "/ashlar-tables/" in x] if log.exists() else []
    # What is left are the tasks' own: a folder and a file for each that has rows.
    assert all("/_temporary/0/_temporary/attempt_" in x for x in of_tables) and len(of_tables) <= 4, of_tables


def test_the_driver_gives_native_memory_back_at_each_table(tmp_path):
    # All of the heap is touched from the start, so that what changes is native.
    args = '--driver-memory 500m --driver-java-options "-Xms500m -XX:+AlwaysPreTouch" pyspark-shell'
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), "PYSPARK_SUBMIT_ARGS": args}
    done = subprocess.run([sys.executable, "-c", HELD, f"file://{tmp_path}/shared"], env=env, cwd=tmp_path, check=True, capture_output=True, text=True, timeout=200)
    before, after = map(float, done.stdout.split("HELD")[1].split())
    # 780 of 800 deflaters were freed, with some in use between them.
    assert after < before - 60, (before, after)
