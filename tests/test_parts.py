"""Models written in parts are one model; parts apart are files of their own."""

import os

import pytest
from pyspark.sql import functions as F

from ashlar.plans import step_model
from ashlar.sources import step
from ashlar.streaming import stream_records

COLUMNS = ("ord", "step_id", "type", "args", "raw")


@pytest.fixture
def records(spark):
    text = F.concat(F.lit("#"), F.col("id").cast("string"), F.lit("=IFCLABEL('it''s; /* #1=X(); */ ENDSEC; DATA; é"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), F.lit("',#1);"))
    return spark.range(1, 2001).repartition(7).select(F.col("id").alias("ord"), text.alias("raw"))


def rows(df):
    """A piece's last record leaves the blanks behind it to the next piece."""
    return sorted((*r[:-1], r.raw.rstrip()) for r in df.select(*COLUMNS).collect())


def texts(folder):
    return [open(os.path.join(folder, f), "rb").read() for f in sorted(os.listdir(folder)) if f.startswith("part-")]


def test_parts_are_one_model(spark, records, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    step.write_step(records, step_model.HEAD, one)
    step.write_step(records, step_model.HEAD, many, part=10_000)
    assert len(texts(one)) == 1 and len(texts(many)) > 5
    assert b"".join(texts(many)) == texts(one)[0]
    assert max(map(len, texts(many))) < 60_000
    want = rows(step.read_step(spark, one))
    assert len(want) == 2000
    assert rows(step.read_step(spark, many)) == want == rows(step.read_step(spark, many, splitBytes="1000"))
    assert step.read_step(spark, many).select("file_id").distinct().count() == 1
    assert step.read_step(spark, many).rdd.getNumPartitions() == len(texts(many))
    assert step.read_step(spark, f"{one},{many}").count() == 4000
    a, b = step.header(one), step.header(many)
    assert {k: v for k, v in a.items() if k not in ("path", "mtime_ns")} == {k: v for k, v in b.items() if k not in ("path", "mtime_ns")}


def test_a_model_without_its_last_part_is_truncated(spark, records, tmp_path):
    many = str(tmp_path / "many")
    step.write_step(records, step_model.HEAD, many, part=10_000)
    last = os.path.join(many, sorted(f for f in os.listdir(many) if f.startswith("part-"))[-1])
    size = os.path.getsize(last)
    with open(last, "r+b") as f:
        f.seek(size - 40)
        f.write(b" " * 40)
    with pytest.raises(Exception, match="truncated"):
        step.read_step(spark, many).count()


def test_parts_apart_are_files(spark, records, tmp_path):
    apart, out = str(tmp_path / "apart"), str(tmp_path / "out")
    step.write_step(records, step_model.HEAD, apart, part=10_000, apart=True)
    assert len(texts(apart)) > 5
    for text in texts(apart):
        assert text.startswith(b"ISO-10303-21;") and text.count(step.TRAILER) == 1 and text.rstrip().endswith(b"END-ISO-10303-21;")
    assert sorted(r.step_id for r in step.read_step(spark, apart).collect()) == list(range(1, 2001))
    stream_records(spark, f"{apart}/part-*").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(out)
    assert sorted(r.step_id for r in seen.collect()) == list(range(1, 2001))
    assert {r.schema for r in seen.select("schema").distinct().collect()} == {"IFC4"}


def test_records_of_two_a_key_have_room():
    """Step ids of keys up to the room of a kind stay apart."""
    double = {"single", "part_prop", "quantity_value"}
    spans = sorted((start, start + step_model.ROOM * (2 if kind in double else 1)) for kind, start in step_model.BASE.items())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
