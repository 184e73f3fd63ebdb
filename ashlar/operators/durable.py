"""Cutting a plan's lineage in a way that outlives executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that stand twice are left out by name up to this many, by a join and a new table beyond.
TWICE = 1000
_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset, a session on one machine gets a temporary one; a cluster raises, as
    executors there would write where nobody else can read.
    """
    conf = spark.sparkContext.getConf()
    if conf.contains("spark.checkpoint.dir"):
        return conf.get("spark.checkpoint.dir").rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='ashlar-')}")


def durable(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df written as a table in the shared folder and read back.

    A lost executor then costs a re-read; readers prune columns and know the size, so that small
    tables are broadcast by Spark's own threshold. A closer codec is for tables that are not joined, since that threshold looks at
    files. Tables go when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ashlar-durable/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def once_each(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with one for each step_id within `keys`: the last value at the first place. rows is read several times.

    Only ids are counted; texts of those that stand twice alone are dealt out and merged, so a model is neither shuffled nor sorted for
    the few. The key is step_id, with others before it.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    twice = durable(counted)
    named = [r[0] for r in twice.select("step_id").distinct().limit(TWICE + 1).collect()]
    if not named:
        return rows
    values = [c for c in rows.columns if c not in (*keys, "ord")]
    again = rows.where(F.col("step_id").isin(named)) if len(named) <= TWICE else rows
    merged = again.join(twice, [*keys], "left_semi").groupBy(*keys).agg(F.min("ord").alias("ord"), F.max_by(F.struct(*values), "ord").alias("r")).select(*keys, "ord", "r.*").select(*rows.columns)
    if len(named) > TWICE:
        return durable(rows.join(twice, [*keys], "left_anti").unionByName(merged).select(*rows.columns))
    # Among several files an id may stand twice in one only; the others' rows of that id stay as they are.
    other = again.join(twice, [*keys], "left_anti")
    return rows.where(~F.col("step_id").isin(named)).unionByName(durable((merged.unionByName(other) if len(keys) > 1 else merged).coalesce(1)))


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is None:
                return
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended already
            return
