"""Session helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a session on one machine gets a temporary folder; a cluster raises, as
    executors there would write where nobody else can read.
    """
    conf = spark.sparkContext.getConf()
    if conf.contains("spark.checkpoint.dir"):
        return conf.get("spark.checkpoint.dir").rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if not hasattr(spark, "_ashlar_dir"):
        spark._ashlar_dir = f"file://{tempfile.mkdtemp(prefix='ashlar-')}"
    return spark._ashlar_dir


#: Rows that a Python worker is handed at once while a table is written; texts may be long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: On a local disk Hadoop runs a chmod process for each folder, file and checksum file that it makes, and until that process has
#: its own image it stands beside the JVM with all of its memory. Without checksum and marker files there are fewer; Parquet
#: has page checksums of its own. Other stores ignore the first two.
_PLAIN = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage durably.

    A lost executor then costs a re-read, never a recomputation, and values that depend on the
    physical layout (row numbers, nonces) stay the same on every later read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ashlar-tables/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        _make_folders(spark, path)
        df.write.mode("append").options(**_PLAIN).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    release_memory(spark)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._ashlar_path = path
    return out


def _make_folders(spark: SparkSession, path: str) -> None:
    """Makes a table's folders, and those of the writer's job, by the JVM itself, so that the driver runs no process for them."""
    if path.startswith("file:"):
        jvm = spark.sparkContext._jvm
        local = jvm.org.apache.hadoop.fs.Path(f"{path}/_temporary/0/_temporary").toUri().getPath()
        jvm.java.io.File(local).mkdirs()


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stage() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_ashlar_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of jobs that have ended, which else wait for a collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_memory(spark: SparkSession) -> None:
    """Gives back what the driver's JVM holds without need: heap beyond half of its limit, and freed native memory.

    Each plan is compiled in native memory that the C library keeps once it is freed, so a driver grows with the plans it has
    run, whatever the heap. A JVM that cannot trim (not Linux, or older than 17.0.9) keeps it.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        jvm.System.gc()
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # The server's class is not open to callers; its interface is.
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(kind)
    given[0], given[1] = command, "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(beans, given)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended already
            return


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of df has them in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else. Pure ASCII texts take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal digits, modulo 3; remainder 1 marks the held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """True for held-out rows; rows without an id are never learned from either."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))
