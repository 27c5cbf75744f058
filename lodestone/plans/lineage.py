"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
#: Spark's own setting: shuffle files go when the query that made them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Input bytes for each task that writes, where ``settle`` is told its input.
TASK_BYTES = 8 << 20
#: Seconds between two collections of garbage that ``settle`` asks for.
PAUSE_S = 5
_collected = [0.0]


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of our own, on one machine only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        top = spark.sparkContext.getCheckpointDir()
    return top.rstrip("/")


def settle(df: DataFrame, *inputs: DataFrame, tasks: int = 1) -> DataFrame:
    """Write df to the shared folder and read it back.

    Lineage ends there, a lost executor loses nothing of it, and Spark drops the shuffle files of what
    made it at once. ``release`` deletes the files; what is left goes when the application ends.
    inputs: the settled tables that df is made from. If they are small, the last stage has a task for each
    TASK_BYTES of them, ``tasks`` at least, and not one for each shuffle partition: a file costs its executor
    two processes (``chmod``) where Hadoop's native library is missing."""
    spark = df.sparkSession
    if inputs:
        most = max(tasks, math.ceil(sum(map(settled_bytes, inputs)) / TASK_BYTES))
        if most < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(most)
    path = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    if time.monotonic() > _collected[0] + PAUSE_S:
        give_back(spark)
    return out


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage and give the memory back that it took.

    A heap that has once grown stays so, and the next step's Python workers stand beside it. One task for
    each executor, which an idle cluster deals one to each."""
    sc = spark.sparkContext
    n = max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()
    _collected[0] = time.monotonic()


def settled_bytes(df: DataFrame) -> int:
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def release(*settled: DataFrame) -> None:
    """Delete the files of settled tables that no later step reads."""
    for df in settled:
        _delete(df.sparkSession, df.settled_at)
        _written.pop(df.settled_at, None)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before the interpreter: its owner clears the folder
            return
