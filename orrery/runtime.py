"""Session plumbing shared by every module: worker import path and scratch space."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytes of an Arrow batch where the session names no bound: a batch and its copies count per running Python worker.
BATCH_BYTES = 8 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if PYTHONPATH lacks it.

    On a cluster the package is expected to be installed or shipped with
    ``--py-files``; the extra path entry is then simply unused.
    """
    env = spark.sparkContext.environment
    if spark.conf.get(_ARROW_BYTES, "1") == "1":  # not set by the user
        spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only where the session names none and runs in
    this process (tests); on a cluster that is an error, since executors don't
    share a machine's folders.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="orrery-")
        sc.setCheckpointDir(named)
    return named


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; its scratch folder goes with it
        pass


#: Spark removes a query's shuffle files at its end; lost ones are made again by a retry of their stage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spill_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    This cuts lineage and survives the loss of any executor. The files go with
    ``forget``, or when the driver ends; shuffle files of the write go at its end
    (``release`` alone leaves those of the last query until the next one ends).
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/orrery-{tag}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return keep_until_exit(spark.read.schema(schema).parquet(path), path)


def keep_until_exit(df: DataFrame, path: str) -> DataFrame:
    """Mark ``df`` as the reader of a scratch table of ours."""
    df._orrery_path = path
    atexit.register(_forget, df.sparkSession, path)
    return df


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that no later action reads."""
    for df in tables:
        path = getattr(df, "_orrery_path", None)
        if path:
            _forget(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of plans that nothing refers to any more be deleted now: Spark does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Plan nodes that give the same rows in the same order each time they run.
_REPEATABLE = {"LogicalRelation", "LocalRelation", "LogicalRDD", "Project", "Filter", "Relation"}


def stable(df: DataFrame, tag: str) -> DataFrame:
    """``df`` itself if it is a scan with projections and filters, else a scratch table of it.

    After a shuffle the order of rows isn't fixed, so a plan that runs twice, or
    whose lost tasks run again, could number them differently.
    """
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _REPEATABLE:
            return spill_table(df, tag)
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return df


def size_of(df: DataFrame) -> int:
    """Bytes of ``df`` as the optimizer estimates them (files on disk for a scan; nothing is read), 0 if it has no idea."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def cut(df: DataFrame) -> DataFrame:
    """Reliable eager checkpoint (small tables in iterative algorithms)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint(eager=True)


def arrow_schema(schema: StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
