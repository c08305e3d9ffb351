"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch for operators that hold whole texts in Python.
BATCH_ROWS = 256
#: Seconds between two rounds of release.
ROUND_S = 0.3


def reachable(spark: SparkSession) -> None:
    """Put this package on the path of Python workers that share this machine's files; elsewhere it is shipped with --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the texts that one Arrow batch holds; long texts make a batch of the default 10,000 rows too large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: By application: the folder of this machine that stands in where none is set.
_OWN: dict[str, str] = {}
#: The folders of the tables that materialize returned.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where it is unset, a temporary one of this machine, if the executors are on it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing that is written.

    The table goes when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize that nothing reads any more."""
    for x in tables:
        if path := _PATHS.pop(x, None):
            _remove(x.sparkSession, path)


def release(spark: SparkSession, rounds: int = 1) -> None:
    """Let Spark drop the shuffle files of finished jobs now, rather than at some later garbage collection of the driver.

    The job that has just ended is often still held by the driver in the first round; with a second one its files go too.
    """
    for k in range(rounds):
        if k:
            time.sleep(ROUND_S)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
