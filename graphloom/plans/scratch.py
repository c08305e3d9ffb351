"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: By application: the folder of this machine that stands in where none is set.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of this machine only where it is unset and the executors are on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


def cut(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, with a folder for each value of the columns by (the last ones), as a Parquet table of the shared folder: lineage ends there, and lost executors lose nothing of it. It goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
