"""Watching a source tree: file events debounced by a quiet gap, and re-analysis of what changed."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import EXTENSIONS, SKIP_DIRS
from graphloom.operators.filters import watched

EVENTS = "ts timestamp, path string, content binary"


def debounced(events: DataFrame, gap: str = "1 second", *keys: str) -> DataFrame:
    """keys, started, n: one row for each run of events without a gap; for a stream set a watermark first."""
    w = F.session_window("ts", gap)
    # a stream's session windows need a key
    by = keys or (F.col("ts").isNull().alias("_all"),)
    return events.groupBy(w, *by).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("started"), "n")


def changed_sources(events: DataFrame) -> DataFrame:
    """The latest content of each watched path; a path whose latest content is null was removed."""
    e = events.where(watched(F.col("path"), tuple(EXTENSIONS)))
    return e.groupBy("path").agg(F.max_by(F.struct("content"), "ts").alias("c"), F.max("ts").alias("ts")).select("path", "c.content", "ts")


def merge_sources(current: DataFrame | None, changed: DataFrame) -> DataFrame:
    new = changed.where("content IS NOT NULL").select("path", "content")
    if current is None:
        return new
    return current.join(changed.select("path"), "path", "left_anti").select("path", "content").unionByName(new)


def _latest(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """The sources of the last batch before this one, from the tables by batch in folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    old = sorted(n for n in done if n < before)
    for n in old[:-2]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, str(n)), True)
    return spark.read.schema("path string, content binary").parquet(f"{folder}/{old[-1]}") if old else None


def tree_changes(root: str, seen: dict[str, tuple[int, int]]) -> list[str]:
    """Watched files under root that came, changed or went since the last call; seen holds their times and sizes."""
    now = {}
    for p in Path(root).rglob("*"):
        rel = p.relative_to(root)
        if p.suffix.lower().lstrip(".") in EXTENSIONS and not set(rel.parts[:-1]) & set(SKIP_DIRS) and p.is_file():
            st = p.stat()
            now[str(rel)] = (st.st_mtime_ns, st.st_size)
    changed = sorted(k for k in now.keys() | seen.keys() if now.get(k) != seen.get(k))
    seen.clear()
    seen.update(now)
    return changed


def watch_tree(root: str, analyse: Callable[[list[str]], object], gap: float = 1.0, poll: float = 0.25, rounds: int | None = None) -> None:
    """Call analyse with the changed paths whenever a source tree of this machine has changed and then been quiet for gap seconds; rounds: how many calls, for ever if None.

    What was analysed before is the cache's business, so a restart parses nothing twice.
    """
    seen: dict[str, tuple[int, int]] = {}
    tree_changes(root, seen)
    pending: set[str] = set()
    quiet = time.monotonic()
    while rounds is None or rounds > 0:
        time.sleep(poll)
        changed = tree_changes(root, seen)
        if changed:
            pending |= set(changed)
            quiet = time.monotonic()
        elif pending and time.monotonic() - quiet >= gap:
            analyse(sorted(pending))
            pending = set()
            rounds = None if rounds is None else rounds - 1


def watch(spark: SparkSession, directory: str, analyse: Callable[[DataFrame], object], checkpoint: str, gap: str = "1 second"):
    """A query over Parquet files of EVENTS that calls analyse with all current sources whenever a batch changed any; the trigger is the quiet gap.

    The sources are a table by batch beside the checkpoint, so a restart goes on from them; a batch that is run again writes the same table.
    """
    folder = f"{checkpoint.rstrip('/')}-sources"

    def on_batch(batch: DataFrame, number: int) -> None:
        changed = changed_sources(batch)
        if changed.isEmpty():
            return
        merge_sources(_latest(spark, folder, number), changed).write.mode("overwrite").parquet(f"{folder}/{number}")
        analyse(spark.read.schema("path string, content binary").parquet(f"{folder}/{number}"))

    stream = spark.readStream.schema(EVENTS).parquet(directory)
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(processingTime=gap).start()


def debounced_stream(spark: SparkSession, directory: str, name: str, gap: str = "1 second", delay: str = "0 seconds"):
    """Runs of events as an append-mode table in memory, for watching the watcher."""
    e = spark.readStream.schema(EVENTS).parquet(directory).withWatermark("ts", delay)
    return debounced(e, gap).writeStream.format("memory").queryName(name).outputMode("append").start()
