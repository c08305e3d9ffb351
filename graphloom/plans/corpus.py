"""A corpus of projects under a manifest: measured, checked against lower bounds, timed, and compared with a baseline."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import compare as K
from graphloom.plans.project import analyse
from graphloom.sources.scan import read_manifest

RUN = "case string, files long, functions long, classes long, edges long, chains long, parse_errors long, build double, chain double, analysis double, total double"


def measure(spark: SparkSession, name: str, root: str, **options) -> tuple:
    """One row of RUN: the counts of a project, and seconds of the build, the chains and the metrics."""
    t = [time.perf_counter()]
    a = analyse(spark, root, **options)
    edges = a.edges.count()
    t.append(time.perf_counter())
    chains = a.chains().count()
    t.append(time.perf_counter())
    for df in (a.hotspots(), a.dead_functions(), a.coupling(), a.complexity(), a.unused_imports(), a.hierarchy()):
        df.write.format("noop").mode("overwrite").save()
    t.append(time.perf_counter())
    counts = (a.modules.count(), a.symbols.count(), a.classes.count(), edges, chains, a.parse_errors.count())
    return (name, *counts, t[1] - t[0], t[2] - t[1], t[3] - t[2], t[3] - t[0])


def run(spark: SparkSession, manifest: str, warmup: int = 0, iterations: int = 1) -> DataFrame:
    """RUN rows of all projects of a manifest, one for each iteration."""
    base, rows = Path(manifest).parent, []
    for p in read_manifest(manifest):
        options = {"languages": p.get("languages")} if p.get("languages") else {}
        for i in range(warmup + iterations):
            r = measure(spark, p["name"], str(base / p["path"]), **options)
            if i >= warmup:
                rows.append(r)
    return spark.createDataFrame(rows, RUN)


def check(spark: SparkSession, manifest: str, runs: DataFrame) -> DataFrame:
    """case, label, ok: each bound that a project's entry has (min_* of a count, max_parse_errors)."""
    out = None
    for p in read_manifest(manifest):
        least = {c: p[f"min_{c}"] for c in K.COUNTERS if f"min_{c}" in p}
        most = {c: p[f"max_{c}"] for c in K.COUNTERS if f"max_{c}" in p}
        if least or most:
            one = K.thresholds(runs.where(F.col("case") == p["name"]), least, most)
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "case string, label string, ok boolean")


def report(runs: DataFrame) -> DataFrame:
    """One row a case: its counts, and the median of each timing."""
    return runs.groupBy("case", *K.COUNTERS).agg(*[F.median(t).alias(t) for t in K.TIMINGS])


def compared(baseline: DataFrame, candidate: DataFrame, threshold: float = 15.0) -> DataFrame:
    """Aligned reports with deltas, drift and the status of the total time. Cases that only one has, or that one has twice, are an error."""
    for name, r in (("baseline", baseline), ("candidate", candidate)):
        if not K.duplicates(r).isEmpty():
            raise ValueError(f"the {name} names a case twice")
    a = K.align(baseline, candidate)
    alone = [f"{r['case']} ({r['side']})" for r in a.where("side <> 'both'").orderBy("case").limit(20).collect()]
    if alone:
        raise ValueError("cases of one report only: " + ", ".join(alone))
    return K.deltas(a).withColumn("status", K.status(K.percent_change(F.col("base_total"), F.col("cand_total")), threshold))


def markdown(compared_rows: DataFrame, top: int = 5) -> str:
    """The first rows as a table."""
    rows = compared_rows.orderBy("case").limit(top).collect()
    head = ["| case | status | drift |", "|-|-|-|"]
    return "\n".join([*head, *[f"| {r['case']} | {r['status']} | {'yes' if r['drift'] else 'no'} |" for r in rows]])
