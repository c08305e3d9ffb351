"""Baseline and candidate reports, their alignment, deltas, drift, ownership and review focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import glob_regex

#: Of the parsed tables in a cache; what another version wrote isn't used.
CACHE_VERSION = "2"
COUNTERS = ("files", "functions", "classes", "edges", "chains", "parse_errors")
TIMINGS = ("build", "chain", "analysis", "total")
#: What a drifting counter points to.
ATTRIBUTION = {"files": "discovery", "functions": "symbol_extraction", "classes": "symbol_extraction", "edges": "call_resolution", "chains": "chain_enumeration", "parse_errors": "parse_health"}
PRIORITIES = ((8, "critical"), (6, "high"), (4, "medium"))


def align(baseline: DataFrame, candidate: DataFrame, key: str = "case") -> DataFrame:
    """Full outer join on key: base_* and cand_* columns, side: both, baseline_only, candidate_only."""
    b = baseline.select(F.col(key).alias("b_key"), *[F.col(c).alias(f"base_{c}") for c in baseline.columns if c != key])
    c = candidate.select(F.col(key).alias("c_key"), *[F.col(x).alias(f"cand_{x}") for x in candidate.columns if x != key])
    j = b.join(c, F.col("b_key") == F.col("c_key"), "full_outer")
    side = F.when(F.col("c_key").isNull(), "baseline_only").when(F.col("b_key").isNull(), "candidate_only").otherwise("both")
    return j.select(F.coalesce("b_key", "c_key").alias(key), side.alias("side"), *[x for x in j.columns if x not in ("b_key", "c_key")])


def duplicates(report: DataFrame, key: str = "case") -> DataFrame:
    return report.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def percent_change(base: Column, cand: Column) -> Column:
    """0 if both are 0, infinite from 0 on."""
    return F.when(base == 0, F.when(cand == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise((cand - base) / base * 100)


def status(pct: Column, threshold: float = 15.0) -> Column:
    return F.when(pct > threshold, "regression").when(pct > 0, "within_threshold").when(pct < 0, "improvement").otherwise("unchanged")


def deltas(aligned: DataFrame, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """delta_* of each counter, and drift: whether any isn't 0."""
    out = aligned
    drift = F.lit(False)
    for c in counters:
        out = out.withColumn(f"delta_{c}", F.col(f"cand_{c}") - F.col(f"base_{c}"))
        drift = drift | (F.col(f"delta_{c}") != 0)
    return out.withColumn("drift", drift)


#: The coarse categories of a release's comparison.
CATEGORIES = {"files": "parser", "functions": "parser", "classes": "parser", "edges": "resolver", "chains": "resolver", "parse_errors": "parse_health"}


def drift_counts(with_deltas: DataFrame, labels: dict[str, str] = CATEGORIES, key: str = "case", highlight: str = "highlight", counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """category, n, cases: cases by what their drift points to (a case may be in several), by CATEGORIES or ATTRIBUTION.

    A case without drift is non_structural if it is one to look at: highlight is true, as where its time changed.
    """
    hit = [F.when(F.col(f"delta_{c}") != 0, labels[c]) for c in counters]
    b = F.array_distinct(F.array_compact(F.array(*hit)))
    b = F.when(F.size(b) > 0, b).when(F.col(highlight), F.array(F.lit("non_structural")))
    e = with_deltas.select(key, F.explode(b).alias("category"))
    return e.groupBy("category").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("cases"))


def attribution(with_deltas: DataFrame, key: str = "case", counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """bucket, cases: which cases drifted where; a case may be in several, one without drift is non_structural."""
    hit = [F.when(F.col(f"delta_{c}") != 0, ATTRIBUTION[c]) for c in counters]
    b = F.array_distinct(F.array_compact(F.array(*hit)))
    e = with_deltas.select(key, F.explode(F.when(F.size(b) > 0, b).otherwise(F.array(F.lit("non_structural")))).alias("bucket"))
    return e.groupBy("bucket").agg(F.sort_array(F.collect_list(key)).alias("cases"))


def timing_summary(runs: DataFrame, by: str, value: str) -> DataFrame:
    return runs.groupBy(by).agg(F.min(value).alias("min"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def thresholds(runs: DataFrame, least: dict[str, int], most: dict[str, int], key: str = "case") -> DataFrame:
    """key, label, ok: one row a limit."""
    rows = [F.struct(F.lit(f"min_{c}").alias("label"), (F.col(c) >= v).alias("ok")) for c, v in least.items()]
    rows += [F.struct(F.lit(f"max_{c}").alias("label"), (F.col(c) <= v).alias("ok")) for c, v in most.items()]
    return runs.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def owners_rule(pattern: str) -> str:
    """A CODEOWNERS pattern as a regular expression over relative paths."""
    anchored, p = pattern.startswith("/"), pattern.strip("/")
    body = "".join(".*" if x == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else ("\\" + x if x in ".+()[]{}^$|\\" else x) for x in _tokens(p))
    head = "^" if anchored or "/" in p else "^(.*/)?"
    return head + body + ("/.*$" if pattern.endswith("/") else "(/.*)?$")


def _tokens(p: str) -> list[str]:
    out, i = [], 0
    while i < len(p):
        n = 2 if p.startswith("**", i) else 1
        out.append(p[i : i + n])
        i += n
    return out


def owners_of(path: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """Owners by the last rule that matches; null if none does. The rules are a file's worth, so they are one expression, not a join."""
    out = F.lit(None).cast("array<string>")
    for pattern, owners in rules:
        out = F.when(path.rlike(owners_rule(pattern)), F.array(*map(F.lit, owners))).otherwise(out)
    return out


def path_weight(path: Column, weights: list[tuple[str, int]]) -> Column:
    out = F.lit(1)
    for pattern, w in reversed(weights):
        out = F.when(path.rlike(pattern), w).otherwise(out)
    return out


def owner_focus(files: DataFrame, labels_per_owner: int = 0, cases_per_owner: int = 0) -> DataFrame:
    """files: path, owners, weight. owner, n_files, max_weight, score, priority."""
    e = files.select("path", "weight", F.explode("owners").alias("owner"))
    g = e.groupBy("owner").agg(F.count("*").alias("n_files"), F.max("weight").alias("max_weight"), F.sum("weight").alias("w"))
    p = F.lit("low")
    for least, name in reversed(PRIORITIES):
        p = F.when(F.col("max_weight") >= least, name).otherwise(p)
    return g.select("owner", "n_files", "max_weight", (F.col("w") + F.col("n_files") + 2 * labels_per_owner + 2 * cases_per_owner).alias("score"), p.alias("priority"))


def _priority(weight: Column) -> Column:
    p = F.lit("low")
    for least, name in reversed(PRIORITIES):
        p = F.when(weight >= least, name).otherwise(p)
    return p


def hint_matches(files: DataFrame, hints: list[tuple[str, str, str]]) -> DataFrame:
    """files: path and any further columns; hints: (label, case, shell pattern). One row a file and hint that covers it: those columns, label, case.

    The hints are those of one comparison, so they are one expression over the files, and a file is read once.
    """
    cover = [F.when(F.col("path").rlike(glob_regex(pattern)), F.struct(F.lit(label).alias("label"), F.lit(case).alias("case"))) for label, case, pattern in hints]
    none = F.array().cast("array<struct<label:string,case:string>>")
    return files.withColumn("_hint", F.explode(F.array_compact(F.array(*cover)) if cover else none)).select(*files.columns, "_hint.label", "_hint.case")


def owners_to_ask(files: DataFrame, hints: list[tuple[str, str, str]]) -> DataFrame:
    """files: path, owners, weight, each path once. Owners of changed files that hints point to: owner, files, labels, cases, max_weight, score, priority.

    score: the weights of its files, their number, and twice the numbers of labels and cases.
    """
    e = hint_matches(files, hints).select("path", "weight", "label", "case", F.explode("owners").alias("owner"))
    g = e.groupBy("owner").agg(F.sort_array(F.collect_set(F.struct("path", "weight"))).alias("fs"), F.sort_array(F.collect_set("label")).alias("labels"), F.sort_array(F.collect_set("case")).alias("cases"))
    w = F.aggregate("fs", F.lit(0).cast("long"), lambda a, x: a + x["weight"])
    g = g.select("owner", F.col("fs.path").alias("files"), "labels", "cases", F.array_max("fs.weight").alias("max_weight"), (w + F.size("fs") + 2 * F.size("labels") + 2 * F.size("cases")).alias("score"))
    return g.withColumn("priority", _priority(F.col("max_weight")))


def owner_order(owners: DataFrame) -> DataFrame:
    """Heaviest file first, then score, number of labels and of files, then by name."""
    return owners.orderBy(F.desc("max_weight"), F.desc("score"), F.desc(F.size("labels")), F.desc(F.size("files")), "owner")


def changed_file_focus(files: DataFrame, hints: list[tuple[str, str, str]]) -> DataFrame:
    """files: path, weight. Hints that changed files match: label, files, cases, max_weight, score (weights, number of files, twice that of cases), priority; best first."""
    g = hint_matches(files, hints).groupBy("label").agg(F.sort_array(F.collect_set(F.struct("path", "weight"))).alias("fs"), F.sort_array(F.collect_set("case")).alias("cases"))
    w = F.aggregate("fs", F.lit(0).cast("long"), lambda a, x: a + x["weight"])
    g = g.select("label", F.col("fs.path").alias("files"), "cases", F.array_max("fs.weight").alias("max_weight"), (w + F.size("fs") + 2 * F.size("cases")).alias("score"))
    return g.withColumn("priority", _priority(F.col("max_weight"))).orderBy(F.desc("score"), F.desc("max_weight"), F.desc(F.size("files")), F.desc(F.size("cases")), "label")


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, side (both, baseline_only, candidate_only), changed: array of the fields that differ between two versions of a registry."""
    j = align(old.select(key, *fields), new.select(key, *fields), key)
    changed = F.array_compact(F.array(*[F.when(~F.col(f"base_{f}").eqNullSafe(F.col(f"cand_{f}")), f) for f in fields]))
    return j.select(key, "side", F.when(F.col("side") == "both", changed).alias("changed"))


def review_plan(owners: DataFrame) -> DataFrame:
    """kind (user, team, unsupported), names: what an owner column asks for reviews of."""
    o = F.col("owner")
    kind = F.when(o.rlike("^@[^/@ ]+/[^/@ ]+$"), "team").when(o.rlike("^@[^/@ ]+$"), "user").otherwise("unsupported")
    return owners.select("owner").distinct().groupBy(kind.alias("kind")).agg(F.sort_array(F.collect_set("owner")).alias("names"))


def focus(rows: DataFrame, top: int = 3) -> DataFrame:
    """The cases to look at first: status_rank, n_changed, magnitude, abs_pct, abs_delta, case."""
    return rows.orderBy("status_rank", F.desc("n_changed"), F.desc("magnitude"), F.desc("abs_pct"), F.desc("abs_delta"), "case").limit(top)


def baseline_state(baseline_at: Column, released_at: Column, allow_pending: Column) -> Column:
    """missing without a baseline; only if there is no release to refresh it; pending if the release is newer, allowed if that is accepted; else current."""
    b, r = F.to_timestamp(baseline_at), F.to_timestamp(released_at)
    return F.when(b.isNull(), "missing").when(r.isNull(), "only").when((b < r), F.when(allow_pending, "allowed").otherwise("pending")).otherwise("current")


def tree_checksum(files: DataFrame, by: str, path: str, sha: str) -> DataFrame:
    """One hash a group over its files' paths and content hashes, in the order of the paths."""
    return files.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(sha).alias("s")))), lambda x: F.concat(x["p"], F.lit(":"), x["s"])), "\n"), 256).alias("checksum"))


def cache_split(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (same path and content hash, and where the cache has a version, this one) and misses."""
    if "version" in cached.columns:
        cached = cached.where(F.col("version") == CACHE_VERSION)
    c = cached.select("path", "sha256").distinct()
    return files.join(c, ["path", "sha256"], "left_semi"), files.join(c, ["path", "sha256"], "left_anti")
