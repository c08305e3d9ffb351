"""Metrics over symbols and resolved edges, each an aggregation or anti-join of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import import_base

ENTRY_NAMES = ("main", "__init__", "__main__", "setup", "teardown", "run", "execute", "start", "serve", "init", "configure", "Main", "Run", "Execute", "Start", "Serve", "Init")
ENTRY_PATTERN = "^(test_|Test|bench_|Bench|example_|Example)"
ENTRY_DECORATORS = "route|endpoint|handler|api|get|post|put|delete"
BUCKETS = ("low (1-5)", "medium (6-10)", "high (11-20)", "very_high (21+)")


def hotspots(edges: DataFrame, top: int = 20) -> DataFrame:
    """callee_qname, callee_file, calls: the most called, ties by the first call; the file is that of the last call's definition."""
    g = edges.groupBy("callee_qname").agg(F.count("*").alias("calls"), F.max_by("callee_file", "edge_ord").alias("callee_file"), F.min("edge_ord").alias("first"))
    return g.orderBy(F.desc("calls"), "first").limit(top).select("callee_qname", "callee_file", "calls")


def is_entry_point(name: Column, decorators: Column | None = None) -> Column:
    e = name.isin(*ENTRY_NAMES) | name.rlike(ENTRY_PATTERN) | (name.startswith("__") & name.endswith("__"))
    if decorators is not None:
        e = e | F.coalesce(F.exists(decorators, lambda d: F.lower(d).rlike(ENTRY_DECORATORS)), F.lit(False))
    return e


def dead_functions(symbols: DataFrame, edges: DataFrame, decorators: bool = True) -> DataFrame:
    """Definitions that no edge calls and that no framework is likely to; of equal qualified names the last definition counts."""
    cols = [c for c in symbols.columns if c not in ("sym_ord", "qname")]
    last = symbols.groupBy("qname").agg(F.max_by(F.struct(*cols), "sym_ord").alias("d")).select("qname", "d.*")
    called = edges.select(F.col("callee_qname").alias("qname")).distinct()
    dec = F.col("decorators") if decorators and "decorators" in cols else None
    return last.join(called, "qname", "left_anti").where(~is_entry_point(F.col("name"), dec))


def module_coupling(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """file_path, fan_in, fan_out, instability for every module, also without edges."""
    pairs = edges.where("caller_file <> '' AND callee_file <> '' AND caller_file <> callee_file").select("caller_file", "callee_file").distinct()
    # one pass over the distinct pairs: each counts for both of its ends
    ends = pairs.select(F.explode(F.array(F.struct(F.col("callee_file").alias("file_path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("caller_file").alias("file_path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    g = ends.groupBy("e.file_path").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    m = modules.select("file_path").distinct().join(g, "file_path", "left").na.fill(0, ["fan_in", "fan_out"])
    total = F.col("fan_in") + F.col("fan_out")
    return m.select("file_path", "fan_in", "fan_out", F.when(total > 0, F.col("fan_out") / total).otherwise(0.0).alias("instability"))


def complexity_buckets(symbols: DataFrame) -> DataFrame:
    """bucket, n: all four, also empty ones; every definition counts."""
    c = F.col("complexity")
    b = F.when(c <= 5, BUCKETS[0]).when(c <= 10, BUCKETS[1]).when(c <= 20, BUCKETS[2]).otherwise(BUCKETS[3])
    all_ = symbols.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket"))
    return all_.join(symbols.groupBy(b.alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").na.fill(0, ["n"])


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("callee_qname").alias("node")).agg(F.count("*").alias("n"))


def resolve_bases(classes: DataFrame) -> DataFrame:
    """classes: class_ord, qname, name, bases. One row a base: qname, base, base_qname - the first class that has the name, or whose qualified name ends with it, else the text."""
    parts = F.split("qname", r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.when(i <= F.size(parts), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    keys = classes.select(F.explode(F.array_distinct(F.concat(F.array("name"), suffixes))).alias("base"), "qname", "class_ord").where("base IS NOT NULL")
    first = keys.groupBy("base").agg(F.min_by("qname", "class_ord").alias("found"))
    each = classes.select("qname", F.explode("bases").alias("base"))
    return each.join(first, "base", "left").select("qname", "base", F.coalesce("found", "base").alias("base_qname"))


def class_hierarchy(classes: DataFrame) -> DataFrame:
    """parent, children: array<string>, sorted, for every class and every base."""
    r = resolve_bases(classes)
    g = r.groupBy(F.col("base_qname").alias("parent")).agg(F.sort_array(F.collect_set("qname")).alias("children"))
    keys = classes.select(F.col("qname").alias("parent")).unionByName(r.select(F.col("base_qname").alias("parent"))).distinct()
    return keys.join(g, "parent", "left").select("parent", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def unused_imports(imports: DataFrame, used: DataFrame) -> DataFrame:
    """imports: file_path, imp_ord, module, names, alias. used: file_path, name. Rows of imports that nothing uses, with the names that aren't used.

    A bare import is unused if neither its base nor its alias is; exactly ["*"] is never reported; of other imports the unused names stay.
    """
    u = used.select("file_path", "name").distinct().select(F.col("file_path").alias("u_file"), F.col("name").alias("u_name"))
    bare = F.size("names") == 0
    i = imports.where(~F.coalesce(F.col("names") == F.array(F.lit("*")), F.lit(False)))
    asked = F.when(bare, F.array_compact(F.array(import_base(F.col("module")), F.nullif("alias", F.lit(""))))).otherwise(F.col("names"))
    e = i.select("file_path", "imp_ord", "module", bare.alias("bare"), F.posexplode(asked).alias("pos", "name"))
    e = e.join(u, (F.col("file_path") == F.col("u_file")) & (F.col("name") == F.col("u_name")), "left")
    g = e.groupBy("file_path", "imp_ord", "module", "bare").agg(
        F.count("u_name").alias("hits"), F.array_sort(F.collect_list(F.when(F.col("u_name").isNull() & ~F.col("bare"), F.struct("pos", "name")))).alias("left")
    )
    g = g.where((F.col("bare") & (F.col("hits") == 0)) | (~F.col("bare") & (F.size("left") > 0)))
    return g.select("file_path", "imp_ord", "module", F.transform("left", lambda x: x["name"]).alias("names"))


def used_names(symbols: DataFrame, classes: DataFrame, variables: DataFrame, edges: DataFrame) -> DataFrame:
    """file_path, name: what a file defines, the bases it names, and what it calls (every part of the qualified name)."""
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    return (
        symbols.select("file_path", "name")
        .unionByName(classes.select("file_path", "name"))
        .unionByName(classes.select("file_path", F.explode("bases").alias("b")).select("file_path", last(F.col("b")).alias("name")))
        .unionByName(variables.select("file_path", "name"))
        .unionByName(edges.select(F.col("caller_file").alias("file_path"), F.explode(F.concat(F.array("callee_name"), F.split("callee_qname", r"\."))).alias("name")))
        .distinct()
    )


def project_totals(modules: DataFrame, symbols: DataFrame, classes: DataFrame, edges: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    parts = {"total_files": modules, "total_functions": symbols, "total_classes": classes, "total_edges": edges}
    if chains is not None:
        parts["total_chains"] = chains
    out = None
    for k, df in parts.items():
        one = df.agg(F.count("*").alias("value")).select(F.lit(k).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out
