"""The older chain tools: filters on heads and tails, entry walks, and the innermost function around a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.chains import bound, transitions


def inside(file: Column, directory: str) -> Column:
    """A bare file name counts as inside."""
    d = directory.strip("/")
    return bound(F.regexp_replace(file, r"\\", "/"), lambda f: ~F.contains(f, F.lit("/")) | (f == d) | f.startswith(d + "/"))


def head_in_rest_out(files: Column, directory: str) -> Column:
    rest = lambda fs: F.slice(fs, F.lit(2), F.greatest(F.size(fs) - 1, F.lit(0)))
    return bound(files, lambda fs: inside(F.element_at(fs, 1), directory) & (F.size(fs) > 1) & F.forall(rest(fs), lambda f: ~inside(f, directory)))


def head_in_has_outside(files: Column, directory: str) -> Column:
    return bound(files, lambda fs: inside(F.element_at(fs, 1), directory) & F.exists(fs, lambda f: ~inside(f, directory)))


def outside_ratio(files: Column, directory: str) -> Column:
    return bound(files, lambda fs: F.size(F.filter(fs, lambda f: ~inside(f, directory))) / F.size(fs))


def tail_outside(files: Column, directory: str) -> Column:
    return ~inside(F.element_at(files, -1), directory)


def basename_transitions(files: Column) -> Column:
    """Neighbours whose files' base names differ."""
    return transitions(F.transform(files, lambda f: F.element_at(F.split(f, "/"), -1)))


def known_ends(edges: DataFrame) -> DataFrame:
    """Edges that have both ends."""
    return edges.where("coalesce(caller, '') <> '' AND coalesce(callee, '') <> ''")


def endpoints(path: Column, skip_test_head: bool = True) -> Column:
    """struct<head, tail> of a chain; a leading test function is skipped."""
    h = F.element_at(path, 1)
    test = F.element_at(F.split(h, r"\."), -1).startswith("test_") & (F.size(path) > 1)
    return F.struct(F.when(F.lit(skip_test_head) & test, F.try_element_at(path, F.lit(2))).otherwise(h).alias("head"), F.element_at(path, -1).alias("tail"))


def pick(chains: DataFrame, index: int) -> DataFrame:
    """The chain at a place (from 0) of the depth-first order."""
    return chains.orderBy("ordpath").offset(index).limit(1)


def enclosing_function(lines: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """lines: file, line. spans: file, start, stop, qname. Adds qname of the innermost span around each line.

    A range join by buckets: a span stands in every bucket of width lines that it touches, a line in its own.
    """
    s = spans.select(F.col("file").alias("s_file"), "start", "stop", "qname", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("s_bucket"))
    q = lines.select("file", "line").distinct().withColumn("bucket", F.floor(F.col("line") / width))
    j = q.join(s, (F.col("file") == F.col("s_file")) & (F.col("bucket") == F.col("s_bucket")) & F.col("line").between(F.col("start"), F.col("stop")))
    best = j.groupBy("file", "line").agg(F.max(F.struct("start", -F.col("stop"), "qname")).alias("b")).select("file", "line", F.col("b.qname").alias("qname"))
    return lines.join(best, ["file", "line"], "left")


def resolve_names(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """names: name; symbols: qname, name, is_method. Adds qname and how: an exact function, an exact method, the only function of that simple name, the only method of it; else null."""
    q = symbols.groupBy("qname").agg(F.min("is_method").alias("is_method"))
    one = symbols.select("name", "qname", "is_method").distinct().groupBy("name", "is_method").agg(F.count("*").alias("n"), F.min("qname").alias("only")).where("n = 1")
    pick = lambda method, col: one.where(F.col("is_method") == method).select(F.col("name").alias(f"{col}_key"), F.col("only").alias(col))
    simple = F.element_at(F.split("name", r"\."), -1)
    j = names.withColumn("_s", simple).join(q.select(F.col("qname").alias("q_key"), F.col("is_method").alias("q_method")), F.col("name") == F.col("q_key"), "left")
    j = j.join(pick(False, "f"), F.col("_s") == F.col("f_key"), "left").join(pick(True, "m"), F.col("_s") == F.col("m_key"), "left")
    how = F.when(F.col("q_key").isNotNull(), F.when(F.col("q_method"), "exact_method").otherwise("exact_function")).when(F.col("f").isNotNull(), "only_function").when(F.col("m").isNotNull(), "only_method")
    return j.select(*names.columns, F.coalesce("q_key", "f", "m").alias("qname"), how.alias("how"))


def best_index(chains: DataFrame) -> DataFrame:
    """at: the place (from 0) in depth-first order of the chain with most transitions, then length, then first."""
    best = chains.orderBy(F.desc("transitions"), F.desc("length"), "ordpath").limit(1).select(F.col("ordpath").alias("b"))
    return chains.join(F.broadcast(best), F.col("ordpath") < F.col("b")).agg(F.count("*").alias("at"))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("total"), F.count_if(F.col("callee_qname").isNotNull()).alias("resolved"), F.count_if(F.col("callee_qname").isNull()).alias("unresolved"))


def first_occurrences(df: DataFrame, key: str, ord_: str) -> DataFrame:
    """Distinct by key, the first in order."""
    w = Window.partitionBy(key).orderBy(ord_)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
