"""Symbol index and the resolution of call sites to definitions.

Rules, the first that gives a definition wins: the exact qualified name (the last definition of it); self or this (the caller's class); Class.method (a lone
candidate, else the one of the caller's file, of its class, else the first); the simple name (a lone candidate, else the one of the caller's file, of its class).

Tables: symbols (sym_ord, qname, name, file_path, class_name, owner_class), where owner_class is set for methods inside a class body; calls (edge_ord,
caller_qname, caller_file, caller_class, stub), with any further columns. sym_ord and edge_ord may be of any type that sorts.

Call sites with the same stub, file and class are resolved once: what is joined is their distinct combinations, however many call sites there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import before_last, last_segment

DEFINITION = ["qname", "name", "file_path", "class_name"]


def exact_index(symbols: DataFrame) -> DataFrame:
    """qname, definition: the last definition of each qualified name."""
    return symbols.groupBy("qname").agg(F.max_by(F.struct(*DEFINITION), "sym_ord").alias("definition"))


def candidates(symbols: DataFrame) -> DataFrame:
    """key, sym_ord, definition: by simple name, and by Class.method for methods inside a class body."""
    d = F.struct(*DEFINITION).alias("definition")
    simple = symbols.select(F.col("name").alias("key"), "sym_ord", d)
    short = symbols.where("owner_class IS NOT NULL").select(F.concat_ws(".", "owner_class", "name").alias("key"), "sym_ord", d)
    return simple.unionByName(short)


def _lookup(cand: DataFrame, *extra: str) -> DataFrame:
    """n and the first candidate by key and further fields of the definition."""
    keys = [F.col("key"), *[F.col(f"definition.{x}").alias(x) for x in extra]]
    return cand.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("definition", "sym_ord").alias("first"))


def resolve_stubs(stubs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds definition and rule to distinct rows (stub, caller_file, caller_class); both are null where nothing resolves."""
    cand = candidates(symbols)
    k, kf, kc = _lookup(cand), _lookup(cand, "file_path"), _lookup(cand, "class_name")
    has_class = F.col("caller_class").isNotNull() & (F.col("caller_class") != "")
    prev, last, dotted = before_last(F.col("stub")), last_segment(F.col("stub")), F.contains("stub", F.lit("."))
    s = stubs.withColumn("k_self", F.when(dotted & prev.isin("self", "this") & has_class, F.concat_ws(".", "caller_class", last)))
    s = s.withColumn("k_two", F.when(dotted, F.concat_ws(".", prev, last))).withColumn("k_one", last)

    def left(s: DataFrame, table: DataFrame, name: str, key: str, second: tuple[str, str] | None = None) -> DataFrame:
        cols = [F.col("key").alias(f"{name}_key"), F.col("n").alias(f"{name}_n"), F.col("first").alias(f"{name}_first")]
        on = F.col(key) == F.col(f"{name}_key")
        if second:
            cols.append(F.col(second[1]).alias(f"{name}_by"))
            on = on & (F.col(second[0]) == F.col(f"{name}_by"))
        return s.join(table.select(*cols), on, "left")

    e = exact_index(symbols).select(F.col("qname").alias("e_key"), F.col("definition").alias("e_first"))
    s = s.join(e, F.col("stub") == F.col("e_key"), "left")
    file, cls = ("caller_file", "file_path"), ("caller_class", "class_name")
    s = left(left(s, k, "s", "k_self"), kf, "sf", "k_self", file)
    s = left(left(left(s, k, "t", "k_two"), kf, "tf", "k_two", file), kc, "tc", "k_two", cls)
    s = left(left(left(s, k, "o", "k_one"), kf, "of", "k_one", file), kc, "oc", "k_one", cls)
    branches = [
        (F.col("e_first").isNotNull(), F.col("e_first"), "exact"),
        (F.col("s_n") >= 1, F.coalesce("sf_first", "s_first"), "self"),
        (F.col("t_n") == 1, F.col("t_first"), "two_part"),
        ((F.col("t_n") > 1) & (F.col("tf_n") == 1), F.col("tf_first"), "two_part_file"),
        ((F.col("t_n") > 1) & has_class & (F.col("tc_n") == 1), F.col("tc_first"), "two_part_class"),
        (F.col("t_n") > 1, F.col("t_first"), "two_part_first"),
        (F.col("o_n") == 1, F.col("o_first"), "simple"),
        ((F.col("o_n") > 1) & (F.col("of_n") == 1), F.col("of_first"), "simple_file"),
        ((F.col("o_n") > 1) & has_class & (F.col("oc_n") == 1), F.col("oc_first"), "simple_class"),
    ]
    definition, rule = F.when(branches[0][0], branches[0][1]), F.when(branches[0][0], branches[0][2])
    for cond, value, name in branches[1:]:
        definition, rule = definition.when(cond, value), rule.when(cond, name)
    return s.select("stub", "caller_file", "caller_class", definition.alias("definition"), rule.alias("rule"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with callee_qname, callee_name, callee_file, callee_class and rule; null where unresolved."""
    r = resolve_stubs(calls.select("stub", "caller_file", "caller_class").distinct(), symbols)
    r = r.select(F.col("stub").alias("r_stub"), F.col("caller_file").alias("r_file"), F.col("caller_class").alias("r_class"), "definition", "rule")
    on = F.col("stub").eqNullSafe(F.col("r_stub")) & F.col("caller_file").eqNullSafe(F.col("r_file")) & F.col("caller_class").eqNullSafe(F.col("r_class"))
    j = calls.join(r, on, "left")
    d = [F.col(f"definition.{a}").alias(b) for a, b in (("qname", "callee_qname"), ("name", "callee_name"), ("file_path", "callee_file"), ("class_name", "callee_class"))]
    return j.select(*[calls[c] for c in calls.columns], *d, "rule")


def resolved(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    return resolve_calls(calls, symbols).where("callee_qname IS NOT NULL")
