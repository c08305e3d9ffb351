import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions.paths import excluded, glob_regex, import_base, in_skipped_dir, language_of, within
from graphloom.operators import chains as C
from graphloom.operators import compare as K
from graphloom.operators import legacy as L
from graphloom.operators import metrics as M
from graphloom.operators.resolve import resolve_calls, resolved

SYMBOLS = "sym_ord long, qname string, name string, file_path string, class_name string, owner_class string"
CALLS = "edge_ord long, caller_qname string, caller_file string, caller_class string, stub string"


def reference_resolve(symbols, call):
    """The rules, one call at a time."""
    exact, simple = {}, {}
    for s in symbols:
        exact[s[1]] = s
        simple.setdefault(s[2], []).append(s)
        if s[5] is not None:
            simple.setdefault(f"{s[5]}.{s[2]}", []).append(s)
    _, _, file, cls, stub = call
    if stub in exact:
        return exact[stub][1]
    last = stub.split(".")[-1]
    if "." in stub:
        prev = stub.split(".")[-2]
        if prev in ("self", "this") and cls:
            c = simple.get(f"{cls}.{last}", [])
            if c:
                return next((x for x in c if x[3] == file), c[0])[1]
        c = simple.get(f"{prev}.{last}", [])
        if len(c) == 1:
            return c[0][1]
        if c:
            same = [x for x in c if x[3] == file]
            if len(same) == 1:
                return same[0][1]
            same = [x for x in c if x[4] == cls] if cls else []
            return (same[0] if len(same) == 1 else c[0])[1]
    c = simple.get(last, [])
    if len(c) == 1:
        return c[0][1]
    same = [x for x in c if x[3] == file]
    if len(same) == 1:
        return same[0][1]
    same = [x for x in c if x[4] == cls] if cls else []
    return same[0][1] if len(same) == 1 else None


def test_resolver_against_rules(spark):
    rng = random.Random(5)
    names, files, classes = ["a", "b", "c"], ["x.py", "y.py"], ["K", "L", None, ""]
    symbols = []
    for i in range(18):
        n, f, c = rng.choice(names), rng.choice(files), rng.choice(classes)
        symbols.append((i, f"{f[0]}.{c + '.' if c else ''}{n}", n, f, c, c if c and rng.random() < 0.7 else None))
    stubs = ["a", "b", "zzz", "self.a", "this.b", "K.a", "L.b", "m.K.c", "x.a", "y.K.b", "obj.c", "self.zzz"]
    calls = [(i, "q", rng.choice(files), rng.choice(classes), rng.choice(stubs)) for i in range(400)]
    got = {r.edge_ord: r.callee_qname for r in resolve_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(symbols, SYMBOLS)).collect()}
    assert got == {c[0]: reference_resolve(symbols, c) for c in calls}


def naive_paths(edges, max_depth):
    adj = {}
    for a, b, _ in sorted(edges, key=lambda e: e[2]):
        adj.setdefault(a, [])
        if b not in adj[a]:
            adj[a].append(b)
    called = {b for _, b, _ in edges}
    starts = [a for a in adj if a not in called] or list(adj)
    out = []

    def go(node, path):
        if node not in adj or len(path) >= max_depth:
            out.append(tuple(path))
        if len(path) < max_depth:
            for n in adj.get(node, ()):
                if n not in path:
                    go(n, [*path, n])

    for s in starts:
        go(s, [s])
    return out


def test_paths_against_search(spark):
    rng = random.Random(3)
    for k in range(6):
        nodes = "abcdefg"[: rng.randint(2, 7)]
        edges = [(rng.choice(nodes), rng.choice(nodes), i) for i in range(rng.randint(1, 14))]
        depth = rng.randint(1, 5)
        df = spark.createDataFrame(edges, "caller string, callee string, edge_ord long")
        got = [tuple(r.path) for r in C.paths(df, depth).orderBy("ordpath").collect()]
        want = naive_paths(edges, depth)
        assert got == want, (k, edges, depth)


def test_two_cycle_gives_no_chain(spark):
    e = spark.createDataFrame([("a", "b", 0), ("b", "a", 1)], "caller string, callee string, edge_ord long")
    assert C.paths(e, 5).collect() == []
    assert {tuple(r.path) for r in C.paths(e, 5, in_scope=F.col("node") == "a").collect()} == set()


def test_cap_and_files(spark):
    e = spark.createDataFrame([("a", "b", 0), ("c", "d", 1)], "caller string, callee string, edge_ord long")
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")], "node string, file string")
    f = C.with_files(C.paths(e), files)
    assert [r.path for r in C.capped(f, 1).collect()] == [["a", "b"]]
    assert {r.path[0]: r.transitions for r in f.collect()} == {"a": 1, "c": 0}
    assert C.best_chain(f).first().path == ["a", "b"]


def test_cycles(spark):
    p = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert sorted(r.cycle for r in C.elementary_cycles(p, 4).collect()) == [["a", "b"], ["a", "b", "c"]]
    assert C.back_edge_cycles(p) == [["a", "b", "a"], ["a", "b", "c", "a"]]
    assert C.back_edge_cycles(p.where("dst = 'd'")) == []
    assert spark.range(1).select(C.normalized(F.array(F.lit("b"), F.lit("c"), F.lit("a"))).alias("x")).first().x == ["a", "b", "c"]


def edges_df(spark, rows):
    return spark.createDataFrame(rows, "edge_ord long, caller_qname string, caller_file string, callee_qname string, callee_name string, callee_file string")


def test_metrics(spark):
    e = edges_df(spark, [(0, "m.a", "m.py", "n.b", "b", "n.py"), (1, "m.a", "m.py", "n.b", "b", "n.py"), (2, "n.b", "n.py", "m.c", "c", "m.py"), (3, "m.a", "m.py", "m.c", "c", "m.py")])
    assert [(r.callee_qname, r.calls) for r in M.hotspots(e).collect()] == [("n.b", 2), ("m.c", 2)]
    mods = spark.createDataFrame([("m.py",), ("n.py",), ("lone.py",)], "file_path string")
    assert {r.file_path: (r.fan_in, r.fan_out, r.instability) for r in M.module_coupling(mods, e).collect()} == {"m.py": (1, 1, 0.5), "n.py": (1, 1, 0.5), "lone.py": (0, 0, 0.0)}
    s = spark.createDataFrame([(0, "m.a", "a", 3, []), (1, "m.c", "c", 7, []), (2, "m.get", "x", 15, ["app.Widget"]), (3, "m.main", "main", 21, []), (4, "m.__x__", "__x__", 1, []), (5, "m.test_z", "test_z", 1, [])], "sym_ord long, qname string, name string, complexity int, decorators array<string>")
    assert [r.qname for r in M.dead_functions(s, e).collect()] == ["m.a"]
    assert {r.bucket: r.n for r in M.complexity_buckets(s).collect()} == dict(zip(M.BUCKETS, (3, 1, 1, 1)))
    assert {r.bucket: r.n for r in M.complexity_buckets(s.limit(0)).collect()} == dict.fromkeys(M.BUCKETS, 0)


def test_unused_imports(spark):
    i = spark.createDataFrame([("f", 0, "os.path", [], None), ("f", 1, "pkg", ["a", "b"], None), ("f", 2, "x", ["*"], None), ("f", 3, "y", ["*", "q"], None), ("f", 4, "stdio.h", [], None), ("f", 5, "numpy", [], "np")], "file_path string, imp_ord int, module string, names array<string>, alias string")
    u = spark.createDataFrame([("f", "a"), ("f", "np"), ("g", "b")], "file_path string, name string")
    assert {r.imp_ord: r.names for r in M.unused_imports(i, u).collect()} == {0: [], 1: ["b"], 3: ["*", "q"], 4: []}


def test_hierarchy(spark):
    c = spark.createDataFrame([(0, "a.Base", "Base", []), (1, "b.shared.Base", "Base", []), (2, "c.K", "K", ["shared.Base", "Base", "Gone"])], "class_ord long, qname string, name string, bases array<string>")
    assert {r.parent: r.children for r in M.class_hierarchy(c).collect()} == {"a.Base": ["c.K"], "b.shared.Base": ["c.K"], "c.K": [], "Gone": ["c.K"]}


def test_paths_and_globs(spark):
    df = spark.createDataFrame([("src/a.py",), ("src2/a.PY",), ("src/node_modules/x.js",), ("lib/x/y.h",), ("src",), ("node_modules",)], "path string")
    p = F.col("path")
    rows = {r.path: r for r in df.select("path", language_of(p).alias("lang"), in_skipped_dir(p).alias("skip"), within(p, "src").alias("within"), excluded(p, ["lib/**", "src", "*.PY"]).alias("out"), excluded(p, ["src/"]).alias("slash")).collect()}
    assert rows["src2/a.PY"].lang == "python" and rows["lib/x/y.h"].lang == "c" and rows["src"].lang is None
    assert [k for k, r in rows.items() if r.skip] == ["src/node_modules/x.js"] and not rows["src2/a.PY"].within and rows["src/a.py"].within
    assert {k for k, r in rows.items() if not r.out} == {"node_modules"} and not any(r.slash for r in rows.values())
    assert spark.range(1).select(import_base(F.lit("a/b.c/d")).alias("x")).first().x == "d"


@settings(max_examples=60, deadline=None)
@given(st.text("ab/*?.[]!x", max_size=8), st.text("ab/.x", max_size=8))
def test_glob_regex(pattern, path):
    import fnmatch
    import re

    assert bool(re.match(glob_regex(pattern), path)) == fnmatch.fnmatchcase(path, pattern)


def test_compare(spark):
    cols = ", ".join(f"{c} long" for c in K.COUNTERS)
    b = spark.createDataFrame([("a", 1, 2, 3, 4, 5, 0), ("b", 1, 1, 1, 1, 1, 0), ("gone", 1, 1, 1, 1, 1, 0)], "case string, " + cols)
    c = spark.createDataFrame([("a", 1, 2, 3, 5, 5, 0), ("b", 1, 1, 1, 1, 1, 0), ("new", 1, 1, 1, 1, 1, 0)], "case string, " + cols)
    a = K.align(b, c)
    assert {r.case: r.side for r in a.collect()} == {"a": "both", "b": "both", "gone": "baseline_only", "new": "candidate_only"}
    assert {r.bucket: r.cases for r in K.attribution(K.deltas(a.where("side = 'both'"))).collect()} == {"call_resolution": ["a"], "non_structural": ["b"]}
    pct = lambda x, y: K.percent_change(F.lit(x), F.lit(y))
    r = spark.range(1).select(pct(0, 0).alias("z"), pct(0, 1).alias("i"), K.status(pct(100, 116)).alias("r"), K.status(pct(100, 110)).alias("w"), K.status(pct(100, 90)).alias("m"), K.status(pct(5, 5)).alias("u")).first()
    assert r.z == 0 and r.i == float("inf") and (r.r, r.w, r.m, r.u) == ("regression", "within_threshold", "improvement", "unchanged")
    assert K.duplicates(b.unionByName(b)).count() == 3


@pytest.mark.parametrize("pattern,path,hit", [("*.py", "a/b.py", True), ("/src/", "src/x", True), ("/src/", "lib/src/x", False), ("docs", "a/docs/x", True), ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/d/c", False), ("a/**/c", "a/b/d/c", True), ("src", "src2", False)])
def test_codeowners(spark, pattern, path, hit):
    assert (spark.range(1).select(K.owners_of(F.lit(path), [(pattern, ("@x",))]).alias("o")).first().o is not None) == hit


def test_enclosing_function(spark):
    spans = spark.createDataFrame([("f", 1, 200, "outer"), ("f", 50, 130, "inner"), ("f", 60, 61, "deep"), ("g", 1, 2, "other")], "file string, start int, stop int, qname string")
    lines = spark.createDataFrame([("f", n) for n in (1, 55, 60, 130, 131, 201)], "file string, line int")
    assert {r.line: r.qname for r in L.enclosing_function(lines, spans).collect()} == {1: "outer", 55: "inner", 60: "deep", 130: "inner", 131: "outer", 201: None}


def test_legacy_filters(spark):
    f = F.array(F.lit("a.py"), F.lit("ext/b.py"), F.lit("src/c.py"))
    r = spark.range(1).select(L.head_in_rest_out(f, "src").alias("a"), L.head_in_has_outside(f, "src").alias("b"), L.outside_ratio(f, "src").alias("c"), L.tail_outside(f, "src").alias("d"), L.endpoints(F.array(F.lit("t.test_x"), F.lit("m.f"), F.lit("m.g"))).alias("e")).first()
    assert (r.a, r.b, round(r.c, 3), r.d, r.e.head, r.e.tail) == (False, True, 0.333, False, "m.f", "m.g")


def test_resolved_drops_unknown(spark):
    s = spark.createDataFrame([(0, "m.f", "f", "m.py", None, None)], SYMBOLS)
    assert resolved(spark.createDataFrame([(0, "m.g", "m.py", None, "f"), (1, "m.g", "m.py", None, "print")], CALLS), s).count() == 1
