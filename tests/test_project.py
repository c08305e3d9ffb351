"""Chains under a cap, cache, plugins, registry, configuration, watching and restarts, hints and owners."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.frontends import registry
from graphloom.frontends.model import Module
from graphloom.functions.paths import ALIASES, EXTENSIONS
from graphloom.operators import chains as C
from graphloom.operators import compare as K
from graphloom.operators import legacy as L
from graphloom.plans import project
from graphloom.sources.scan import read_registry, write_registry
from graphloom.streaming import watch as W


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "caller string, callee string, edge_ord long").repartition(2)


def test_a_cap_ends_a_dense_graph(spark):
    pairs = [(f"n{a:02d}", f"n{b:02d}") for a in range(30) for b in range(30) if a != b]
    got = C.first_paths(edges_of(spark, pairs), max_chains=200, max_depth=8, width=100).orderBy("ordpath").collect()
    want, order = [], {p: i for i, p in enumerate(pairs)}
    nxt = {a: sorted((b for x, b in pairs if x == a), key=lambda b, a=a: order[a, b]) for a, _ in pairs}

    def walk(path):
        if len(want) == 200:
            return
        if len(path) == 8:
            want.append(list(path))
            return
        for b in nxt[path[-1]]:
            if b not in path:
                walk([*path, b])

    walk(["n00"])
    assert [list(r.path) for r in got] == want


def test_first_paths_are_those_of_all_paths(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(17)]
    e = edges_of(spark, [p for p in pairs if p[0] != p[1]])
    every = [tuple(r.path) for r in C.paths(e, 4).orderBy("ordpath").collect()]
    for cap, width in ((5, 3), (10_000, 7)):
        assert [tuple(r.path) for r in C.first_paths(e, cap, 4, width=width).orderBy("ordpath").collect()] == every[:cap]
    assert C.first_paths(e.limit(0)).count() == 0


def test_cache_counts_versions_and_damage(spark, tmp_path):
    src, cache = tmp_path / "src", str(tmp_path / "cache")
    src.mkdir()
    (src / "a.py").write_text("def f():\n    g()\n\ndef g():\n    pass\n")
    (src / "b.hxx").write_text("int h() { return 1; }\n")
    (src / "skip.mjs").write_text("function x() {}\n")
    a = project.analyse(spark, str(src), cache_dir=cache)
    assert (a.hits, a.misses) == (0, 2) and {r.file_path: r.language for r in a.modules.collect()} == {"a.py": "python", "b.hxx": "cpp"}
    (src / "a.py").write_text("def f():\n    pass\n")
    a = project.analyse(spark, str(src), cache_dir=cache)
    assert (a.hits, a.misses) == (1, 1)
    # a run over some of the files leaves the rest in the cache
    assert project.analyse(spark, str(src), ["python"], cache_dir=cache).hits == 1
    a = project.analyse(spark, str(src), cache_dir=cache)
    assert (a.hits, a.misses) == (2, 0) and a.symbols.count() == 2
    part = next((tmp_path / "cache" / f"v{K.CACHE_VERSION}").glob("part-*.parquet"))
    for p in part.parent.glob("part-*.parquet"):
        p.write_bytes(b"broken")
    for p in part.parent.glob(".*.crc"):
        p.unlink()
    assert project.analyse(spark, str(src), cache_dir=cache).misses == 2
    project.clear_cache(spark, cache)
    assert not (tmp_path / "cache").exists() and project.load_cache(spark, cache) is None
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    known = files.withColumn("version", F.when(F.col("path") == "a", K.CACHE_VERSION).otherwise("0"))
    assert [x.count() for x in K.cache_split(files, known)] == [1, 1]


def test_a_language_can_be_added(spark, tmp_path):
    before = dict(EXTENSIONS), dict(ALIASES), dict(registry.FRONTENDS)
    try:

        class Lines(registry.Frontend):
            language, extensions, aliases = "lines", (".lns",), ("ln",)

            def parse(self, text, module, language):
                from graphloom.frontends.model import Module as M

                return M()

        assert registry.FRONTENDS["lines"].parse("", "", "") == Module()
        (tmp_path / "x.lns").write_text("a\nb\n")
        a = project.analyse(spark, str(tmp_path), ["ln"])
        assert [(r.file_path, r.language) for r in a.modules.collect()] == [("x.lns", "lines")]
    finally:
        for now, old in zip((EXTENSIONS, ALIASES, registry.FRONTENDS), before):
            now.clear()
            now.update(old)


def test_registry_round_trip_and_diff(spark, tmp_path):
    f = tmp_path / "r.toml"
    f.write_text('version = 1\n[[source]]\nname = "b"\nlanguages = ["go"]\n[[source]]\nname = "a"\npath = "x \\"y\\""\nenabled = true\n')
    old = read_registry(spark, str(f))
    write_registry(old, str(f))
    again = read_registry(spark, str(f))
    assert sorted(again.collect()) == sorted(old.collect()) and [r.name for r in again.collect()] == ["a", "b"]
    new = old.withColumn("revision", F.when(F.col("name") == "a", "r2")).where("name = 'a'").unionByName(old.limit(0))
    d = {r.name: (r.side, r.changed) for r in K.field_diff(old, new, "name", ["path", "revision"]).collect()}
    assert d == {"a": ("both", ["revision"]), "b": ("baseline_only", None)}
    for bad in ("version = 2\n", "version = 1\n[[source]]\nname = 3\n", 'version = 1\n[[source]]\nname = "a"\nodd = 1\n', 'version = 1\n[[source]]\nname = "a"\n[[source]]\nname = "a"\n'):
        f.write_text(bad)
        with pytest.raises(ValueError):
            read_registry(spark, str(f))


def test_watch_command_and_config(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    pass\n")
    conf = tmp_path / "c.toml"
    conf.write_text('[analyze]\nlang = ["go"]\n')
    assert cli.main(["analyze", str(src), "--config", str(conf)], spark) == 0 and "nothing to analyse" in capsys.readouterr().out
    assert cli.main(["analyze", str(src), "--config", str(tmp_path / "none.toml")], spark) == 1
    calls: list[list[str]] = []
    t = threading.Thread(target=W.watch_tree, args=(str(src), calls.append, 0.2, 0.05, 1))
    t.start()
    for i in range(4):
        time.sleep(0.1)
        (src / "a.py").write_text(f"x = {i}\n")
        (src / "notes.txt").write_text("no source")
        (src / f"b{i % 2}.py").write_text("")
    t.join(20)
    assert not t.is_alive() and calls == [["a.py", "b0.py", "b1.py"]]


def test_watch_goes_on_after_a_restart(spark, tmp_path):
    d, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    seen: list[dict] = []

    def batch(rows):
        spark.createDataFrame(rows, "ts string, path string, content string").select(F.to_timestamp("ts").alias("ts"), "path", F.col("content").cast("binary").alias("content")).write.mode("append").parquet(d)

    for rows in ([("2024-01-01 00:00:00", "a.py", "1"), ("2024-01-01 00:00:00", "b.py", "1")], [("2024-01-01 00:01:00", "b.py", "2")], [("2024-01-01 00:02:00", "a.py", None)]):
        batch(rows)
        q = W.watch(spark, d, lambda s: seen.append({r.path: bytes(r.content) for r in s.collect()}), ck, "0 seconds")
        q.processAllAvailable()
        q.stop()
    assert seen == [{"a.py": b"1", "b.py": b"1"}, {"a.py": b"1", "b.py": b"2"}, {"b.py": b"2"}]


def test_hints_owners_and_names(spark):
    files = spark.createDataFrame([("src/a.py", ["@x", "@y"], 8), ("src/b.py", ["@x"], 3), ("doc.md", None, 1)], "path string, owners array<string>, weight int")
    hints = [("core", "c1", "src/*"), ("core", "c2", "src/a*"), ("none", "c3", "zz*")]
    o = [(r.owner, r.files, r.labels, r.cases, r.score, r.priority) for r in K.owner_order(K.owners_to_ask(files, hints)).collect()]
    assert o == [("@x", ["src/a.py", "src/b.py"], ["core"], ["c1", "c2"], 11 + 2 + 2 + 4, "critical"), ("@y", ["src/a.py"], ["core"], ["c1", "c2"], 8 + 1 + 2 + 4, "critical")]
    f = K.changed_file_focus(files.drop("owners"), hints).collect()
    assert [(r.label, r.files, r.score) for r in f] == [("core", ["src/a.py", "src/b.py"], 11 + 2 + 4)]
    assert K.owners_to_ask(files, []).count() == 0
    d = spark.createDataFrame([("a", 1, 0, True), ("b", 0, 2, True), ("c", 0, 0, True), ("d", 0, 0, False)], "case string, delta_files long, delta_edges long, highlight boolean")
    got = {r.category: (r.n, r.cases) for r in K.drift_counts(d, counters=("files", "edges")).collect()}
    assert got == {"parser": (1, ["a"]), "resolver": (1, ["b"]), "non_structural": (1, ["c"])}
    s = spark.createDataFrame([("m.f", "f", False), ("m.C.g", "g", True), ("n.g", "g", False), ("m.C.h", "h", True), ("n.D.h", "h", True)], "qname string, name string, is_method boolean")
    n = spark.createDataFrame([("m.f",), ("m.C.g",), ("z.f",), ("g",), ("h",), ("none",)], "name string")
    assert {r.name: (r.qname, r.how) for r in L.resolve_names(n, s).collect()} == {"m.f": ("m.f", "exact_function"), "m.C.g": ("m.C.g", "exact_method"), "z.f": ("m.f", "only_function"), "g": ("n.g", "only_function"), "h": (None, None), "none": (None, None)}
    b = spark.createDataFrame([("x",)], "t string").select(K.baseline_state(F.lit("2024-01-01T00:00:00Z"), F.lit(None).cast("string"), F.lit(False)).alias("s")).first()
    assert b.s == "only"
