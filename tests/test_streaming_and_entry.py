import datetime as dt
import sys

import pytest

from graphloom.sources import scan
from graphloom.streaming import watch as W


def test_debounce_stream(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    rows = [(t(x), "a.py", bytearray(b"x")) for x in (0, 0.5, 1.2, 5)]
    spark.createDataFrame(rows, W.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(t(60), "a.py", bytearray(b"y"))], W.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = W.debounced_stream(spark, str(tmp_path / "in"), "runs")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("SELECT n FROM runs").collect()) == [1, 3]


def test_watch_reanalyses(spark, tmp_path):
    seen = []
    d = str(tmp_path / "ev")
    spark.createDataFrame([(dt.datetime(2024, 1, 1), "a.py", bytearray(b"1")), (dt.datetime(2024, 1, 1), "note.txt", bytearray(b"1"))], W.EVENTS).write.parquet(d)
    q = W.watch(spark, d, lambda s: seen.append({r.path: bytes(r.content) for r in s.collect()}), str(tmp_path / "ck"), "0 seconds")
    q.processAllAvailable()
    spark.createDataFrame([(dt.datetime(2024, 1, 2), "a.py", None), (dt.datetime(2024, 1, 2), "b.py", bytearray(b"2"))], W.EVENTS).write.mode("append").parquet(d)
    q.processAllAvailable()
    q.stop()
    assert seen[0] == {"a.py": b"1"} and seen[-1] == {"b.py": b"2"}


def test_config_and_inputs(spark, tmp_path):
    (tmp_path / "graphloom.toml").write_text("[analyze]\nmax_depth = 3\nformat = 'json'\n")
    (tmp_path / "x/y").mkdir(parents=True)
    c = scan.load_config(str(tmp_path / "x/y"))
    assert scan.merged_options({"max_depth": 20, "format": "dot"}, {"max_depth": 20, "format": "summary"}, c) == {"max_depth": 3, "format": "dot"}
    (tmp_path / "graphloom.toml").write_text("[analyze\n")
    assert scan.load_config(str(tmp_path)) == {}
    with pytest.raises(ValueError):
        scan.load_config(str(tmp_path), strict=True)
    (tmp_path / "files.json").write_text('{"files": ["./a.py", "b.py", "a.py", ""]}')
    assert [r.path for r in scan.read_changed_files(spark, str(tmp_path / "files.json")).collect()] == ["a.py", "b.py"]
    (tmp_path / "files.txt").write_text("b.py\n\n./a.py\n")
    assert [r.path for r in scan.read_changed_files(spark, str(tmp_path / "files.txt")).collect()] == ["b.py", "a.py"]
    (tmp_path / "OWNERS").write_text("# c\n*.py @a @b\nlonely\n/x/ @c # why\n")
    assert scan.read_codeowners(spark, str(tmp_path / "OWNERS")) == [("*.py", ("@a", "@b")), ("/x/", ("@c",))]
    (tmp_path / "r.json").write_text('{"cases": [{"name": "a", "total": 1.0}, {"name": "b", "total": 2.0}]}')
    assert scan.read_report(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "r2.json").write_text('{"projects": [{"name": "a"}, {"name": "a"}]}')
    with pytest.raises(ValueError):
        scan.read_report(spark, str(tmp_path / "r2.json"))
    (tmp_path / "m.toml").write_text('version = 1\n[[project]]\nname = "p"\npath = "."\n')
    assert scan.read_manifest(str(tmp_path / "m.toml"))[0]["name"] == "p"
    (tmp_path / "s/target").mkdir(parents=True)
    (tmp_path / "s/a.GO").write_text("")
    (tmp_path / "s/target/b.py").write_text("")
    assert scan.detect_languages(spark, str(tmp_path / "s")) == ["go"]


def test_catalogue_is_complete():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


def test_entry_without_corpus_part():
    """The rest imports without the corpus operators."""
    import importlib
    import subprocess

    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('graphloom.llm'):\n"
        "            raise ModuleNotFoundError('none', name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') for n in e.queries()) and e.oracle_sql()\n"
    )
    root = importlib.import_module("graphloom").__path__[0] + "/.."
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
