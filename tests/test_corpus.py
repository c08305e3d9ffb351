import pytest

from graphloom.plans import corpus


def test_corpus(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.py").write_text("def f():\n    return g()\n\n\ndef g():\n    return 1\n")
    (tmp_path / "p/empty.py").write_text("")
    (tmp_path / "m.toml").write_text('version = 1\n[[project]]\nname = "p"\npath = "p"\nmin_functions = 2\nmin_edges = 5\nmax_parse_errors = 0\n')
    runs = corpus.run(spark, str(tmp_path / "m.toml"))
    r = runs.first()
    assert (r.files, r.functions, r.classes, r.edges, r.chains, r.parse_errors) == (2, 2, 0, 1, 1, 0) and r.total >= r.build
    assert {x.label: x.ok for x in corpus.check(spark, str(tmp_path / "m.toml"), runs).collect()} == {"min_functions": True, "min_edges": False, "max_parse_errors": True}
    rep = corpus.report(runs)
    c = corpus.compared(rep, rep.withColumn("total", rep.total * 2))
    assert c.first().status == "regression" and not c.first().drift and "| p | regression | no |" in corpus.markdown(c)
    with pytest.raises(ValueError):
        corpus.compared(rep, rep.where("false"))
    with pytest.raises(ValueError):
        corpus.compared(rep.unionByName(rep), rep)
