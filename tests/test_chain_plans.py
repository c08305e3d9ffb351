"""Chain queries: one pass over the edges to leaves, files without a join to every node of every chain."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import chains as C
from graphloom.operators import legacy as L
from graphloom.plans import catalog
from graphloom.sinks.reports import chain_lines

SF = "/root/testdata/sf0.001"
#: By query: joins in the plan of the result, without the tables that are written before.
JOINS = {
    "chains_jsonl": 1, "chains_cross_file": 1, "legacy_chains_head_out": 1, "chain_cross_hist": 1, "legacy_tail_outside": 1, "legacy_best_index": 3, "chain_files": 1, "legacy_min_outside_ratio": 1, "best_chain": 1, "chains_recursive_cte": 2, "chain_length_hist": 1, "chains_dag": 1,
}


@pytest.mark.parametrize("name", JOINS)
def test_leaves_are_joined_once_and_nodes_never(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    assert len(re.findall(r"\bJoin \w+", plan)) == JOINS[name]


def test_a_filter_finds_the_files_once(spark):
    ch = spark.createDataFrame([(["a", "b"], [0, 1])], "path array<string>, ordpath array<long>")
    plan = C.with_files(ch, lambda x: F.concat(F.lit("mark"), x)).where("transitions > 0").select("path")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mark") == 1
    for keep in (L.head_in_rest_out, L.head_in_has_outside, lambda f, d: L.outside_ratio(f, d) >= 0.5, L.tail_outside):
        f = F.transform("path", lambda x: F.concat(F.lit("mark/"), x))
        df = ch.where(keep(f, "src"))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("mark") == 1


def walks(edges, front, depth, revisit, leaves_only):
    """path: all paths from the nodes of front, by recursion."""
    out, nxt = [], {}
    for a, b, _ in sorted(edges, key=lambda e: e[2]):
        nxt.setdefault(a, {}).setdefault(b)

    def go(path):
        to = nxt.get(path[-1], {})
        if not to or len(path) == depth:
            if not (to and leaves_only):
                out.append(tuple(path))
            return
        for b in to:
            if revisit or b not in path:
                go([*path, b])

    for n in front:
        go([n])
    return sorted(out)


def test_paths_from_nodes_with_files(spark):
    rng = random.Random(11)
    files = {n: f"f{i % 3}" for i, n in enumerate("abcdef")}  # g and h have none
    nodes = spark.createDataFrame(list(files.items()), "node string, file string")
    for depth, revisit, leaves_only in ((1, False, False), (1, False, True), (3, True, False), (4, False, True), (5, False, False)):
        edges = [(rng.choice("abcdefg"), rng.choice("abcdefgh"), i) for i in range(9)]
        front = ["a", "d", "h"]
        df = spark.createDataFrame(edges, "caller string, callee string, edge_ord long")
        got = C.paths(df, depth, from_nodes=spark.createDataFrame([(n, i) for i, n in enumerate(front)], "node string, rank long"), revisit=revisit, leaves_only=leaves_only, nodes=nodes)
        rows = C.with_files(got).collect()
        assert sorted(tuple(r.path) for r in rows) == walks(edges, front, depth, revisit, leaves_only), (edges, depth)
        for r in rows:
            f = [files.get(n, "") for n in r.path]
            assert r.files == f and r.length == len(f) and r.transitions == sum(x != y for x, y in zip(f, f[1:]))


def test_files_and_lines_by_expression_are_those_of_tables(spark):
    e = spark.createDataFrame([("a1", "b1", 0), ("b1", "c2", 1), ("a1", "c1", 2), ("d1", "a1", 3)], "caller string, callee string, edge_ord long")
    n, ch = C.graph_nodes(e), C.paths(e)
    file = lambda x: F.when(x != "c2", F.substring(x, 2, 1))
    table = n.select("node", file(F.col("node")).alias("file"))
    one, two = (sorted(map(tuple, C.with_files(ch, x).collect())) for x in (file, table))
    assert one == two and len(one) == 2
    node = lambda x: F.struct(x.alias("name"), file(x).alias("file_path"), F.length(x).alias("line"), F.lit("python").alias("language"))
    lines = n.select(F.col("node").alias("qname"), node(F.col("node")).alias("n")).select("qname", "n.*")
    one, two = (sorted(r.value for r in chain_lines(C.with_files(ch, file), x).collect()) for x in (node, lines))
    assert one == two and json.loads(one[0])["chain"][0] == {"name": "d1", "file_path": "1", "line": 2, "language": "python"}
