"""Call chains: bounded simple paths over the call graph, by frontier joins.

Edges (caller, callee, edge_ord) may repeat; of equal pairs the first counts, as a repeated path would be dropped anyway. A path ends at a node without any
callee or at the depth limit; one that could only go on to nodes it has visited gives no chain. ``ordpath`` (the start's rank, then the ordinals of the edges taken)
sorts chains in depth-first order, which the cap uses. A frontier row is a path, so a level is a join on the path's last node, spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import cut

MAX_DEPTH, MAX_CHAINS = 20, 50_000
CUT_EVERY = 3


def adjacency(edges: DataFrame) -> DataFrame:
    """caller, callee, edge_ord of the first such edge, leaf: whether the callee calls nothing."""
    e = edges.groupBy("caller", "callee").agg(F.min("edge_ord").alias("edge_ord"))
    callers = edges.select(F.col("caller").alias("callee"), F.lit(False).alias("leaf")).distinct()
    return e.join(callers, "callee", "left").select("caller", "callee", "edge_ord", F.coalesce("leaf", F.lit(True)).alias("leaf"))


def split_adjacency(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """adjacency() in a table, without leaf: edges to nodes that call, edges to leaves. nodes (node, file) adds the callee's file."""
    adj = adjacency(edges)
    if nodes is not None:
        adj = adj.join(nodes.select(F.col("node").alias("callee"), "file"), "callee", "left").withColumn("file", F.coalesce("file", F.lit("")))
    adj = cut(adj, "adjacency", "leaf")
    return adj.where("NOT leaf").drop("leaf"), adj.where("leaf").drop("leaf")


def starts(edges: DataFrame, in_scope: Column | DataFrame | None = None, called: DataFrame | None = None) -> DataFrame:
    """node, rank (its first edge): callers that nothing calls, in scope; else all callers in scope; else all callers. in_scope: a condition on node, or a table of nodes.
    called (callee): edges that reach all callers that something calls, where these are known."""
    callers = edges.groupBy(F.col("caller").alias("node")).agg(F.min("edge_ord").alias("rank"))
    roots = callers.join((edges if called is None else called).select(F.col("callee").alias("node")).distinct(), "node", "left_anti")
    scoped = lambda df: df.join(in_scope.select("node").distinct(), "node", "left_semi") if isinstance(in_scope, DataFrame) else df.where(in_scope)
    for tier in [scoped(roots), scoped(callers)] if in_scope is not None else [roots]:
        tier = cut(tier, "starts")
        if not tier.isEmpty():
            return tier
    return callers


def paths(
    edges: DataFrame, max_depth: int = MAX_DEPTH, in_scope: Column | None = None, from_nodes: DataFrame | None = None, revisit: bool = False, leaves_only: bool = False, nodes: DataFrame | None = None
) -> DataFrame:
    """path array<string>, ordpath array. from_nodes (node, rank) replaces the starts; revisit allows cycles up to the depth limit; leaves_only drops paths that the limit ends.
    nodes (node, file) adds files, an array by node.

    A frontier holds only paths that can go on, and is a table. The edges to leaves, mostly the most, are joined once, with the frontiers of all levels together.
    """
    inner, leaves = split_adjacency(edges, nodes)
    s = from_nodes if from_nodes is not None else starts(edges, in_scope, inner)
    front = s.select(F.array("node").alias("path"), F.array("rank").alias("ordpath"), F.col("node").alias("last"))
    if nodes is not None:
        front = front.join(nodes.select(F.col("node").alias("last"), "file"), "last", "left").withColumn("files", F.array(F.coalesce("file", F.lit("")))).drop("file")
    kept = [c for c in front.columns if c != "last"]

    def step(f: DataFrame, e: DataFrame) -> DataFrame:
        j = f.join(e, F.col("last") == F.col("caller"))
        if not revisit:
            j = j.where(~F.array_contains("path", F.col("callee")))
        grown = {"path": "callee", "ordpath": "edge_ord", "files": "file"}
        return j.select(*(F.array_append(c, F.col(grown[c])).alias(c) for c in kept), F.col("callee").alias("last"))

    done = []
    if from_nodes is not None:
        callers = inner.union(leaves).select(F.col("caller").alias("last")).distinct()
        done.append(front.join(callers, "last", "left_anti").select(kept))
        front = front.join(callers, "last", "left_semi")
    going = None
    for depth in range(1, max_depth):
        going = front if going is None else going.unionByName(front)
        if leaves_only and depth == max_depth - 1:
            break
        front = cut(step(front, inner), "frontier")
        if front.isEmpty():
            break
    if going is not None:
        done.append(step(going, leaves).select(kept))
    done.append(front.select(kept).limit(0) if leaves_only else front.select(kept))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def first_paths(edges: DataFrame, max_chains: int = MAX_CHAINS, max_depth: int = MAX_DEPTH, in_scope: Column | None = None, from_nodes: DataFrame | None = None, width: int = 0) -> DataFrame:
    """The first max_chains of paths(), in depth-first order, without the others: path, ordpath.

    A level goes on with the first ``width`` rows of its frontier only; the rest waits, and is taken up, deepest first, as long as fewer than max_chains
    chains stand before all that wait. So a dense graph, whose paths no cluster could list, costs about width times its degree a level.
    """
    width = width or max(2 * max_chains, 10_000)
    adj = cut(adjacency(edges), "adjacency")
    s = from_nodes if from_nodes is not None else starts(edges, in_scope)
    known = adj.select("caller").distinct().withColumnRenamed("caller", "node").withColumn("out", F.lit(True))
    front = s.join(known, "node", "left").select(F.array("node").alias("path"), F.array("rank").alias("ordpath"), F.col("node").alias("last"), F.col("out").isNull().alias("leaf"))
    steps = adj.withColumnRenamed("leaf", "to_leaf")
    waiting: list[tuple[int, DataFrame]] = [(1, cut(front, "frontier"))]
    done = None
    while waiting:
        depth, front = waiting.pop()
        if done is not None:
            ahead = front.agg(F.min("ordpath").alias("next"))
            if done.join(F.broadcast(ahead), F.col("ordpath") < F.col("next")).count() >= max_chains:
                break
        if front.count() > width:
            end = front.orderBy("ordpath").limit(width).agg(F.max("ordpath").alias("end"))
            waiting.append((depth, cut(front.join(F.broadcast(end), F.col("ordpath") > F.col("end")).drop("end"), "frontier")))
            front = cut(front.join(F.broadcast(end), F.col("ordpath") <= F.col("end")).drop("end"), "frontier")
        new = front.where(F.col("leaf") if depth < max_depth else F.lit(True)).select("path", "ordpath")
        done = cut((new if done is None else done.unionByName(new)).orderBy("ordpath").limit(max_chains), "chains")
        if depth < max_depth:
            j = front.where(~F.col("leaf")).select("path", "ordpath", "last").join(steps, (F.col("last") == F.col("caller")) & ~F.array_contains("path", F.col("callee")))
            nxt = cut(j.select(F.array_append("path", F.col("callee")).alias("path"), F.array_append("ordpath", F.col("edge_ord")).alias("ordpath"), F.col("callee").alias("last"), F.col("to_leaf").alias("leaf")), "frontier")
            if not nxt.isEmpty():
                waiting.append((depth + 1, nxt))
    return done


def with_files(chains: DataFrame, nodes: DataFrame | Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds length, files (array, by node), transitions (neighbours in different files). nodes: a node's file as an expression of the node, or node, file; none if the chains have files.

    The table of nodes is joined to each node of each chain: it is for chains under a cap. Where all are listed, paths() takes it.
    """
    if isinstance(nodes, DataFrame):
        e = chains.select("path", "ordpath", F.posexplode("path").alias("pos", "node")).join(nodes.select("node", "file"), "node", "left")
        g = e.groupBy("path", "ordpath").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("file", F.lit("")).alias("file")))).alias("f"))
        g = g.select("path", "ordpath", F.transform("f", lambda x: x["file"]).alias("files"))
    else:
        files = F.transform("path", lambda x: F.coalesce(nodes(x), F.lit(""))) if nodes else F.col("files")
        g = chains.select("path", "ordpath", files.alias("files"))
    return g.select("path", "ordpath", F.size("path").cast("long").alias("length"), "files", transitions(F.col("files")).alias("transitions"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value). The value is evaluated once, also in a filter, into which a plain expression is copied for each place that names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def transitions(files: Column) -> Column:
    def count(f: Column) -> Column:
        pairs = F.arrays_zip(F.slice(f, F.lit(1), F.size(f) - 1).alias("a"), F.slice(f, F.lit(2), F.size(f) - 1).alias("b"))
        return F.when(F.size(f) < 2, F.lit(0)).otherwise(F.size(F.filter(pairs, lambda x: x["a"] != x["b"]))).cast("long")

    return bound(files, count)


def files_involved(files: Column) -> Column:
    return F.array_sort(F.array_distinct(files))


def capped(chains: DataFrame, max_chains: int = MAX_CHAINS) -> DataFrame:
    """The first chains in depth-first order."""
    return chains.orderBy("ordpath").limit(max_chains)


def length_histogram(chains: DataFrame) -> DataFrame:
    return chains.groupBy("length").agg(F.count("*").alias("n"))


def transition_histogram(chains: DataFrame) -> DataFrame:
    return chains.groupBy("transitions").agg(F.count("*").alias("n"))


def best_chain(chains: DataFrame) -> DataFrame:
    """Most transitions, then longest, then first."""
    return chains.orderBy(F.desc("transitions"), F.desc("length"), "ordpath").limit(1)


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("caller", "callee")).alias("node")).distinct()


def file_pairs(edges: DataFrame) -> DataFrame:
    """src, dst: distinct files of which one calls into the other."""
    return edges.where("caller_file <> '' AND callee_file <> '' AND caller_file <> callee_file").select(F.col("caller_file").alias("src"), F.col("callee_file").alias("dst")).distinct()


def elementary_cycles(pairs: DataFrame, max_length: int) -> DataFrame:
    """cycle array<string> from its smallest node on, without the closing node: each elementary cycle of 2 to max_length nodes once."""
    front = pairs.where("src < dst").select(F.array("src", "dst").alias("cycle"))
    done = []
    for n in range(2, max_length + 1):
        last = F.element_at("cycle", -1)
        closing = pairs.select(F.col("src").alias("z"), F.col("dst").alias("first"))
        done.append(front.join(closing, (last == F.col("z")) & (F.element_at("cycle", 1) == F.col("first")), "left_semi"))
        if n < max_length:
            j = front.join(pairs, last == F.col("src"))
            front = j.where((F.col("dst") > F.element_at("cycle", 1)) & ~F.array_contains("cycle", F.col("dst"))).select(F.array_append("cycle", F.col("dst")).alias("cycle"))
            if n % CUT_EVERY == 0:
                front = cut(front, "cycles")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def normalized(cycle: Column) -> Column:
    """Rotated to begin with its smallest element."""
    i = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, i, F.size(cycle)), F.slice(cycle, F.lit(1), i - 1))


def closed(cycle: Column) -> Column:
    return F.concat(cycle, F.slice(cycle, F.lit(1), F.lit(1)))


def back_edge_cycles(pairs: DataFrame) -> list[list[str]]:
    """The cycles that a depth-first search over sorted neighbours closes, normalized, each once. On the driver: for the file graph of one project."""
    adj: dict[str, list[str]] = {}
    for r in pairs.orderBy("src", "dst").toLocalIterator():
        adj.setdefault(r["src"], []).append(r["dst"])
    seen: set[str] = set()
    found: dict[tuple[str, ...], None] = {}
    for root in sorted(adj):
        if root in seen:
            continue
        seen.add(root)
        path, place, todo = [root], {root: 0}, [iter(adj[root])]
        while todo:
            nxt = next(todo[-1], None)
            if nxt is None:
                todo.pop()
                del place[path.pop()]
            elif nxt in place:
                c = path[place[nxt] :]
                i = c.index(min(c))
                found[tuple(c[i:] + c[:i])] = None
            elif nxt not in seen:
                seen.add(nxt)
                place[nxt] = len(path)
                path.append(nxt)
                todo.append(iter(adj.get(nxt, ())))
    return [[*c, c[0]] for c in found]
