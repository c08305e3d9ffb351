"""DOT and Mermaid texts. Edge limits are features of the formats, and bound what comes to the driver.

edges: edge_ord, caller_qname, caller_file, caller_display, callee_qname, callee_file, callee_display.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import DOT, MERMAID

DOT_EDGES, MERMAID_EDGES = 2000, 500
COLOURS = ("#dcedc8", "#bbdefb", "#ffe0b2", "#f8bbd0", "#e1bee7", "#b2ebf2", "#fff59d", "#d7ccc8")


def _escape(text: str, pairs) -> str:
    for a, b in pairs:
        text = text.replace(a, b)
    return text


def node_ids(edges: DataFrame, prefix: str) -> DataFrame:
    """node, id: numbered from 0 by first occurrence, callers before callees. edges (caller, callee, edge_ord): at most a diagram's worth."""
    n = edges.select(F.explode(F.array(F.struct("edge_ord", F.lit(0).alias("side"), F.col("caller").alias("node")), F.struct("edge_ord", F.lit(1).alias("side"), F.col("callee").alias("node")))).alias("n"))
    n = n.groupBy("n.node").agg(F.min(F.struct("n.edge_ord", "n.side")).alias("first"))
    return n.select("node", F.concat(F.lit(prefix), F.row_number().over(Window.orderBy("first")) - 1).alias("id"))


def _first(edges: DataFrame, limit: int) -> list:
    return edges.orderBy("edge_ord").limit(limit).collect()


def dot(edges: DataFrame, limit: int = DOT_EDGES) -> str:
    """Clusters by file, in the order of first occurrence; edges between files are dashed red."""
    rows = _first(edges, limit)
    ids: dict[str, str] = {}
    files: dict[str, dict[str, None]] = {}
    for r in rows:
        for q, f in ((r["caller_qname"], r["caller_file"]), (r["callee_qname"], r["callee_file"])):
            ids.setdefault(q, f"n{len(ids)}")
            files.setdefault(f or "unknown", {})[q] = None
    esc = lambda x: _escape(x, DOT)
    out = ["digraph callgraph {", "    rankdir=LR;", '    node [shape=box, style="rounded,filled"];']
    for i, (f, nodes) in enumerate(files.items()):
        out += [f'    subgraph "cluster_{i}" {{', f'        label="{esc(f)}";', f'        style=filled; color="{COLOURS[i % len(COLOURS)]}";']
        out += [f'        {ids[q]} [label="{esc(q.split(".")[-1])}"];' for q in nodes] + ["    }"]
    for r in rows:
        far = (r["caller_file"] or "unknown") != (r["callee_file"] or "unknown")
        out.append(f"    {ids[r['caller_qname']]} -> {ids[r['callee_qname']]}" + (" [color=red, style=dashed]" if far else "") + ";")
    return "\n".join([*out, "}"])


def mermaid_graph(edges: DataFrame, limit: int = MERMAID_EDGES) -> str:
    rows, ids = _first(edges, limit + 1), {}
    more = edges.count() - limit if len(rows) > limit else 0
    esc = lambda x: _escape(x, MERMAID)
    out = ["```mermaid", "flowchart LR"]
    for r in rows[:limit]:
        a, b = (ids.setdefault(r[c], f"N{len(ids)}") for c in ("caller_qname", "callee_qname"))
        out.append(f"    {a}[{esc(r['caller_display'])}] --> {b}[{esc(r['callee_display'])}]")
    if more:
        out.append(f"    %% ... and {more} more edges (truncated)")
    return "\n".join([*out, "```"])


def mermaid_chain(nodes: list[dict]) -> str:
    """nodes: display, file, line, in the order of the chain."""
    out = ["```mermaid", "flowchart TD"]
    for i, n in enumerate(nodes):
        label, base = _escape(n["display"], MERMAID), _escape((n["file"] or "").rsplit("/", 1)[-1], MERMAID)
        out.append(f'    N{i}["{label}<br/><small>{base}:{n["line"]}</small>"]')
        if i:
            out.append(f"    N{i - 1} " + ("-.->|cross-file|" if n["file"] != nodes[i - 1]["file"] else "-->") + f" N{i}")
    return "\n".join([*out, "```"])
