"""Reports of an analysis: JSON, JSON lines, HTML and a summary for a terminal."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.project import Analysis

#: Rows that a summary or page shows; the JSON report and the tables have all.
SUMMARY = {"hotspots": 10, "coupling": 10, "cycles": 5, "unused_imports": 10, "hierarchy": 15, "dead": 5, "parse_errors": 5}
PAGE = {"hotspots": 50, "coupling": 40, "cycles": 30, "unused_imports": 60, "hierarchy": 40, "dead": 80, "chains": 50, "parse_errors": 40}


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.toLocalIterator()]


def report(a: Analysis, chains: DataFrame | None = None) -> dict:
    """The whole report as one value, for a project whose results fit a file."""
    c = _dicts(chains.orderBy("ordpath").select("path", "length", F.col("transitions").alias("cross_file_transitions"))) if chains is not None else []
    hot = _dicts(a.hotspots())
    return {
        "summary": a.totals(chains),
        "languages": sorted(r[0] for r in a.modules.select("language").distinct().collect()),
        "parse_errors": _dicts(a.parse_errors),
        "modules": _dicts(a.modules.orderBy("file_path")),
        "functions": _dicts(a.symbols.drop("sym_ord", "docstring").orderBy("file_path", "line")),
        "edges": _dicts(a.edges.orderBy("edge_ord").select("caller_qname", "callee_qname", "line", "rule")),
        "chains": c,
        "analysis": {
            "hotspot_functions": hot,
            "dead_functions": _dicts(a.dead_functions().select("qname", "file_path", "line").orderBy("file_path", "line")),
            "circular_dependencies": a.cycles(),
            "module_coupling": {r["file_path"]: {"fan_in": r["fan_in"], "fan_out": r["fan_out"], "instability": round(r["instability"], 3)} for r in a.coupling().toLocalIterator()},
            "complexity_distribution": {r["bucket"]: r["n"] for r in a.complexity().collect()},
            "unused_imports": _dicts(a.unused_imports().select("file_path", "module", "names").orderBy("file_path", "module")),
            "class_hierarchy": {r["parent"]: r["children"] for r in a.hierarchy().toLocalIterator()},
        },
    }


def write_json(data: dict, path: str) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def write_tables(a: Analysis, directory: str) -> None:
    """Each table as Parquet, for projects of any size."""
    for name in ("modules", "symbols", "classes", "imports", "variables", "calls", "edges", "parse_errors"):
        getattr(a, name).write.mode("overwrite").parquet(f"{directory}/{name}")


def chain_lines(chains: DataFrame, nodes: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """value: a JSON object a chain. nodes: qname, name, file_path, line, language (joined to each node of each chain, so for chains under a cap), or the struct of the last four as an expression of the node."""
    if isinstance(nodes, DataFrame):
        e = chains.select("ordpath", "length", "transitions", F.posexplode("path").alias("pos", "qname")).join(nodes, "qname", "left")
        one = F.struct("pos", F.struct("name", "file_path", "line", "language").alias("n"))
        g = e.groupBy("ordpath", "length", "transitions").agg(F.array_sort(F.collect_list(one)).alias("ns"))
        chains, chain = g, F.transform("ns", lambda x: x["n"])
    else:
        chain = F.transform("path", nodes)
    return chains.select("ordpath", F.to_json(F.struct("length", F.col("transitions").alias("cross_file_transitions"), chain.alias("chain"))).alias("value"))


def write_jsonl(chains: DataFrame, nodes: DataFrame, directory: str) -> None:
    chain_lines(chains, nodes).orderBy("ordpath").select("value").write.mode("overwrite").text(directory)


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse;margin-bottom:2em}}td,th{{border:1px solid #bbb;padding:2px 8px;text-align:left}}</style></head>
<body><h1>{title}</h1><p><input id="q" placeholder="search"> <select id="f"><option value="">all files</option></select> <select id="l"><option value="">all languages</option></select></p>
<div id="tables"></div><script id="data" type="application/json">{data}</script>
<script>
const data = JSON.parse(document.getElementById("data").textContent), get = id => document.getElementById(id);
const fill = (el, values) => values.forEach(v => el.add(new Option(v, v)));
fill(get("f"), data.files); fill(get("l"), data.languages);
function draw() {{
  const q = get("q").value.toLowerCase(), f = get("f").value, l = get("l").value, root = get("tables");
  root.replaceChildren();
  for (const [name, t] of Object.entries(data.tables)) {{
    const rows = t.rows.filter(r => (!q || r.some(v => String(v).toLowerCase().includes(q))) && (!f || !t.file || r[t.file - 1] === f) && (!l || !t.file || data.language_of[r[t.file - 1]] === l)).slice(0, t.most);
    const table = document.createElement("table"), head = document.createElement("h2");
    head.textContent = name + " (" + rows.length + ")";
    const line = (cells, tag) => {{ const tr = table.insertRow(); cells.forEach(c => {{ const x = document.createElement(tag); x.textContent = c; tr.append(x); }}); }};
    line(t.columns, "th"); rows.forEach(r => line(r, "td"));
    root.append(head, table);
  }}
}}
["q", "f", "l"].forEach(id => get(id).addEventListener("input", draw)); draw();
</script></body></html>
"""


def in_script(data: object) -> str:
    """JSON that can stand inside a script element."""
    text = json.dumps(data, ensure_ascii=False, default=str)
    for a, b in (("</", "<\\/"), ("<!--", "<\\u0021--"), (chr(0x2028), "\\u2028"), (chr(0x2029), "\\u2029")):
        text = text.replace(a, b)
    return text


def html_page(data: dict, title: str = "Call graph") -> str:
    an = data["analysis"]

    def t(columns: list[str], rows: list[list], key: str, file: int = 0) -> dict:
        return {"columns": columns, "rows": rows, "file": file, "most": PAGE[key]}

    tables = {
        "Hotspots": t(["function", "file", "calls"], [[h["callee_qname"], h["callee_file"], h["calls"]] for h in an["hotspot_functions"]], "hotspots", 2),
        "Dead functions": t(["function", "file", "line"], [[x["qname"], x["file_path"], x["line"]] for x in an["dead_functions"]], "dead", 2),
        "Coupling": t(["file", "fan in", "fan out", "instability"], [[k, v["fan_in"], v["fan_out"], v["instability"]] for k, v in an["module_coupling"].items()], "coupling", 1),
        "Cycles": t(["cycle"], [[" -> ".join(c)] for c in an["circular_dependencies"]], "cycles"),
        "Unused imports": t(["module", "names", "file"], [[i["module"], ", ".join(i["names"]), i["file_path"]] for i in an["unused_imports"]], "unused_imports", 3),
        "Classes": t(["class", "subclasses"], [[k, ", ".join(v)] for k, v in an["class_hierarchy"].items()], "hierarchy"),
        "Chains": t(["chain", "length", "transitions"], [[" -> ".join(c["path"]), c["length"], c["cross_file_transitions"]] for c in data["chains"]], "chains"),
        "Warnings": t(["file", "error"], [[e["file_path"], e["error"]] for e in data["parse_errors"]], "parse_errors", 1),
    }
    files = {m["file_path"]: m["language"] for m in data["modules"]}
    return _PAGE.format(title=html.escape(title), data=in_script({"tables": tables, "files": sorted(files), "languages": data["languages"], "language_of": files}))


def summary(data: dict) -> str:
    an, out = data["analysis"], [", ".join(f"{k}: {v}" for k, v in data["summary"].items())]
    coupling = sorted(an["module_coupling"].items(), key=lambda kv: -kv[1]["instability"])

    def part(title: str, rows: list[str], key: str) -> None:
        if rows:
            out.extend(["", title, *[f"  {r}" for r in rows[: SUMMARY[key]]]])

    part("Hotspots", [f"{h['calls']:>5}  {h['callee_qname']}" for h in an["hotspot_functions"]], "hotspots")
    part("Coupling", [f"{v['fan_in']:>4} {v['fan_out']:>4} {v['instability']:.3f}  {k}" for k, v in coupling], "coupling")
    part("Cycles", [" -> ".join(c) for c in an["circular_dependencies"]], "cycles")
    part("Unused imports", [f"{i['file_path']}: {i['module']} {', '.join(i['names'])}".rstrip() for i in an["unused_imports"]], "unused_imports")
    part("Classes", [f"{k}: {', '.join(v)}" for k, v in sorted(an["class_hierarchy"].items()) if v], "hierarchy")
    part("Dead functions", [f"{d['qname']} ({d['file_path']}:{d['line']})" for d in an["dead_functions"]], "dead")
    part("Parse errors", [f"{e['file_path']}: {e['error']}" for e in data["parse_errors"]], "parse_errors")
    return "\n".join(out)
