"""python -m graphloom.cli analyze|watch PATH"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from graphloom.operators.chains import MAX_CHAINS, MAX_DEPTH
from graphloom.plans.project import analyse
from graphloom.sinks import diagrams, reports
from graphloom.sources.scan import load_config, merged_options, read_config, resolve_language

DEFAULTS = {"format": "summary", "output": None, "lang": None, "max_depth": MAX_DEPTH, "max_chains": MAX_CHAINS, "only_cross_file": False, "restrict_dir": None, "exclude": None, "cache": None}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    w = sub.add_parser("watch")
    for x in (sub.add_parser("analyze"), w):
        _options(x)
    w.add_argument("--debounce", type=float, default=1.0, help="quiet seconds before the tree is analysed again")
    w.add_argument("--rounds", type=int, help="end after so many analyses")
    return p


def _options(a: argparse.ArgumentParser) -> None:
    a.add_argument("path")
    a.add_argument("--config", help="a TOML file with [analyze]; without it, the one of the project")
    a.add_argument("--format", choices=["summary", "json", "jsonl", "dot", "mermaid", "html", "tables"], default=DEFAULTS["format"])
    a.add_argument("--output")
    a.add_argument("--lang", action="append")
    a.add_argument("--max-depth", type=int, default=MAX_DEPTH)
    a.add_argument("--max-chains", type=int, default=MAX_CHAINS)
    a.add_argument("--only-cross-file", action="store_true")
    a.add_argument("--restrict-dir")
    a.add_argument("--exclude", action="append")
    a.add_argument("--cache")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command, root, config = args.pop("command"), args.pop("path"), args.pop("config")
    gap, rounds = args.pop("debounce", 1.0), args.pop("rounds", None)
    try:
        o = merged_options(args, DEFAULTS, read_config(config) if config else load_config(root))
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    try:
        languages = [resolve_language(x) for x in o["lang"]] if o["lang"] else None
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if not Path(root).is_dir() or (o["restrict_dir"] and not (Path(root) / o["restrict_dir"]).is_dir()):
        print("no such directory", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    if command == "watch":
        from graphloom.streaming.watch import watch_tree

        code = _run(spark, root, o, languages)
        watch_tree(root, lambda changed: (print("changed: " + ", ".join(changed)), _run(spark, root, o, languages)), gap, rounds=rounds)
        return code
    return _run(spark, root, o, languages)


def _run(spark: SparkSession, root: str, o: dict, languages: list[str] | None) -> int:
    a = analyse(spark, root, languages, o["restrict_dir"], o["exclude"], o["cache"])
    if a.modules.isEmpty() and a.parse_errors.isEmpty():
        print("nothing to analyse: no source file of a known language")
        return 0
    chains = a.chains(o["max_depth"], o["max_chains"], o["only_cross_file"], o["restrict_dir"])
    kind, out = o["format"], o["output"]
    if kind == "tables":
        reports.write_tables(a, out or "graphloom-tables")
        return 0
    if kind == "jsonl":
        reports.write_jsonl(chains, a.symbols.select("qname", "name", "file_path", "line", "language").dropDuplicates(["qname"]), out or "chains.jsonl")
        return 0
    if kind in ("dot", "mermaid"):
        text = diagrams.dot(a.diagram_edges()) if kind == "dot" else diagrams.mermaid_graph(a.diagram_edges())
    else:
        data = reports.report(a, chains)
        if kind == "json" or (kind == "summary" and out):
            reports.write_json(data, out or "report.json")
            return 0
        text = reports.html_page(data) if kind == "html" else reports.summary(data)
    if out:
        Path(out).write_text(text, encoding="utf-8")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
