"""A project's analysis: sources are parsed once, all else is derived from that table and computed only as it is asked for."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.frontends import registry
from graphloom.frontends.model import Module
from graphloom.functions.paths import EXTENSIONS
from graphloom.functions.text import display_name
from graphloom.operators import chains as C
from graphloom.operators import metrics as M
from graphloom.operators.compare import CACHE_VERSION
from graphloom.operators.resolve import resolved
from graphloom.plans.scratch import cut
from graphloom.sources.scan import read_sources

PARSED = "path string, language string, sha256 string, lang_ord int, kind string, pos int, payload string"
FUNCTION = "name string, qname string, line int, end_line int, signature string, docstring string, class_name string, owner_class string, is_async boolean, is_static boolean, decorators array<string>, complexity int"
CLASS = "name string, qname string, line int, end_line int, bases array<string>, decorators array<string>, docstring string"
IMPORT = "module string, names array<string>, alias string, is_from boolean, line int"
VARIABLE = "name string, line int, annotation string"
CALL = "caller_qname string, caller_name string, caller_class string, stub string, line int"
ERROR = "error string"


def module_of(path: str, language: str) -> str:
    p = path.replace("/", ".").replace("\\", ".")
    for e in sorted((f".{x}" for x, lang in EXTENSIONS.items() if lang == language), key=len, reverse=True):
        if p.endswith(e):
            p = p[: -len(e)]
            break
    if language == "python" and p.endswith(".__init__"):
        p = p[: -len(".__init__")]
    return p.replace(".mod", "") if language == "rust" else p


def parse_text(text: str, path: str, language: str, frontends: dict | None = None) -> Module:
    return (frontends or registry.FRONTENDS)[language].parse(text, module_of(path, language), language)


def _rows(path: str, language: str, content: bytes, frontends: dict | None = None) -> Iterator[tuple[str, int, str]]:
    try:
        m = parse_text(content.decode("utf-8", "replace"), path, language, frontends)
    except (SyntaxError, ValueError, IndexError, KeyError, RecursionError) as e:
        yield "error", 0, json.dumps({"error": f"{type(e).__name__}: {e}"})
        return
    yield "module", 0, "{}"
    for kind in ("functions", "classes", "imports", "variables", "calls"):
        for i, x in enumerate(getattr(m, kind)):
            yield kind, i, json.dumps(dataclasses.asdict(x))


def _parser(frontends: dict):
    """For mapInPandas; the front-ends travel with it, also those that a user registered on the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r.path, r.language, r.sha256, r.lang_ord, *x) for r in b.itertuples() for x in _rows(r.path, r.language, r.content, frontends)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])

    return run


def parse_sources(sources: DataFrame) -> DataFrame:
    """PARSED rows, one a finding, tagged by kind; a file that can't be parsed gives one of kind error."""
    return sources.select("path", "language", "content", "sha256", "lang_ord").mapInPandas(_parser(dict(registry.FRONTENDS)), PARSED)


def parse_with_cache(sources: DataFrame, cache: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(all findings, those that were parsed now): findings of files whose path and hash the cache has are taken from it."""
    if cache is None:
        new = parse_sources(sources)
        return new, new
    known = cache.where("kind <> 'error'").select("path", "sha256").distinct()
    hit = cache.join(sources.select("path", "sha256"), ["path", "sha256"], "left_semi").where("kind <> 'error'").select(*[c.split()[0] for c in PARSED.split(", ")])
    new = parse_sources(sources.join(known, ["path", "sha256"], "left_anti"))
    return hit.unionByName(new), new


@dataclass
class Analysis:
    parsed: DataFrame
    #: Files whose findings came from the cache, and files that were parsed.
    hits: int = 0
    misses: int = 0

    def _kind(self, kind: str, schema: str) -> DataFrame:
        p = self.parsed.where(F.col("kind") == kind)
        ord_ = F.struct("lang_ord", F.split("path", "/").alias("parts"), "pos").alias("ord")
        return p.select(F.col("path").alias("file_path"), "language", ord_, F.from_json("payload", schema).alias("x")).select("file_path", "language", "ord", "x.*")

    @cached_property
    def modules(self) -> DataFrame:
        return self.parsed.where("kind = 'module'").select(F.col("path").alias("file_path"), "language", "sha256")

    @cached_property
    def symbols(self) -> DataFrame:
        f = self._kind("functions", FUNCTION)
        # a file's own functions come before its methods
        return f.withColumn("sym_ord", F.struct("ord.lang_ord", "ord.parts", F.col("owner_class").isNotNull().alias("nested"), "ord.pos")).drop("ord")

    @cached_property
    def classes(self) -> DataFrame:
        return self._kind("classes", CLASS).withColumnRenamed("ord", "class_ord")

    @cached_property
    def imports(self) -> DataFrame:
        return self._kind("imports", IMPORT).withColumnRenamed("ord", "imp_ord")

    @cached_property
    def variables(self) -> DataFrame:
        return self._kind("variables", VARIABLE)

    @cached_property
    def calls(self) -> DataFrame:
        return self._kind("calls", CALL).select(F.col("ord").alias("edge_ord"), "caller_qname", "caller_name", F.col("file_path").alias("caller_file"), "caller_class", "stub", "line", "language")

    @cached_property
    def parse_errors(self) -> DataFrame:
        return self._kind("error", ERROR).select("file_path", F.lit("parse").alias("phase"), "error")

    @cached_property
    def edges(self) -> DataFrame:
        return cut(resolved(self.calls, self.symbols), "edges")

    @cached_property
    def graph(self) -> DataFrame:
        """caller, callee, edge_ord (a struct that sorts in source order), for chains."""
        return self.edges.select("edge_ord", F.col("caller_qname").alias("caller"), F.col("callee_qname").alias("callee"), "caller_file", "callee_file")

    def chains(self, max_depth: int = C.MAX_DEPTH, max_chains: int = C.MAX_CHAINS, only_cross_file: bool = False, restrict_dir: str | None = None) -> DataFrame:
        g = self.graph
        files = g.select(F.explode(F.array(F.struct(F.col("caller").alias("node"), F.col("caller_file").alias("file")), F.struct(F.col("callee").alias("node"), F.col("callee_file").alias("file")))).alias("n")).groupBy("n.node").agg(F.max("n.file").alias("file"))
        first = None
        if restrict_dir:
            first = C.starts(g, files.where(F.col("file").startswith(restrict_dir)))
        if not only_cross_file:
            return C.capped(C.with_files(C.first_paths(g, max_chains, max_depth, from_nodes=first), files), max_chains)
        # which chains count is known only when they are whole
        return C.capped(C.with_files(C.paths(g, max_depth, from_nodes=first, nodes=files)).where("transitions > 0"), max_chains)

    def hotspots(self, top: int = 20) -> DataFrame:
        return M.hotspots(self.edges, top)

    def dead_functions(self) -> DataFrame:
        return M.dead_functions(self.symbols, self.edges)

    def coupling(self) -> DataFrame:
        return M.module_coupling(self.modules, self.edges)

    def cycles(self) -> list[list[str]]:
        return C.back_edge_cycles(C.file_pairs(self.edges))

    def complexity(self) -> DataFrame:
        return M.complexity_buckets(self.symbols)

    def unused_imports(self) -> DataFrame:
        used = M.used_names(self.symbols, self.classes, self.variables, self.edges)
        return M.unused_imports(self.imports.drop("language", "is_from", "line"), used)

    def hierarchy(self) -> DataFrame:
        return M.class_hierarchy(self.classes)

    def totals(self, chains: DataFrame | None = None) -> dict[str, int]:
        return {r["metric"]: r["value"] for r in M.project_totals(self.modules, self.symbols, self.classes, self.edges, chains).collect()}

    def diagram_edges(self) -> DataFrame:
        e = self.edges
        return e.select("edge_ord", "caller_qname", "caller_file", display_name(F.col("caller_class"), F.col("caller_name")).alias("caller_display"), "callee_qname", "callee_file", display_name(F.col("callee_class"), F.col("callee_name")).alias("callee_display"))


def _cache_path(spark: SparkSession, cache_dir: str):
    """The table of this version, on any file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache_dir}/v{CACHE_VERSION}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def load_cache(spark: SparkSession, cache_dir: str) -> DataFrame | None:
    """PARSED rows of earlier runs; None if there are none of this version, or they can't be read."""
    path, fs = _cache_path(spark, cache_dir)
    if not fs.exists(path):
        return None
    try:
        cache = spark.read.schema(PARSED).parquet(path.toString())
        return cut(cache, "cache")  # reads all of it, so a broken file shows here
    except Exception:  # whatever is wrong with it, the files can be parsed again
        return None


def clear_cache(spark: SparkSession, cache_dir: str) -> None:
    """Remove what any version cached."""
    path, fs = _cache_path(spark, cache_dir)
    fs.delete(path.getParent(), True)


def analyse(spark: SparkSession, root: str, languages: list[str] | None = None, restrict_dir: str | None = None, exclude: list[str] | None = None, cache_dir: str | None = None) -> Analysis:
    """Analyse a source tree; with cache_dir, only files that changed since the last run are parsed. Findings of files that this run leaves out stay in the cache."""
    sources = read_sources(spark, root, languages, restrict_dir, exclude)
    if cache_dir is None:
        return Analysis(cut(parse_sources(sources), "parsed"))
    cache = load_cache(spark, cache_dir)
    parsed, new = parse_with_cache(sources, cache)
    parsed = cut(parsed, "parsed")
    keys = sources.select("path", "sha256").distinct()
    total = keys.count()
    hits = 0 if cache is None else keys.join(cache.where("kind <> 'error'").select("path", "sha256").distinct(), ["path", "sha256"], "left_semi").count()
    if cache is None or hits < total:
        kept = parsed if cache is None else parsed.unionByName(cache.join(parsed.select("path").distinct(), "path", "left_anti").select(parsed.columns))
        cut(kept, "cache").write.mode("overwrite").parquet(f"{cache_dir}/v{CACHE_VERSION}")
    return Analysis(parsed, hits, total - hits)
