"""Source trees, configuration and reports as inputs."""

from __future__ import annotations

import tomllib
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import ALIASES, EXTENSIONS, excluded, in_skipped_dir, language_of, within
from graphloom.operators.filters import discovered


def _files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path (relative), content of the files under root. The reader gives no row for an empty file, so those come from its list of names."""
    base = Path(root).resolve()
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (r.option("pathGlobFilter", glob) if glob else r).load(base.as_uri())
    names = spark.createDataFrame([(unquote(x).removeprefix("file://"),) for x in df.inputFiles()], "full string")
    df = names.join(df.select(F.regexp_replace("path", "^file:/*", "/").alias("full"), "content"), "full", "left")
    rel = F.regexp_replace("full", "^" + _quoted(str(base).rstrip("/")) + "/", "")
    return df.select(rel.alias("path"), F.coalesce("content", F.lit(b"")).alias("content"))


def read_sources(spark: SparkSession, root: str, languages: list[str] | None = None, restrict_dir: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path (relative), language, content, sha256, lang_ord, of the files that discovery takes. Only the names of other files are listed."""
    df = _files(spark, root, "*.{" + ",".join(EXTENSIONS) + "}")
    wanted = [resolve_language(x) for x in languages] if languages else sorted(set(EXTENSIONS.values()))
    wanted = list(dict.fromkeys(wanted))
    df = df.where(discovered(F.col("path")))
    if restrict_dir:
        df = df.where(within(F.col("path"), restrict_dir))
    if exclude:
        df = df.where(~excluded(F.col("path"), exclude))
    df = df.withColumn("language", language_of(F.col("path"))).where(F.col("language").isin(wanted))
    order = F.array_position(F.array(*map(F.lit, wanted)), F.col("language")).cast("int")
    return df.select("path", "language", "content", F.sha2("content", 256).alias("sha256"), order.alias("lang_ord"))


def _quoted(x: str) -> str:
    return "\\Q" + x + "\\E"


def resolve_language(name: str) -> str:
    try:
        return ALIASES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown language: {name}") from None


def detect_languages(spark: SparkSession, root: str) -> list[str]:
    """Languages of all files by extension, sorted; at most as many as are known."""
    p = F.col("path")
    df = _files(spark, root).select("path")
    return [r[0] for r in df.where(~in_skipped_dir(p)).select(language_of(p).alias("l")).where("l IS NOT NULL").distinct().orderBy("l").collect()]


CONFIG = "graphloom.toml"


def load_config(project: str, strict: bool = False) -> dict:
    """[analyze] of the configuration in the project or its first three parents; nothing if there is none, or it can't be read and strict isn't set."""
    here = Path(project).resolve()
    for d in [here, *list(here.parents)[:3]]:
        f = d / CONFIG
        if f.is_file():
            try:
                return tomllib.loads(f.read_text()).get("analyze", {})
            except (OSError, tomllib.TOMLDecodeError):
                if strict:
                    raise
                return {}
    return {}


def read_config(path: str) -> dict:
    """[analyze] of a configuration that was named, so what is wrong with it is an error (OSError or ValueError)."""
    return tomllib.loads(Path(path).read_text()).get("analyze", {})


def merged_options(options: dict, defaults: dict, config: dict) -> dict:
    """A configured value counts where the option still has its default."""
    return {k: config[k] if k in config and v == defaults.get(k) else v for k, v in options.items()}


def read_manifest(path: str) -> list[dict]:
    """Projects of a corpus manifest (version 1), each with a name, a path and lower bounds."""
    data = tomllib.loads(Path(path).read_text())
    if data.get("version") != 1 or not isinstance(data.get("project"), list) or not data["project"]:
        raise ValueError("a manifest needs version = 1 and at least one [[project]]")
    names = [p.get("name") for p in data["project"]]
    if None in names or len(set(names)) < len(names):
        raise ValueError("project names must be given, and unique")
    return data["project"]


REGISTRY_FIELDS = {"name": str, "path": str, "url": str, "revision": str, "license": str, "languages": list, "checksum": str, "enabled": bool}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a registry (version 1, [[source]] tables): a row each of REGISTRY_FIELDS, nulls where one isn't given. Unknown fields, wrong types and equal names are errors."""
    data = tomllib.loads(Path(path).read_text())
    rows = data.get("source")
    if data.get("version") != 1 or not isinstance(rows, list) or not rows or not all(isinstance(r, dict) for r in rows):
        raise ValueError("a registry needs version = 1 and at least one [[source]]")
    for r in rows:
        for k, v in r.items():
            if k not in REGISTRY_FIELDS or not isinstance(v, REGISTRY_FIELDS[k]) or (isinstance(v, list) and not all(isinstance(x, str) for x in v)):
                raise ValueError(f"source {r.get('name')}: {k} = {v!r}")
    names = [r.get("name") for r in rows]
    if None in names or len(set(names)) < len(names):
        raise ValueError("source names must be given, and unique")
    kinds = {str: "string", bool: "boolean", list: "array<string>"}
    return spark.createDataFrame([tuple(r.get(k) for k in REGISTRY_FIELDS) for r in rows], ", ".join(f"{k} {kinds[t]}" for k, t in REGISTRY_FIELDS.items()))


def write_registry(sources: DataFrame, path: str) -> None:
    """The registry as TOML, sources by name; a file that a person keeps, so it is written by the driver."""
    import json

    lines = ["version = 1"]
    for r in sources.orderBy("name").collect():
        lines += ["", "[[source]]", *[f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in r.asDict().items() if v is not None and k in REGISTRY_FIELDS]]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a benchmark or snapshot report (JSON with cases or projects): one row a case; equal names are an error."""
    raw = spark.read.json(path, multiLine=True)
    key = "cases" if "cases" in raw.columns else "projects"
    if key not in raw.columns:
        raise ValueError("a report has cases or projects")
    out = raw.select(F.explode(key).alias("c")).select("c.*")
    if not out.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("a report names a case twice")
    return out


def read_changed_files(spark: SparkSession, path: str) -> DataFrame:
    """path of each changed file, in order, each once: from a JSON list, an object with files, or lines."""
    text = spark.read.text(path, wholetext=True)
    items = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).when(F.ltrim("value").startswith("{"), F.from_json("value", "files array<string>")["files"]).otherwise(F.split("value", "\n"))
    e = text.select(F.posexplode(items).alias("pos", "raw")).select("pos", F.regexp_replace(F.trim("raw"), r"^\./", "").alias("path")).where("path <> ''")
    return e.groupBy("path").agg(F.min("pos").alias("pos")).orderBy("pos").select("path", "pos")


def read_codeowners(spark: SparkSession, path: str) -> list[tuple[str, tuple[str, ...]]]:
    """(pattern, owners) in order; comments and lines without an owner don't count. A file that a person writes, so it is read on the driver."""
    lines = [r["value"].split("#")[0].split() for r in spark.read.text(path).collect()]
    return [(p[0], tuple(p[1:])) for p in lines if len(p) > 1]


def read_edges_json(spark: SparkSession, path: str) -> DataFrame:
    """caller, callee, edge_ord of an older tool's JSON with an edges array."""
    e = spark.read.json(path, multiLine=True).select(F.posexplode("edges").alias("edge_ord", "e"))
    return e.select(F.col("e.caller").alias("caller"), F.col("e.callee").alias("callee"), F.col("edge_ord").cast("long").alias("edge_ord"))


def numbered(sources: DataFrame) -> DataFrame:
    """file_ord within each language, by path components."""
    w = Window.partitionBy("lang_ord").orderBy(F.split("path", "/"))
    return sources.withColumn("file_ord", F.row_number().over(w))
