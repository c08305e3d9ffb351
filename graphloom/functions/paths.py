"""Paths, languages and names as column expressions."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension to language; ``.h`` counts as C.
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go",
    "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
}
ALIASES = {
    "py": "python", "python": "python", "js": "javascript", "javascript": "javascript", "ts": "typescript", "typescript": "typescript", "java": "java",
    "go": "go", "golang": "go", "rust": "rust", "rs": "rust", "c": "c", "cpp": "cpp", "c++": "cpp",
}
#: Directories that are never searched.
SKIP_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", ".env", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "build", "dist", "target", "vendor", ".idea", ".vscode", ".eggs", "site-packages", ".next", "out", "bin",
)


def language_of(path: Column) -> Column:
    """Language by extension, whatever its case; null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.nullif(ext, F.lit("")))


def in_skipped_dir(path: Column, skip: tuple[str, ...] = SKIP_DIRS) -> Column:
    """Whether a directory of the relative path is one that is never searched."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, skip)))


def within(path: Column, directory: str) -> Column:
    """Whether the path is the directory or inside it."""
    d = directory.rstrip("/")
    return (path == d) | path.startswith(d + "/")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression of Java and RE2; * crosses slashes."""
    out = fnmatch.translate(pattern)
    out = re.sub(r"\(\?>(.*?)\)", r"(?:\1)", out)
    return out.replace(r"\Z", r"\z").replace(r"\z", "$")


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern covers the path: as a glob, as a bare name that is the path or a directory at its start, or as ``directory/**``."""
    tests = []
    for p in patterns:
        tests.append(path.rlike(glob_regex(p)))
        if not set("/*?") & set(p):
            tests.append((path == p) | path.startswith(p + "/"))
        if p.endswith("/**"):
            tests.append(path.startswith(p[:-2]))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def before_last(name: Column) -> Column:
    """The segment before the last; null if there is none."""
    return F.try_element_at(F.split(name, r"\."), F.lit(-2))


def import_base(module: Column) -> Column:
    """What a bare import is called: behind the last dot, then behind the last slash."""
    return F.element_at(F.split(last_segment(module), "/"), -1)


def module_name(path: Column, language: Column) -> Column:
    """Dotted module of a source path, by the rules of its language."""
    dotted = F.translate(path, "/\\", "..")
    strip = lambda exts: F.regexp_replace(dotted, r"\.(?:" + exts + r")$", "")
    return (
        F.when(language == "python", F.regexp_replace(strip("py"), r"\.__init__$", ""))
        .when(language.isin("javascript", "typescript"), strip("tsx|ts|jsx|js"))
        .when(language == "java", strip("java"))
        .when(language == "go", strip("go"))
        .when(language == "rust", F.replace(strip("rs"), F.lit(".mod"), F.lit("")))
        .when(language == "c", strip("c|h"))
        .otherwise(strip("cpp|cc|cxx|hpp|hxx"))
    )
