"""Predicates over paths, callee texts and report rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import EXTENSIONS, in_skipped_dir


def discovered(path: Column, languages: tuple[str, ...] | None = None) -> Column:
    """Whether discovery takes a file: an extension of a language in lower case, no skipped directory, no Go test."""
    exts = [e for e, lang in EXTENSIONS.items() if languages is None or lang in languages]
    return path.rlike(r"\.(" + "|".join(exts) + ")$") & ~in_skipped_dir(path) & ~path.endswith("_test.go")


_CALLEE = {
    "go": lambda c: c.rlike(r"^[\p{L}\p{N}._]+$"),
    "rust": lambda c: c.rlike(r"^[\p{L}\p{N}:._<>&*]+$"),
    "c": lambda c: ~c.rlike(r"[\n{()*]"),
    "cpp": lambda c: ~c.rlike(r"[\n{()]"),
}


def valid_callee(text: Column, language: str) -> Column:
    """Whether the text of a called expression can be a name in the language."""
    return _CALLEE[language](text)


def report_search(rows: DataFrame, columns: list[str], text: str = "", equals: dict[str, str] | None = None) -> DataFrame:
    """Rows of which any of the columns holds the text, whatever its case, and whose other columns have the given values; empty conditions hold."""
    tests = [F.col(c) == v for c, v in (equals or {}).items() if v]
    if text:
        tests.append(reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower())) for c in columns]))
    return reduce(lambda df, t: df.where(t), tests, rows)


def watched(path: Column, extensions: tuple[str, ...] = tuple(EXTENSIONS)) -> Column:
    return path.rlike(r"\.(" + "|".join(extensions) + ")$")
