"""Escaping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In this order: quotes and brackets that Mermaid would read.
MERMAID = (('"', "#quot;"), ("'", "#apos;"), ("<", "&lt;"), (">", "&gt;"), ("(", "#40;"), (")", "#41;"), ("[", "#91;"), ("]", "#93;"), ("{", "#123;"), ("}", "#125;"))
DOT = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"))


def _replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def mermaid_escape(c: Column) -> Column:
    return _replaced(c, MERMAID)


def dot_escape(c: Column) -> Column:
    return _replaced(c, DOT)


def script_json(c: Column) -> Column:
    """JSON that can stand inside a script element."""
    return _replaced(c, (("</", "<\\/"), ("<!--", "<\\u0021--"), (chr(0x2028), "\\u2028"), (chr(0x2029), "\\u2029")))


def display_name(class_name: Column, name: Column) -> Column:
    return F.concat_ws(".", F.nullif(class_name, F.lit("")), name)
