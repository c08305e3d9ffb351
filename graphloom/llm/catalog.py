"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mpeg", "repeats", "merkle", "linedup", "secrets", "simhash", "packing", "langid", "pieces", "chat")


def _gather(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"graphloom.llm.{m}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
