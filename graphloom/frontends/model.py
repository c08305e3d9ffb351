"""What a front-end finds in a file."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Function:
    name: str
    qname: str
    line: int
    end_line: int
    signature: str = ""
    docstring: str | None = None
    class_name: str | None = None
    owner_class: str | None = None
    is_async: bool = False
    is_static: bool = False
    decorators: list[str] = field(default_factory=list)
    complexity: int = 1


@dataclass
class Class:
    name: str
    qname: str
    line: int
    end_line: int
    bases: list[str] = field(default_factory=list)
    decorators: list[str] = field(default_factory=list)
    docstring: str | None = None


@dataclass
class Import:
    module: str
    names: list[str]
    alias: str | None
    is_from: bool
    line: int


@dataclass
class Variable:
    name: str
    line: int
    annotation: str | None = None


@dataclass
class Call:
    caller_qname: str
    caller_name: str
    caller_class: str | None
    stub: str
    line: int


@dataclass
class Module:
    functions: list[Function] = field(default_factory=list)
    classes: list[Class] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    variables: list[Variable] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
