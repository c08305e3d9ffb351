"""Python sources by the standard syntax tree."""

from __future__ import annotations

import ast

from graphloom.frontends.model import Call, Class, Function, Import, Module, Variable

_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.IfExp)
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def complexity(node: ast.AST) -> int:
    n = 1
    for x in ast.walk(node):
        n += isinstance(x, _BRANCH) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
    return n


def parse(text: str, module: str) -> Module:
    tree, out = ast.parse(text), Module()
    seg = lambda n: ast.get_source_segment(text, n) or ""

    def function(n, cls: str | None) -> None:
        head = seg(n)
        returns = f" -> {seg(n.returns)}" if n.returns else ""
        args = head[head.index("(") : _close(head) + 1] if "(" in head else "()"
        decorators = [seg(d) for d in n.decorator_list]
        out.functions.append(Function(n.name, ".".join(x for x in (module, cls, n.name) if x), n.lineno, n.end_lineno or n.lineno, f"{n.name}{args}{returns}", ast.get_docstring(n, clean=False), cls, cls, isinstance(n, ast.AsyncFunctionDef), "staticmethod" in decorators, decorators, complexity(n)))

    def calls(node: ast.AST, caller: tuple[str, str, str | None]) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, _DEF):
                for s in x.body:
                    calls_in(s, (f"{module}.{x.name}", x.name, None))
            elif isinstance(x, ast.ClassDef):
                continue
            else:
                calls_in(x, caller)

    def calls_in(x: ast.AST, caller: tuple[str, str, str | None]) -> None:
        if isinstance(x, _DEF):
            for s in x.body:
                calls_in(s, (f"{module}.{x.name}", x.name, None))
            return
        if isinstance(x, ast.ClassDef):
            return
        if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute)):
            out.calls.append(Call(*caller, seg(x.func), x.lineno))
        calls(x, caller)

    def body_calls(n, cls: str | None) -> None:
        caller = (".".join(x for x in (module, cls, n.name) if x), n.name, cls)
        for s in n.body:
            calls_in(s, caller)

    for n in tree.body:
        if isinstance(n, _DEF):
            function(n, None)
            body_calls(n, None)
        elif isinstance(n, ast.ClassDef):
            bases = [seg(b) for b in n.bases] + [f"{k.arg}={seg(k.value)}" for k in n.keywords]
            out.classes.append(Class(n.name, f"{module}.{n.name}", n.lineno, n.end_lineno or n.lineno, bases, [seg(d) for d in n.decorator_list], ast.get_docstring(n, clean=False)))
            for m in n.body:
                if isinstance(m, _DEF):
                    function(m, n.name)
                    body_calls(m, n.name)
        elif isinstance(n, ast.Import):
            out.imports.append(Import(n.names[0].name, [], n.names[-1].asname, False, n.lineno))
        elif isinstance(n, ast.ImportFrom):
            if n.module != "__future__":
                out.imports.append(Import("." * n.level + (n.module or ""), [a.name for a in n.names], n.names[-1].asname, True, n.lineno))
        elif isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            out.variables.append(Variable(n.targets[0].id, n.lineno))
        elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
            out.variables.append(Variable(n.target.id, n.lineno, seg(n.annotation)))
    return out


def _close(head: str) -> int:
    depth = 0
    for i, c in enumerate(head):
        depth += (c == "(") - (c == ")")
        if c == ")" and not depth:
            return i
    return len(head) - 1
