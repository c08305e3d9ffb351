"""JavaScript, TypeScript, Java, Go, Rust, C and C++ by one tokenizer and a small scanner each.

A scanner finds declarations where its language has them (module level, class bodies, impl blocks, namespaces) and the token ranges of their bodies. Calls are then read off the
tokens: a name before an opening parenthesis, attributed to the declared function whose range holds it. What a scanner doesn't know it passes over.
"""

from __future__ import annotations

import re

from graphloom.frontends.lexer import Source
from graphloom.frontends.model import Call, Class, Function, Import, Module, Variable

CONTROL = {"if", "for", "while", "switch", "catch", "return", "sizeof", "new", "function", "func", "fn", "else", "do", "case", "typeof", "await", "yield", "match", "loop", "throw", "delete", "in", "of", "defer", "go", "range", "select", "import", "super", "synchronized", "try", "alignof", "decltype", "static_assert", "let", "const", "var", "and", "or", "not", "void", "as", "where", "use", "impl", "struct", "enum", "class"}
BRANCHES = {
    "javascript": ("if", "else", "for", "while", "do", "case", "catch"), "java": ("if", "else", "for", "while", "do", "switch", "catch"), "go": ("if", "for", "switch", "select", "case", "default"),
    "rust": ("if", "else", "for", "while", "loop"), "c": ("if", "else", "for", "while", "do", "case"), "cpp": ("if", "else", "for", "while", "do", "case", "catch"),
}


class Scanner:
    def __init__(self, text: str, module: str, language: str):
        self.family = "javascript" if language == "typescript" else language
        self.language, self.module = language, module
        self.s, self.out = Source(text, self.family), Module()
        self.ranges: list[tuple[int, int, Function]] = []  # of whole functions, by tokens
        self.names: set[int] = set()  # tokens that declare
        self.skipped: list[tuple[int, int]] = []

    # what all share

    def qname(self, *parts: str | None) -> str:
        return ".".join(x for x in (self.module, *parts) if x)

    def complexity(self, i: int, j: int) -> int:
        words, n = BRANCHES[self.family], 1
        for k in range(i, j + 1):
            t = self.s.t(k)
            if self.s.kind(k) == "id" and t in words:
                n += 1
                if t == "do":
                    n -= 1  # its while is counted
            elif t in ("&&", "||") and self.family not in ("go", "rust"):
                n += 1
            elif t == "?" and self.family in ("javascript", "java", "c", "cpp") and self.s.t(k + 1) not in (":", ")", ",", ";", "=", ">"):
                n += 1
            elif t == "=>" and self.family == "rust":
                n += 1
        return n

    def function(self, name_at: int, name: str, cls: str | None, owner: bool, begin: int, end: int, params: tuple[int, int] | None, path: str | None = None, **kw) -> None:
        args = self.s.slice(*params) if params else "()"
        f = Function(name, self.qname(path, cls.replace("::", ".") if cls else None, name), self.s.line(begin), self.s.line(end), name + (args if args.startswith("(") else f"({args})"), None, cls, cls if owner else None, complexity=self.complexity(begin, end), **kw)
        self.out.functions.append(f)
        self.names.add(name_at)
        self.ranges.append((begin, end, f))

    def cls(self, name: str, begin: int, end: int, bases: list[str], path: str | None = None, decorators: list[str] | None = None) -> None:
        self.out.classes.append(Class(name, self.qname(path, name), self.s.line(begin), self.s.line(end), bases, decorators or []))

    def after_params(self, close: int, stop: tuple[str, ...] = ("{", ";")) -> int:
        """The first { or ; behind a parameter list, over return types, throws and initializers; -1 if something else ends it."""
        k = close + 1
        while k < len(self.s):
            t = self.s.t(k)
            if t in stop:
                return k
            if t in ("(", "["):
                k = self.s.match.get(k, k)
            elif t in ("}", ")", "=>", "]"):
                return -1
            elif t == "{":
                return -1
            k += 1
        return -1

    def chain(self, k: int) -> int:
        """Where the expression that ends in the name at k begins."""
        links = {"c": (".", "->"), "cpp": (".", "->", "::"), "rust": (".", "::"), "javascript": (".", "?.")}.get(self.family, (".",))
        while self.s.t(k - 1) in links:
            p = k - 2
            if self.s.t(p) in (")", "]") and p in self.s.match:
                p = self.s.pair(p)
                while self.s.t(p) in ("(", "[") and (self.s.kind(p - 1) in ("id", "str") and self.s.t(p - 1) not in CONTROL or self.s.t(p - 1) in (")", "]")):
                    p = self.s.match.get(p - 1, p - 1) if self.s.t(p - 1) in (")", "]") else p - 1
                k = p
                if self.s.kind(k) != "id":
                    return k
            elif self.s.kind(p) in ("id", "str", "num"):
                k = p
            else:
                return k
        return k

    def calls(self) -> None:
        s, found = self.s, []
        for i in range(len(s)):
            if s.kind(i) != "id" or i in self.names:
                continue
            name, nxt = s.t(i), s.t(i + 1)
            if (name in CONTROL and not (self.family == "rust" and s.t(i - 1) in ("::", "."))) or name.startswith("@"):
                continue
            if self.family == "rust" and nxt == "!" and s.t(i + 2) in OPENERS:
                found.append((i, -i, f"{name}!", i))
                self.skipped.append((i + 2, s.match.get(i + 2, i + 2)))
                continue
            if self.family == "java" and nxt == "::" and s.kind(i + 2) == "id" and s.t(i + 3) != "(":
                if s.t(i + 2) != "new":
                    found.append((self.chain(i), -i, s.t(i + 2) if name in ("this", "super") else f"{s.slice(self.chain(i), i)}.{s.t(i + 2)}", i))
                continue
            if nxt == "?." and s.t(i + 2) == "(":
                nxt = "("
            elif self.family == "rust" and nxt == "::" and s.t(i + 2) == "<":
                nxt = "(" if s.t(self._angle(i + 2) + 1) == "(" else ""
            elif self.family in ("cpp", "javascript") and nxt == "<" and (self.family == "cpp" or self.language == "typescript"):
                e = self._angle(i + 1)
                nxt = "(" if e > 0 and s.t(e + 1) == "(" else ""
            if nxt != "(":
                continue
            begin = self.chain(i)
            before = s.t(begin - 1)
            if before == "new" or (s.kind(begin - 1) == "id" and before not in CONTROL and self.family in ("c", "cpp", "java") and s.kind(begin) == "id" and begin == i):
                continue
            text = s.slice(begin, i)
            if self.family == "rust":
                text = re.sub(r"::<[^()]*>", "", text).replace("::", ".")
            elif self.family == "cpp":
                text = re.sub(r"<[^()<>]*>", "", text).replace("::", ".")
            found.append((begin, -i, text, i))
        for begin, _, text, i in sorted(found):
            if any(a <= begin <= z for a, z in self.skipped):
                continue
            if not self._valid(text):
                continue
            inside = [(z - a, f) for a, z, f in self.ranges if a <= i <= z]
            if inside:
                f = min(inside, key=lambda x: x[0])[1]
                self.out.calls.append(Call(f.qname, f.name, None if self.family == "javascript" else f.class_name, text, s.line(i)))

    def _angle(self, i: int) -> int:
        depth, k = 0, i
        while k < min(len(self.s), i + 60):
            t = self.s.t(k)
            depth += (t == "<") - (t == ">")
            if t in (";", "{", "}", "&&", "||"):
                return -1
            if not depth:
                return k
            k += 1
        return -1

    def _valid(self, text: str) -> bool:
        if self.family == "go":
            return bool(re.fullmatch(r"[\w.]+", text))
        if self.family == "rust":
            return bool(re.fullmatch(r"[\w:.<>&*!]+", text))
        if self.family == "c":
            return not re.search(r"[\n{()*]", text)
        if self.family == "cpp":
            return not re.search(r"[\n{()]", text)
        return True

    def parse(self) -> Module:
        getattr(self, self.family)(0, len(self.s))
        self.calls()
        return self.out

    # JavaScript and TypeScript

    def javascript(self, i: int, end: int) -> None:
        s = self.s
        while i < end:
            t = s.t(i)
            if s.kind(i) == "id" and t == "import" and s.t(i + 1) != "(":
                i = self._js_import(i)
            elif t == "function" or (t == "async" and s.t(i + 1) == "function"):
                k = i + 1 + (t == "async")
                k += s.t(k) == "*"
                p = k + 1 if s.t(k + 1) == "(" else k + 1 + self._generic(k + 1)
                if s.kind(k) == "id" and s.t(p) == "(":
                    b = self.after_params(s.pair(p))
                    if b > 0 and s.t(b) == "{":
                        self.function(k, s.t(k), None, False, i, s.pair(b), (p, s.pair(p)), is_async=t == "async")
                        i = s.pair(b)
                i += 1
            elif t == "class" and s.kind(i + 1) == "id":
                b = i + 2
                while b < end and s.t(b) != "{":
                    b += 1
                heritage = s.slice(i + 2, b - 1) if b > i + 2 else ""
                bases = [heritage] if self.language == "typescript" and heritage else [heritage.removeprefix("extends").strip()] if heritage else []
                self.cls(s.t(i + 1), i, s.match.get(b, b), bases)
                self._js_members(b + 1, s.match.get(b, b), s.t(i + 1))
                i = s.match.get(b, b) + 1
            elif t in ("const", "let", "var"):
                i = self._js_declarators(i + 1, end)
            elif t in ("{", "(", "["):
                i = s.match.get(i, i) + 1
            else:
                i += 1

    def _generic(self, i: int) -> int:
        e = self._angle(i) if self.s.t(i) == "<" else -1
        return e - i + 1 if e > 0 else 0

    def _js_import(self, i: int) -> int:
        s, k, names, module = self.s, i + 1, [], ""
        while k < len(s):
            t = s.t(k)
            if s.kind(k) == "str":
                module = t.strip("'\"`")
                break
            if s.kind(k) == "id" and t not in ("from", "as", "type") and s.t(k - 1) != "as":
                names.append(t)
            elif s.kind(k) == "id" and s.t(k - 1) == "as" and s.t(k - 2) == "*":
                names.append(t)
            elif t == ";":
                break
            k += 1
        if module:
            self.out.imports.append(Import(module, names, None, bool(names), s.line(i)))
        return k + 1

    def _js_members(self, i: int, end: int, cls: str) -> None:
        s, begin, words = self.s, i, []
        while i < end:
            t = s.t(i)
            p = i + 1 + self._generic(i + 1)
            if s.kind(i) == "id" and s.t(p) == "(" and t not in ("if", "for", "while", "switch"):
                b = self.after_params(s.pair(p))
                if b > 0 and s.t(b) == "{":
                    self.function(i, t, cls, True, begin, s.pair(b), (p, s.pair(p)), is_async="async" in words, is_static="static" in words)
                    i = s.pair(b) + 1
                    begin, words = i, []
                    continue
                if b > 0:
                    i = b
                    continue
            if t in (";", "}"):
                begin, words = i + 1, []
            elif t in ("{", "(", "["):
                i = s.match.get(i, i)
            elif s.kind(i) == "id":
                words.append(t)
            i += 1

    def _arrow(self, i: int, end: int) -> tuple[int, int, tuple[int, int], bool] | None:
        """If a function expression begins at i: its arrow or brace, its last token, its parameters, whether it is async."""
        s, k = self.s, i
        is_async = s.t(k) == "async"
        k += is_async
        if s.t(k) == "function":
            k += 1 + (s.t(k + 1) == "*")
            k += s.kind(k) == "id"
            if s.t(k) != "(":
                return None
            b = self.after_params(s.pair(k))
            return (b, s.pair(b), (k, s.pair(k)), is_async) if b > 0 and s.t(b) == "{" else None
        k += self._generic(k)
        if s.t(k) == "(":
            params, a = (k, s.match.get(k, k)), s.match.get(k, k) + 1
            while a < end and s.t(a) not in ("=>", "{", ";", ",", ")", "="):
                a = s.match.get(a, a) + 1 if s.t(a) in OPENERS else a + 1
        elif s.kind(k) == "id":
            params, a = (k, k), k + 1
        else:
            return None
        if s.t(a) != "=>":
            return None
        if s.t(a + 1) == "{":
            return a, s.match.get(a + 1, a + 1), params, is_async
        z = a + 1
        while z < end and s.t(z) not in (",", ";", ")", "}", "]"):
            z = s.match.get(z, z) + 1 if s.t(z) in OPENERS else z + 1
        return a, z - 1, params, is_async

    def _js_declarators(self, i: int, end: int) -> int:
        s = self.s
        while i < end:
            if s.kind(i) != "id":
                return i
            name_at, k = i, i + 1
            while k < end and s.t(k) not in ("=", ";", ",") and s.line(k) == s.line(name_at):
                k = s.match.get(k, k) + 1 if s.t(k) in OPENERS else k + 1
            if s.t(k) != "=":
                self.out.variables.append(Variable(s.t(name_at), s.line(name_at)))
                if s.t(k) != ",":
                    return k + 1
                i = k + 1
                continue
            f = self._arrow(k + 1, end)
            if f:
                self.function(name_at, s.t(name_at), None, False, name_at, f[1], f[2], is_async=f[3])
                i = f[1] + 1
            else:
                self.out.variables.append(Variable(s.t(name_at), s.line(name_at)))
                z = k + 1
                while z < end and s.t(z) not in (";", ",") and not (z > k + 1 and s.line(z) > s.line(z - 1) and s.t(z) not in (".", "?.", "+", "?", ":", "&&", "||") and s.kind(z - 1) != "op"):
                    z = s.match.get(z, z) + 1 if s.t(z) in OPENERS else z + 1
                self._js_pairs(k + 1, z)
                i = z
            if s.t(i) != ",":
                return i
            i += 1
        return i

    def _js_pairs(self, i: int, end: int) -> None:
        """key: (…) => … within an initializer."""
        s = self.s
        while i < end:
            if s.kind(i) in ("id", "str") and s.t(i + 1) == ":" and s.t(i - 1) in ("{", ","):
                f = self._arrow(i + 2, end)
                if f and s.t(i + 2) not in ("function",):
                    self.function(i, s.t(i), None, False, i, f[1], f[2], is_async=f[3])
                    i = f[1] + 1
                    continue
            i += 1

    # Java

    def java(self, i: int, end: int) -> None:
        s, notes = self.s, []
        while i < end:
            t = s.t(i)
            if t == "import":
                k = i + 1
                while k < end and s.t(k) != ";":
                    k += 1
                self.out.imports.append(Import(s.slice(i + 1 + (s.t(i + 1) == "static"), k - 1), [], None, False, s.line(i)))
                i = k
            elif t.startswith("@") and len(t) > 1 and t != "@interface":
                z = s.pair(i + 1) if s.t(i + 1) == "(" else i
                notes.append(s.slice(i, z))
                i = z
            elif t in ("class", "interface") and s.kind(i + 1) == "id" and s.t(i - 1) != ".":
                b, bases, word = i + 2, [], ""
                while b < end and s.t(b) != "{":
                    if s.t(b) in ("extends", "implements"):
                        word = s.t(b)
                    elif word and s.kind(b) == "id" and s.t(b - 1) in ("extends", "implements", ","):
                        z = b
                        while s.t(z + 1) == "." and s.kind(z + 2) == "id":
                            z += 2
                        bases.append(s.slice(b, z))
                        b = z
                    elif s.t(b) == "<":
                        b = max(b, self._angle(b))
                    b += 1
                z = s.match.get(b, b)
                self.cls(s.t(i + 1), i, z, bases, decorators=notes)
                self._java_members(b + 1, z, s.t(i + 1))
                notes, i = [], z
            elif t in OPENERS:
                i = s.match.get(i, i)
            i += 1

    def _java_members(self, i: int, end: int, cls: str) -> None:
        s, begin, words, notes = self.s, i, [], []
        while i < end:
            t = s.t(i)
            if t.startswith("@") and len(t) > 1:
                z = s.pair(i + 1) if s.t(i + 1) == "(" else i
                notes.append(s.slice(i, z))
                i = z
            elif s.kind(i) == "id" and s.t(i + 1) == "(" and t not in CONTROL and s.t(i - 1) not in ("=", ".", "new"):
                b = self.after_params(s.pair(i + 1))
                if b > 0:
                    z = s.pair(b) if s.t(b) == "{" else b
                    self.function(i, t, cls, True, begin, z, (i + 1, s.pair(i + 1)), is_static="static" in words, decorators=notes)
                    i = z
                begin, words, notes = i + 1, [], []
            elif t in (";", "}"):
                begin, words, notes = i + 1, [], []
            elif t in OPENERS:
                i = s.match.get(i, i)
                if t == "{":
                    begin, words, notes = i + 1, [], []
            elif s.kind(i) == "id":
                words.append(t)
            i += 1

    # Go

    def go(self, i: int, end: int) -> None:
        s = self.s
        while i < end:
            t = s.t(i)
            if t == "import":
                z = s.match.get(i + 1, i + 1) if s.t(i + 1) == "(" else i + 1 + (s.kind(i + 1) != "str")
                for k in range(i + 1, z + 1):
                    if s.kind(k) == "str":
                        alias = s.t(k - 1) if s.kind(k - 1) == "id" and s.t(k - 1) != "import" else None
                        self.out.imports.append(Import(s.t(k).strip('"`'), [], alias, False, s.line(k)))
                i = z
            elif t == "func":
                k, cls = i + 1, None
                if s.t(k) == "(":
                    ids = [s.t(x) for x in range(k + 1, s.pair(k)) if s.kind(x) == "id"]
                    cls = (ids[1] if len(ids) > 1 else ids[0]) if ids else None
                    k = s.pair(k) + 1
                p = k + 1
                if s.t(p) == "[":
                    p = s.pair(p) + 1
                if s.kind(k) == "id" and s.t(p) == "(":
                    b = s.pair(p) + 1
                    while b < end and s.t(b) != "{" and s.line(b) == s.line(s.pair(p)):
                        if s.t(b) in ("interface", "struct") and s.t(b + 1) == "{":
                            b = s.pair(b + 1)
                        elif s.t(b) in ("(", "["):
                            b = s.pair(b)
                        b += 1
                    z = s.match.get(b, b) if s.t(b) == "{" else b - 1
                    self.function(k, s.t(k), cls, False, i, z, (p, s.pair(p)))
                    i = z
            elif t == "type" and s.kind(i + 1) == "id":
                k = i + 2 if s.t(i + 2) != "[" else s.pair(i + 2) + 1
                if s.t(k) == "struct" and s.t(k + 1) == "{":
                    self.cls(s.t(i + 1), i, s.pair(k + 1), [])
                    i = s.pair(k + 1)
            elif t in OPENERS:
                i = s.match.get(i, i)
            i += 1

    # Rust

    def rust(self, i: int, end: int, cls: str | None = None) -> None:
        s = self.s
        while i < end:
            t = s.t(i)
            if t == "#" and s.t(i + 1) == "[":
                i = s.match.get(i + 1, i + 1)
            elif t == "use" and cls is None:
                k = i + 1
                while k < end and s.t(k) != ";":
                    k += 1
                self.out.imports.append(Import(s.slice(i + 1, k - 1), [], None, False, s.line(i)))
                i = k
            elif t in ("struct", "enum", "trait") and s.kind(i + 1) == "id":
                b = i + 2
                while b < end and s.t(b) not in ("{", ";", "("):
                    b += 1
                z = s.match.get(b, b)
                self.cls(s.t(i + 1), i, z, [])
                if t == "trait" and s.t(b) == "{":
                    self.rust(b + 1, z, s.t(i + 1))
                i = z
            elif t == "impl":
                b = i + 1
                b += self._generic(b)
                names: list[str] = []
                while b < end and s.t(b) != "{":
                    if s.t(b) == "for":
                        names = []
                    elif s.t(b) == "<":
                        b = max(b, self._angle(b))
                    elif s.t(b) == "where":
                        while b + 1 < end and s.t(b + 1) != "{":
                            b += 1
                    elif s.kind(b) == "id":
                        names.append(s.t(b))
                    b += 1
                z = s.match.get(b, b)
                self.rust(b + 1, z, names[-1] if names else None)
                i = z
            elif t == "mod" and s.t(i + 2) == "{":
                i = s.pair(i + 2)
            elif t == "fn" and s.kind(i + 1) == "id":
                p = i + 2 + self._generic(i + 2)
                if s.t(p) == "(":
                    b = self.after_params(s.pair(p))
                    if b > 0:
                        z = s.pair(b) if s.t(b) == "{" else b
                        method = any(s.t(x) == "self" for x in range(p + 1, min(p + 6, s.pair(p))))
                        self.function(i + 1, s.t(i + 1), cls, False, i, z, (p, s.pair(p)), is_async=s.t(i - 1) == "async", is_static=bool(cls) and not method)
                        i = z
            elif t in OPENERS:
                i = s.match.get(i, i)
            i += 1

    # C and C++

    def c(self, i: int, end: int) -> None:
        self._c(i, end, None, None)

    def cpp(self, i: int, end: int) -> None:
        self._c(i, end, None, None)

    def _c(self, i: int, end: int, path: str | None, cls: str | None) -> None:
        """Declarations between two tokens: of a file or namespace (cls is None), or of a class body."""
        s, begin, words = self.s, i, []
        while i < end:
            t = s.t(i)
            if s.kind(i) == "pre":
                m = re.match(r'#\s*include\s*[<"]([^>"]+)', t)
                if m:
                    self.out.imports.append(Import(m[1], [], None, False, s.line(i)))
                begin, words = i + 1, []
            elif t == "namespace" and self.family == "cpp":
                b = i + 1
                while b < end and s.t(b) not in ("{", ";", "="):
                    b += 1
                if s.t(b) == "{":
                    name = s.slice(i + 1, b - 1).replace("::", ".") if b > i + 1 else None
                    self._c(b + 1, s.pair(b), ".".join(x for x in (path, name) if x) or None, None)
                    i = s.pair(b)
                begin, words = i + 1, []
            elif t == "extern" and s.kind(i + 1) == "str" and s.t(i + 2) == "{":
                self._c(i + 3, s.pair(i + 2), path, None)
                i = s.pair(i + 2)
                begin, words = i + 1, []
            elif t == "template" and s.t(i + 1) == "<":
                i = max(i + 1, self._angle(i + 1))
            elif t in ("struct", "class", "union", "enum") and "typedef" not in words:
                b = i + 1
                while b < end and s.t(b) not in ("{", ";", "(", "=", ")"):
                    b += 1
                if s.t(b) == "{":
                    z = s.pair(b)
                    if t in (("struct",) if self.family == "c" else ("struct", "class")) and s.kind(i + 1) == "id":
                        bases = []
                        if self.family == "cpp":
                            head = s.slice(i + 1, b - 1)
                            bases = [re.sub(r"\b(public|protected|private|virtual)\b", "", x).strip() for x in head.split(":", 1)[1].split(",")] if re.search(r"(?<!:):(?!:)", head) else []
                        self.cls(s.t(i + 1), i, z, bases, path)
                        if self.family == "cpp":
                            self._c(b + 1, z, path, s.t(i + 1))
                    i = z
                    while i < end and s.t(i) != ";":
                        i += 1
                    begin, words = i + 1, []
                else:
                    words.append(t)
            elif t == "typedef":
                z = i
                while z < end and s.t(z) != ";":
                    z = s.match.get(z, z) + 1 if s.t(z) in OPENERS else z + 1
                ids = [k for k in range(i, z) if s.kind(k) == "id"]
                name = s.t(ids[-1]) if s.kind(z - 1) == "id" else ""
                if name and cls is None:
                    self.cls(name, i, z, [], path)
                i = z
                begin, words = i + 1, []
            elif s.kind(i) == "id" and s.t(i + 1) == "(" and t not in CONTROL and not (words and words[-1] == "="):
                p = i + 1
                b = self._c_body(s.match.get(p, p), end)
                z = s.pair(b) if b > 0 and s.t(b) == "{" else b
                first = self.chain(i)
                scope = s.slice(first, i - 2) if first < i and s.t(i - 1) == "::" else None
                typed = first > begin or cls == t or bool(scope)
                if b > 0 and s.t(b) == "{" and typed:
                    self.function(i, t, scope or cls, cls is not None and not scope, begin, z, (p, s.pair(p)), path, is_static="static" in words)
                elif b > 0 and self.family == "cpp" and cls is not None and typed:
                    self.function(i, t, cls, True, begin, z, (p, s.pair(p)), path, is_static="static" in words)
                if b > 0:
                    i = z
                else:
                    i = s.match.get(p, p)
                    words.append("=")
                    i += 1
                    continue
                begin, words = i + 1, []
            elif t in (";", "}"):
                names = [w for w in words if w.isidentifier()]
                if cls is None and t == ";" and len(names) >= 2 and "using" not in names:
                    stop = words.index("=") if "=" in words else len(words)
                    own = [w for w in words[:stop] if w.isidentifier()]
                    if own:
                        self.out.variables.append(Variable(own[-1], s.line(begin)))
                begin, words = i + 1, []
            elif t == ":" and cls is not None:
                begin, words = i + 1, []
            elif t in OPENERS:
                i = s.match.get(i, i)
            elif s.kind(i) == "id" or t == "=":
                words.append(t)
            i += 1

    def _c_body(self, close: int, end: int) -> int:
        """The { or ; of what may be a function behind its parameters; 0 if it is none."""
        s, k = self.s, close + 1
        while k < end:
            t = s.t(k)
            if t in ("{", ";"):
                return k
            if t == ":" and self.family == "cpp":  # initializers
                while True:
                    k += 1
                    while k < end and s.t(k) not in ("(", "{", ";"):
                        k += 1
                    k = s.match.get(k, k) + 1
                    if s.t(k) != ",":
                        break
                continue
            if s.kind(k) == "id" or t in ("->", "::", "&", "*", "<", ">", "=", "..."):
                k += 1
            elif t in ("(", "["):
                k = s.match.get(k, k) + 1
            elif s.kind(k) == "num":
                k += 1
            else:
                return 0
        return 0


OPENERS = ("(", "[", "{")


def parse(text: str, module: str, language: str) -> Module:
    return Scanner(text, module, language).parse()
