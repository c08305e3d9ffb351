"""One tokenizer for the brace languages: comments dropped, strings as one token, brackets matched."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, num, str, op
    text: str
    at: int
    line: int


_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"""
    r"""|(?P<id>[A-Za-z_$\u0080-\U0010ffff#@][\w$\u0080-\U0010ffff]*)|(?P<num>\d[\w.]*)|(?P<op>=>|::|->|\?\.|\?\?|&&|\|\||\.\.\.|<<=?|>=|<=|==|!=|[^\s\w])""",
    re.S,
)
OPEN, CLOSE = "([{", ")]}"


class Source:
    """Tokens of a text; match gives the place of a bracket's partner."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.tokens: list[Token] = []
        line, pos = 1, 0
        while pos < len(text):
            if language in ("c", "cpp") and text[pos] == "#" and not text[:pos].rpartition("\n")[2].strip():
                end = pos
                while end < len(text) and (text[end] != "\n" or text[end - 1] == "\\"):
                    end += 1
                self.tokens.append(Token("pre", text[pos:end], pos, line))
                line += text.count("\n", pos, end)
                pos = end
                continue
            if language == "rust" and text[pos] == "'" and (m := re.compile(r"'[A-Za-z_]\w*(?!')").match(text, pos)):
                pos = m.end()  # a lifetime
                continue
            if language == "javascript" and text[pos] == "/" and text[pos + 1 : pos + 2] not in ("/", "*") and self._regex_here():
                m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/\w*").match(text, pos)
                if m:
                    self.tokens.append(Token("str", m[0], pos, line))
                    pos = m.end()
                    continue
            m = _TOKEN.match(text, pos)
            if not m:
                pos += 1
                continue
            kind = m.lastgroup or ""
            if kind not in ("space", "comment"):
                self.tokens.append(Token(kind, m[0], pos, line))
            line += m[0].count("\n")
            pos = m.end()
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in CLOSE:
                while stack:
                    o = stack.pop()
                    if OPEN.index(self.tokens[o].text) == CLOSE.index(t.text):
                        self.match[o], self.match[i] = i, o
                        break
        for o in stack:  # never closed: to the end
            self.match[o] = len(self.tokens) - 1

    def _regex_here(self) -> bool:
        if not self.tokens:
            return True
        t = self.tokens[-1]
        return t.text in ("return", "typeof", "case") or (t.kind == "op" and t.text not in (")", "]", "}"))

    def __len__(self) -> int:
        return len(self.tokens)

    def pair(self, i: int) -> int:
        """The partner of a bracket, itself if it is none."""
        return self.match.get(i, i)

    def t(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def line(self, i: int) -> int:
        return self.tokens[min(i, len(self.tokens) - 1)].line if self.tokens else 1

    def slice(self, i: int, j: int) -> str:
        """The text from token i to token j; nothing if there is none."""
        j = min(j, len(self.tokens) - 1)
        if not 0 <= i <= j:
            return ""
        return self.text[self.tokens[i].at : self.tokens[j].at + len(self.tokens[j].text)]
