"""Front-ends by language. A class that derives from Frontend and names its language is registered, and its extensions are discovered from then on."""

from __future__ import annotations

from graphloom.frontends import braces, python
from graphloom.frontends.model import Module
from graphloom.functions.paths import ALIASES, EXTENSIONS

FRONTENDS: dict[str, Frontend] = {}


class Frontend:
    """parse() gives a file's findings; it runs in Python workers, so a user's class must be importable there, or defined in the main script."""

    language: str = ""
    extensions: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()

    def __init_subclass__(cls, **kwargs: object) -> None:
        super().__init_subclass__(**kwargs)
        if cls.language:
            FRONTENDS[cls.language] = cls()
            EXTENSIONS.update({e.lstrip("."): cls.language for e in cls.extensions})
            ALIASES.update({a: cls.language for a in (cls.language, *cls.aliases)})

    def parse(self, text: str, module: str, language: str) -> Module:
        raise NotImplementedError


class Python(Frontend):
    language = "python"

    def parse(self, text: str, module: str, language: str) -> Module:
        return python.parse(text, module)


class Braces(Frontend):
    """The languages that one tokenizer serves."""

    def parse(self, text: str, module: str, language: str) -> Module:
        return braces.parse(text, module, language)


FRONTENDS.update({x: Braces() for x in ("javascript", "typescript", "java", "go", "rust", "c", "cpp")})
