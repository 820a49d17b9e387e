"""Addresses: ``path#selector`` for code and for documents.

A code selector is empty (outline), ``L3`` or ``L3-L9`` (lines), or a dotted
symbol path.  A document selector is a path of keys and positions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


_BAD_SPAN = "bad line span `{}`: expected `L<start>-L<end>`"


class AddressError(ValueError):
    """An address that cannot be read; commands end with exit code 2."""


@dataclass(frozen=True)
class Address:
    path: str
    kind: str  # outline, symbol, lines
    parts: tuple[str, ...] = ()
    first: int = 0
    last: int = 0

    @property
    def dotted(self) -> str:
        return ".".join(self.parts)

    def __str__(self) -> str:
        if self.kind == "symbol":
            return f"{self.path}#{self.dotted}"
        if self.kind == "lines":
            return f"{self.path}#{line_span(self.first, self.last)}"
        return f"{self.path}#"


@dataclass(frozen=True)
class DocAddress:
    path: str
    format: str
    steps: tuple[tuple[str, str | int], ...] = field(default=())  # ("key", name) or ("index", n)
    raw: str = ""

    def __str__(self) -> str:
        return f"{self.path}#{self.raw}"


def line_span(first: int, last: int) -> str:
    return f"L{first}" if first == last else f"L{first}-L{last}"


def slash_path(path: str) -> str:
    """Forward slashes, without one leading ``./``; nothing left is ``.``."""
    path = path.replace("\\", "/")
    path = path[2:] if path.startswith("./") else path
    return path or "."


def _halves(raw: str) -> tuple[str, str]:
    path, mark, selector = raw.partition("#")
    if not mark:
        raise AddressError(f"address `{raw}` has no `#`: use `{raw}#Symbol`, or `{raw}#` for the outline")
    if not path:
        raise AddressError(f"address `{raw}` has no file part: bare-name lookup is not supported yet")
    return path, selector


def parse_address(raw: str) -> Address:
    path, selector = _halves(raw)
    if not selector:
        return Address(path, "outline")
    if re.match(r"L[0-9]", selector):
        match = re.fullmatch(r"L([0-9]+)(?:-L?([0-9]+))?", selector)
        if match is None:
            raise AddressError(_BAD_SPAN.format(raw))
        first = int(match[1])
        last = int(match[2]) if match[2] else first
        if not first or last < first:
            raise AddressError(_BAD_SPAN.format(raw))
        return Address(path, "lines", (), first, last)
    parts = tuple(selector.split("."))
    if not all(parts):
        raise AddressError(f"address `{raw}` has no file part: bare-name lookup is not supported yet")
    return Address(path, "symbol", parts)


DOC_FORMATS = {"json": "json", "jsonc": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "markdown": "markdown"}


def doc_format(path: str) -> str | None:
    """The format by extension, in any case."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, extension = name.rpartition(".")
    return DOC_FORMATS.get(extension.lower()) if dot and stem else None


def parse_doc_address(raw: str) -> DocAddress:
    path, selector = _halves(raw)
    kind = doc_format(path)
    if kind is None:
        raise AddressError(f"unsupported format for `{path}`: only json, yaml and markdown documents are read")
    if kind == "markdown":
        steps = [("key", part.strip()) for part in selector.split("/") if part]
    else:
        steps = []
        for bracket, key in re.findall(r"\[([^\]]*)\]?|([^.\[]+)", selector):
            if key:
                steps.append(("key", key))
                continue
            inner = bracket.strip().strip("\"'")
            steps.append(("index", int(inner)) if re.fullmatch(r"\+?[0-9]+", inner) else ("key", inner))
    return DocAddress(path, kind, tuple(steps), selector)
