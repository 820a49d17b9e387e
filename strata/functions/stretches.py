"""A long Python text in stretches that parse alone.

A place is safe if what stands before it parses and what follows begins a
statement: no string, bracket, decorator or block is open there, so both parts
have the statements that the whole text has.  A text without such a place, or
with a line that does not parse, goes on as one stretch to its end.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator

#: Characters of a stretch, at least, if the text has as many.
STRETCH = 1 << 17
_PLACE = re.compile(r"\n(?!(?:else|elif|except|finally)\b)(?=[^\s#)\]}\\][^\n]*\n)")


def last_place(text: str) -> int:
    """Where the last statement may begin that is not the first, or 0."""
    step, found = 1 << 12, None
    while True:
        low = max(0, len(text) - step)
        for found in _PLACE.finditer(text, low):
            pass
        if found or not low:
            return found.end() if found else 0
        step *= 8


def tree_before(text: str) -> tuple[int, ast.Module | None]:
    """The last place of a text and the tree of what stands before it, if that parses."""
    place = last_place(text)
    if place:
        try:
            return place, ast.parse(text[:place])
        except (SyntaxError, ValueError, RecursionError):
            pass
    return place, None


def stretches(pieces: Iterable[str], least: int = STRETCH, before: Callable[[str], tuple] = tree_before) -> Iterator[tuple[str, ast.Module | None, bool]]:
    """(text, its tree, whether it is the last); the last is not parsed yet, as
    it may be refused.  The pieces may be cut anywhere.  ``before`` may give
    something else in the place of the tree."""
    held: list[str] = []
    size, wanted = 0, least
    for piece in pieces:
        for low in range(0, len(piece), least):
            part = piece[low:low + least]
            held.append(part)
            size += len(part)
            if size < wanted:
                continue
            text = "".join(held)
            place, tree = before(text)
            if tree is None:  # tried again at twice the size, so all trials cost twice the last
                held, wanted = [text], 2 * size
                continue
            yield text[:place], tree, False
            held, size, wanted = [text[place:]], len(text) - place, least
    yield "".join(held), None, True


class Exports:
    """Names between the first ``__all__``'s brackets, as ``exprs.exports`` has
    them, of a text that comes in pieces."""

    MARK = "__all__"

    def __init__(self):
        self.tail, self.seen, self.done = "", False, False

    def add(self, text: str) -> None:
        if self.done:
            return
        self.tail += text
        if not self.seen:
            at = self.tail.find(self.MARK)
            self.seen = at >= 0
            self.tail = self.tail[at:] if self.seen else self.tail[1 - len(self.MARK):]
        if self.seen:
            low = self.tail.find("[")
            self.done = low >= 0 and "]" in self.tail[low:]

    def names(self) -> list[str]:
        if not self.done:
            return []
        body = self.tail[self.tail.find("[") + 1:].split("]", 1)[0]
        names = (re.sub("^[\"']+|[\"']+$", "", _SPACE.sub(" ", n).strip(" ")) for n in body.split(","))
        return sorted({n for n in names if n}, key=lambda n: n.encode())


#: ``[\s\p{Z}]+`` of the JVM.
_SPACE = re.compile("[ \t\n\v\f\r" + "".join(map(chr, (
    0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")
