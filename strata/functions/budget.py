"""Reports that fit a budget by saying less, never by cutting.

A report is a list of parts, each with the levels of detail at which it shows.
The level is the first whose layout costs no more than the budget, or the
tersest one if none does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

DEFAULT = 4000
LADDER = ("full", "summary", "counts")


def estimate_tokens(text: str) -> int:
    units = len(re.findall(r"\w+|[^\w\s]", text))
    return max(units, -(-len(text) // 4))


@dataclass(frozen=True)
class Part:
    """Lines that belong together; ``at``: initials of the levels that show them.

    A blank line sets a part off from what is above it, unless it is ``near``.
    """

    at: str
    lines: list[str]
    near: bool = False


def lay_out(parts: list[Part], level: str) -> str:
    text = ""
    for part in parts:
        if part.lines and level[0] in part.at:
            apart = text and not part.near and not text.endswith("\n\n") and text != "\n"
            text += ("\n" if apart else "") + "\n".join(part.lines) + "\n"
    body = text.rstrip("\n")
    return body + "\n" if body else ""


def within(budget: int, parts: list[Part]) -> tuple[str, str]:
    """The layout that is taken, and its level."""
    layouts = {level: lay_out(parts, level) for level in LADDER}
    level = next((level for level, text in layouts.items() if estimate_tokens(text) <= budget), LADDER[-1])
    return layouts[level], level


def commas(n: int) -> str:
    return f"{n:,}"


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def pad(text: str, width: int) -> str:
    return text.ljust(width)


def widest(texts, most: int) -> int:
    return min(most, max((len(t) for t in texts), default=0))


def shown(some: int, all_: int, more: str) -> list[str]:
    return [] if some >= all_ else [f"showing {commas(some)} of {commas(all_)} — {more}"]
