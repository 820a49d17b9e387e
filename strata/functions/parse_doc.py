"""One JSON, YAML or Markdown text to node rows with byte spans.

A row: ord, parent, depth, position, key, path, kind, span_start, span_end,
entry_start, start_line, end_line, summary, n_children, n_desc, text, and the keys
and positions of the way down to the node; then what a slice shows: the text
from the line's start, without and with the key, and the line of the key.
Nodes are numbered in document order; ``text`` is the exact span.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from strata.functions.parse_code import collapse


class DocError(ValueError):
    pass


@dataclass
class Node:
    key: str
    path: str
    kind: str
    start: int  # of the value, in code points until rows() converts
    end: int
    entry: int
    children: list[Node] = field(default_factory=list)
    summary: str | None = None
    body: int | None = None


def preview(text: str, limit: int) -> str:
    line = collapse(text)
    return line if len(line) <= limit else line[:max(0, limit - 3)] + "..."


def summarise(kind: str, text: str, count: int) -> str:
    if kind == "mapping":
        return "{%d %s}" % (count, "key" if count == 1 else "keys")
    if kind == "sequence":
        return "[%d %s]" % (count, "item" if count == 1 else "items")
    return preview(text, 48)


# ---- JSON -------------------------------------------------------------------

_JSON = re.compile(r'[ \t\r\n]+|//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"/]+', re.DOTALL)


class _Json:
    """A scanner that keeps positions and skips comments."""

    def __init__(self, text: str):
        self.tokens = []
        at = 0
        while at < len(text):
            match = _JSON.match(text, at)
            if match is None:
                raise DocError(f"cannot read json at {at}")
            at = match.end()
            token = match[0]
            if not token[0].isspace() and not token.startswith(("//", "/*")):
                self.tokens.append((token, match.start(), at))
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self) -> tuple[str, int, int]:
        if self.at >= len(self.tokens):
            raise DocError("the json text ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def value(self, path: str) -> tuple[str, int, int, list[Node]]:
        """Kind, span and children; nesting uses a stack, so depth is free."""
        token, start, end = self.take()
        if token not in "{[" or len(token) != 1:
            if token in ("}", "]", ",", ":"):
                raise DocError(f"unexpected {token} in json")
            return "scalar", start, end, []
        stack = [("mapping" if token == "{" else "sequence", start, path, [], None)]
        done = None
        while stack:
            kind, start, path, children, _ = stack[-1]
            token = self.peek()
            if token in ("}", "]") and len(token) == 1:
                end = self.take()[2]
                stack.pop()
                done = (kind, start, end, children)
                if stack:
                    holder = stack[-1]
                    key, entry, own = holder[4]
                    holder[3].append(Node(key, own, kind, start, end, entry, children))
                continue
            if token == ",":
                self.take()
                continue
            if kind == "mapping":
                raw, entry, _ = self.take()
                if self.take()[0] != ":":
                    raise DocError("a json key needs a colon")
                key = raw.strip('"')
                own = f"{path}.{key}" if path else key
            else:
                key, entry = str(len(children)), self.tokens[self.at][1] if self.at < len(self.tokens) else 0
                own = f"{path}[{len(children)}]"
            token, start, end = self.take()
            if token in ("{", "["):
                stack[-1] = (*stack[-1][:4], (key, entry, own))
                stack.append(("mapping" if token == "{" else "sequence", start, own, [], None))
            elif token in ("}", "]", ",", ":"):
                raise DocError(f"unexpected {token} in json")
            else:
                children.append(Node(key, own, "scalar", start, end, entry))
        return done


def parse_json(text: str) -> list[Node]:
    scanner = _Json(text)
    if not scanner.tokens:
        return []
    return scanner.value("")[3]


# ---- YAML -------------------------------------------------------------------

def parse_yaml(text: str) -> list[Node]:
    """The first document; an anchored, tagged or aliased node is a scalar."""
    import yaml

    try:
        root = next(iter(yaml.compose_all(text, Loader=yaml.SafeLoader)), None)
    except yaml.YAMLError as error:
        raise DocError(str(error)) from error
    if root is None:
        return []
    anchored = {id(root)} if _marked(text, root) else set()
    return [] if anchored else _yaml_children(text, root, "")


def _marked(text: str, node) -> bool:
    """Does an anchor or a tag stand before the node's own text?"""
    return text[node.start_mark.index:node.start_mark.index + 1] in ("&", "!", "*")


def _yaml_end(text: str, node) -> int:
    """A block collection's mark runs past blank lines and comments after it."""
    import yaml

    if isinstance(node, yaml.ScalarNode):
        return node.end_mark.index if node.style not in ("|", ">") else len(text[:node.end_mark.index].rstrip())
    if node.flow_style:
        return node.end_mark.index
    last = node.value[-1:]
    if not last:
        return node.end_mark.index
    tail = last[0][1] if isinstance(node, yaml.MappingNode) else last[0]
    if isinstance(tail, yaml.ScalarNode) and tail.start_mark.index == tail.end_mark.index:
        low = last[0][0].end_mark.index if isinstance(node, yaml.MappingNode) else node.start_mark.index
        return _null_end(text, low)
    return _yaml_end(text, tail)


def _null_end(text: str, at: int) -> int:
    """The end of ``key:`` or ``-`` that has no value."""
    match = re.compile(r"\s*[:\-]").match(text, at)
    return match.end() if match else at


def _yaml_children(text: str, node, path: str) -> list[Node]:
    import yaml

    out = []
    if isinstance(node, yaml.MappingNode):
        for key_node, value in node.value:
            key = text[key_node.start_mark.index:key_node.end_mark.index].strip().strip("\"'")
            entry = key_node.start_mark.index
            out.append(_yaml_node(text, key, f"{path}.{key}" if path else key, value, entry, key_node.end_mark.index))
    elif isinstance(node, yaml.SequenceNode):
        for number, value in enumerate(node.value):
            entry = value.start_mark.index
            if not node.flow_style:
                entry = max(0, text.rfind("-", 0, entry + 1))
            out.append(_yaml_node(text, str(number), f"{path}[{number}]", value, entry, entry))
    return out


def _yaml_node(text: str, key: str, path: str, value, entry: int, after: int) -> Node:
    import yaml

    start = value.start_mark.index
    if start < after or (isinstance(value, yaml.ScalarNode) and start == value.end_mark.index):
        if start < after:  # an alias: its node stands elsewhere
            match = re.compile(r"[\s:\-]*(\*\S+)").match(text, after)
            if match:
                return Node(key, path, "scalar", match.start(1), match.end(1), entry)
        return Node(key, path, "scalar", entry, _null_end(text, after), entry, [], "~")
    if _marked(text, value):
        return Node(key, path, "scalar", start, _yaml_end(text, value), entry)
    kind = "mapping" if isinstance(value, yaml.MappingNode) else "sequence" if isinstance(value, yaml.SequenceNode) else "scalar"
    return Node(key, path, kind, start, _yaml_end(text, value), entry, _yaml_children(text, value, path))


# ---- Markdown ---------------------------------------------------------------

_HEADING = re.compile(r"(#{1,6})(?:(?: (.*))|$)")


def headings(text: str) -> list[tuple[int, str, int, int]]:
    """(level, title, start, end of line) outside fences."""
    out, fenced, at = [], False, 0
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        body = line.rstrip("\r").lstrip()
        if body.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        match = None if fenced else _HEADING.fullmatch(body)
        if match:
            out.append((len(match[1]), (match[2] or "").strip().rstrip("#").strip(), start, min(at, len(text))))
    return out


def parse_markdown(text: str) -> list[Node]:
    """A section runs to the next heading of its level or a higher one; a
    heading belongs to the nearest open section of a lower level."""
    found, roots = headings(text), []
    ends, open_ends = [len(text)] * len(found), []
    for k, (level, _, start, _) in enumerate(found):
        while open_ends and found[open_ends[-1]][0] >= level:
            ends[open_ends.pop()] = start
        open_ends.append(k)
    stack: list[tuple[int, Node]] = []
    for (level, title, start, body), end in zip(found, ends, strict=True):
        while stack and stack[-1][0] >= level:
            stack.pop()
        parent = stack[-1][1] if stack else None
        path = f"{parent.path}/{title}" if parent and parent.path else title
        node = Node(title, path, "section", start, end, start, [], f"h{level} — {preview(text[body:max(end, body)], 40)}", body)
        (parent.children if parent else roots).append(node)
        stack.append((level, node))
    return roots


# ---- rows -------------------------------------------------------------------

PARSERS = {"json": parse_json, "yaml": parse_yaml, "markdown": parse_markdown}


def line_starts(data: bytes) -> list[int]:
    starts = [0, *(m.end() for m in re.finditer(b"\n", data))]
    if len(starts) > 1 and starts[-1] == len(data):
        starts.pop()
    return starts


def parse_doc(kind: str, text: str) -> tuple[int, list[tuple]]:
    """Lines of the text, and its node rows."""
    lines, _, rows = doc_rows(kind, text)
    return lines, list(rows)


def doc_rows(kind: str, text: str) -> tuple[int, int, Iterator[tuple]]:
    """Lines of the text, the number of its nodes, and their rows one by one."""
    data = text.encode()
    starts = line_starts(data)
    roots = PARSERS[kind](text)
    widths = None
    if len(data) != len(text):
        widths = [0]
        for c in text:
            widths.append(widths[-1] + len(c.encode()))
    byte = (lambda i: widths[i]) if widths else (lambda i: i)
    below: dict[int, int] = {}

    def line_of(at: int) -> int:
        return max(1, bisect_right(starts, at))

    def shown(at: int, end: int) -> str:
        first = starts[line_of(at) - 1]
        return data[at if data[first:at].decode().strip() else first:end].decode().rstrip()

    def count(nodes: list[Node]) -> int:
        """Nodes of a forest; those below each node are kept for its row."""
        order = list(nodes)
        for node in order:
            order += node.children
        for node in reversed(order):
            below[id(node)] = sum(1 + below[id(child)] for child in node.children)
        return len(order)

    def rows() -> Iterator[tuple]:
        number = 0
        stack = [(node, None, 1, position, (), ()) for position, node in reversed(list(enumerate(roots)))]
        while stack:
            node, parent, depth, position, above, ahead = stack.pop()
            start, end = byte(node.start), byte(node.end)
            steps, places = [*above, node.key], [*ahead, position]
            last = max(end - 1, 0)
            end_line = max(1, bisect_left(starts, end)) if kind == "markdown" else max(1, bisect_right(starts, last))
            summary = node.summary if node.summary is not None else summarise(node.kind, text[node.start:node.end], len(node.children))
            yield (number, parent, depth, position, node.key, node.path, node.kind, start, end, byte(node.entry),
                   max(1, bisect_right(starts, start)), end_line, summary, len(node.children), below[id(node)],
                   data[start:end].decode(), steps, places,
                   shown(start, end), shown(byte(node.entry), end), line_of(byte(node.entry)))
            stack += [(child, number, depth + 1, k, steps, places) for k, child in reversed(list(enumerate(node.children)))]
            number += 1

    return len(starts), count(roots), rows()
