"""One Python source text to rows: symbols, calls, imports, names, texts, literals.

Structure comes from ``ast``, whose columns are UTF-8 bytes; names, comments and
string pieces come from ``tokenize``, whose columns are converted.  All offsets
are bytes and all lines are counted by newline, from 1.  A text that does not
parse is read without the lines that ``ast`` refuses (``recovered``); their calls
come from the tokens.  If that does not help either, its definitions are those
that its ``def`` and ``class`` lines show.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

RECEIVERS = ("self", "cls")
#: Characters that make a raw string a pattern, and modules whose
#: calls take one.
REGEX_META = set("^$[](){}\\|+*?")
REGEX_MODULES = ("re.", "regex.")


def collapse(text: str) -> str:
    return " ".join(text.split())


@dataclass
class Source:
    text: str
    data: bytes = field(init=False)
    starts: list[int] = field(init=False)
    _ast_starts: list[int] = field(init=False)

    def __post_init__(self):
        self.data = self.text.encode()
        self.starts = [0, *(m.end() for m in re.finditer(b"\n", self.data))]
        if len(self.starts) > 1 and self.starts[-1] == len(self.data):
            self.starts.pop()
        self._ast_starts = [0, *(m.end() for m in re.finditer(b"\r\n|\r|\n", self.data))]

    @property
    def lines(self) -> int:
        return len(self.starts)

    def line_of(self, byte: int) -> int:
        return max(1, bisect_right(self.starts, byte))

    def at(self, line: int, column: int) -> int:
        end = self._ast_starts[line] if line < len(self._ast_starts) else len(self.data)
        return min(self._ast_starts[line - 1] + column, end)  # a line may have been read with more

    def start(self, node: ast.AST) -> int:
        return self.at(node.lineno, node.col_offset)

    def end(self, node: ast.AST) -> int:
        return self.at(node.end_lineno, node.end_col_offset)

    def cut(self, start: int, end: int) -> str:
        return self.data[start:end].decode(errors="replace")

    def snap(self, byte: int) -> int:
        """The start of the line if only white space stands before the byte."""
        first = self.starts[self.line_of(byte) - 1]
        return first if not self.cut(first, byte).strip() else byte


@dataclass
class Symbol:
    name: str
    kind: str
    dotted: str
    depth: int
    parent: int | None
    span: tuple[int, int]
    def_start: int
    sig_end: int
    decorators: list[str]
    params: list[str]
    required: int
    max_args: int | None
    type_names: list[str]
    descendants: int = 0
    last: int = 0  # number of the last symbol below


class _Symbols:
    def __init__(self, source: Source):
        self.source, self.rows = source, []

    def body(self, statements: list[ast.stmt], prefix: str, parent: int | None, depth: int, names: bool) -> None:
        for node in statements:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.definition(node, prefix, parent, depth)
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                if names and isinstance(target, ast.Name) and self.source.start(target) == self.source.start(node):
                    self.constant(node, target.id, prefix, parent, depth)
            else:
                for block in blocks_of(node):
                    self.body(block, prefix, parent, depth, names)

    def push(self, symbol: Symbol) -> int:
        self.rows.append(symbol)
        return len(self.rows) - 1

    def constant(self, node: ast.stmt, name: str, prefix: str, parent: int | None, depth: int) -> None:
        if name.startswith("_") or not re.fullmatch(r"[A-Z0-9_]+", name):
            return
        span = self.source.snap(self.source.start(node)), self.source.end(node)
        number = self.push(Symbol(name, "variable", join(prefix, name), depth, parent, span, span[0], span[1], [], [], 0, 0, []))
        self.rows[number].last = number

    def definition(self, node, prefix: str, parent: int | None, depth: int) -> None:
        source, is_class = self.source, isinstance(node, ast.ClassDef)
        start, end = source.start(node), source.end(node)
        outer, decorators = start, []
        for k, item in enumerate(node.decorator_list):
            at = source.data.rfind(b"@", 0, source.start(item))
            decorators.append(collapse(source.cut(at, source.end(item))))
            outer = at if k == 0 else outer
        first = node.body[0]
        body = source.start(first)
        if getattr(first, "decorator_list", None):
            body = source.data.rfind(b"@", 0, source.start(first.decorator_list[0]))
        sig_end = start + len(source.cut(start, body).rstrip().encode())
        params, required, most, types = ([], 0, 0, []) if is_class else self.signature(node, prefix)
        number = self.push(Symbol(
            node.name, "class" if is_class else "function", join(prefix, node.name), depth, parent,
            (source.snap(outer), end), start, sig_end, decorators, params, required, most, types))
        self.body(node.body, join(prefix, node.name), number, depth + 1, is_class)
        self.rows[number].last = len(self.rows) - 1
        self.rows[number].descendants = len(self.rows) - 1 - number

    def signature(self, node, prefix: str) -> tuple[list[str], int, int | None, list[str]]:
        """A typed ``*args`` or ``**kw`` counts as one required argument, as any
        parameter without a default does; a bare ``*args`` takes any number."""
        a, types = node.args, set()
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        rows = [(p.arg, p, d is not None, "") for p, d in zip(plain, defaults, strict=True)]
        if a.vararg:
            rows.append((a.vararg.arg, a.vararg, False, "*"))
        rows += [(p.arg, p, d is not None, "") for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        if a.kwarg:
            rows.append((a.kwarg.arg, a.kwarg, False, "**"))
        required = positional = 0
        unbounded, params = False, []
        for k, (name, argument, has_default, stars) in enumerate(rows):
            params.append(stars + name)
            if argument.annotation is not None:
                types |= identifiers(argument.annotation)
            if k == 0 and prefix and not stars and name in RECEIVERS:
                continue
            if stars and argument.annotation is None:
                unbounded = unbounded or stars == "*"
                continue
            positional += 1
            required += not has_default
        if node.returns is not None:
            types |= identifiers(node.returns)
        return params, required, None if unbounded else positional, sorted(types)


def join(prefix: str, name: str) -> str:
    return f"{prefix}.{name}" if prefix else name


def identifiers(node: ast.AST) -> set[str]:
    out = set()
    for inner in ast.walk(node):
        if isinstance(inner, ast.Name):
            out.add(inner.id)
        elif isinstance(inner, ast.Attribute):
            out.add(inner.attr)
        elif isinstance(inner, ast.keyword) and inner.arg:
            out.add(inner.arg)
    return out


def blocks_of(node: ast.stmt) -> list[list[ast.stmt]]:
    """The blocks of a statement through which definitions count."""
    if isinstance(node, ast.Match):
        return [case.body for case in node.cases]
    out = []
    if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar)):
        out.append(node.body)
        out += [handler.body for handler in getattr(node, "handlers", [])]
        out += [block for name in ("orelse", "finalbody") if (block := getattr(node, name, None))]
    return out


#: Lines that are given up before a text counts as hopeless.
MOST_REFUSED = 200
_HEAD = re.compile(rb"([ \t]*)((?:async[ \t]+)?def|class)[ \t]+((?:[^\W\d]|[\x80-\xff])[\w\x80-\xff]*)")


def recovered(text: str) -> tuple[ast.Module | None, str, list[tuple[int, int]]]:
    """The tree of a text without the lines that are refused, that text, and the
    bytes of these lines.

    Lines keep their number.  A block without a body gets one.  A refused line
    that begins a definition keeps its name, the head of another block becomes
    ``if 1:``, any other ``pass``; if it is refused again it becomes empty, and
    then the line before it is tried.
    """
    lines = text.encode().split(b"\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    tried: dict[int, int] = {}
    for _ in range(MOST_REFUSED):
        now = b"\n".join(lines).decode()
        try:
            return ast.parse(now), now, [(starts[k], starts[k + 1] - 1) for k in sorted(tried)]
        except SyntaxError as error:
            bare = re.search(r"expected an indented block after .* on line (\d+)", error.msg or "")
            if bare and not lines[int(bare[1]) - 1].endswith(b" pass"):
                lines[int(bare[1]) - 1] = lines[int(bare[1]) - 1].rstrip() + b" pass"
                continue
            k = min(max(error.lineno or 1, 1), len(lines)) - 1
            while k >= 0 and (tried.get(k) == 2 or not lines[k].strip()):
                k -= 1
            if k < 0:
                break
            line, head = lines[k].rstrip(), _HEAD.match(lines[k])
            indent = line[:len(line) - len(line.lstrip())]
            if k in tried:
                lines[k] = b""
            elif head:
                lines[k] = head[0] + (b":" if head[2] == b"class" else b"():")
            else:
                lines[k] = indent + (b"if 1:" if line.endswith(b":") else b"pass")
            tried[k] = tried.get(k, 0) + 1
        except (ValueError, RecursionError):
            break
    return None, text, []


def calls_by_tokens(source: Source, tokens, spans: list[tuple[int, int]]) -> list[tuple[str, str | None, str, int, int]]:
    """Calls in some bytes of a text: a name and an opening bracket."""
    out = []
    for k, (kind, word, start, end) in enumerate(tokens[:-1]):
        if (kind != tokenize.NAME or keyword.iskeyword(word) or tokens[k + 1][1] != "(" or not any(a <= start < b for a, b in spans)
                or (k and tokens[k - 1][1] in ("def", "class"))):
            continue
        first = k
        while first >= 2 and tokens[first - 1][1] == "." and tokens[first - 2][0] == tokenize.NAME:
            first -= 2
        depth = commas = 0
        for j in range(k + 1, len(tokens)):
            depth += (tokens[j][1] in "([{" and tokens[j][1] != "") - (tokens[j][1] in ")]}" and tokens[j][1] != "")
            if not depth:
                break
            commas += depth == 1 and tokens[j][1] == ","
        empty = tokens[min(k + 2, len(tokens) - 1)][1] == ")"
        begin = tokens[first][2]
        out.append((word, collapse(source.cut(begin, tokens[k - 2][3])) if first < k else None, collapse(source.cut(begin, end)),
                    0 if empty else commas + (tokens[j - 1][1] != ","), begin))
    return out


def by_lines(source: Source) -> list[Symbol]:
    """Definitions of a text that does not parse, by its lines and indents."""
    rows: list[Symbol] = []
    open_blocks: list[tuple[int, int]] = []  # indent, number
    pattern = re.compile(r"([ \t]*)((?:async[ \t]+)?def|class)[ \t]+([^\W\d]\w*)")
    for k, begin in enumerate(source.starts):
        end = source.starts[k + 1] if k + 1 < len(source.starts) else len(source.data)
        line = source.cut(begin, end)
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        while open_blocks and open_blocks[-1][0] >= indent:
            open_blocks.pop()
        stop = begin + len(line.rstrip().encode())
        for _, number in open_blocks:
            rows[number].span = (rows[number].span[0], stop)
        match = pattern.match(line)
        if match:
            parent = open_blocks[-1][1] if open_blocks else None
            dotted = join(rows[parent].dotted if parent is not None else "", match[3])
            start = begin + len(match[1].encode())
            rows.append(Symbol(match[3], "class" if match[2] == "class" else "function", dotted, len(open_blocks) + 1,
                               parent, (begin, stop), start, stop, [], [], 0, 0 if match[2] == "class" else None, []))
            open_blocks.append((indent, len(rows) - 1))
    for number in range(len(rows) - 1, -1, -1):
        row = rows[number]
        row.last = max(row.last, number)
        row.descendants = row.last - number
        if row.parent is not None:
            rows[row.parent].last = max(rows[row.parent].last, row.last)
    return rows


def tokens_of(source: Source, text: str | None = None) -> tuple[list[tuple[int, str, int, int]], bool]:
    """(type, string, start, end) with byte offsets, and whether these are all: a
    broken text gives those before the break.  ``text``: with other lines in the
    place of some."""
    text = source.text if text is None else text
    out, lines = [], text.split("\n")
    ascii_only = source.text.isascii()
    starts = [0]
    for line in source.text.split("\n"):
        starts.append(starts[-1] + len(line if ascii_only else line.encode()) + 1)

    def place(row: int, column: int) -> int:
        if row > len(lines):
            return len(source.data)
        return starts[row - 1] + (column if ascii_only else len(lines[row - 1][:column].encode()))

    rows = len(lines) if ascii_only else 0
    try:
        for kind, word, (row, column), (last, end), _ in tokenize.generate_tokens(io.StringIO(text).readline):
            if last <= rows:
                out.append((kind, word, starts[row - 1] + column, starts[last - 1] + end))
            else:
                out.append((kind, word, place(row, column), place(last, end)))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return out, False
    return out, True


class Enclosing:
    """The innermost symbol over a byte, spans half open."""

    def __init__(self, symbols: list[Symbol]):
        self.symbols, self.starts = symbols, [s.span[0] for s in symbols]

    def of(self, byte: int) -> str | None:
        """From the last symbol that begins at or before the byte, up to the
        first that reaches over it."""
        at = bisect_right(self.starts, byte) - 1
        while at is not None and at >= 0:
            symbol = self.symbols[at]
            if byte < symbol.span[1]:
                return symbol.dotted
            at = symbol.parent
        return None


def _string_spans(tokens) -> list[tuple[int, int, list[tuple[str, int, int]]]]:
    """Each string token: start, end and its pieces (content or hole, start, end)."""
    out, opened = [], []
    brace = 0
    for kind, text, start, end in tokens:
        if kind == tokenize.STRING:
            quote = re.match(r"[a-zA-Z]*('''|\"\"\"|'|\")", text)
            low, high = start + quote.end(), end - len(quote[1])
            out.append((start, end, [("content", low, high)] if low < high else []))
        elif kind == tokenize.FSTRING_START:
            opened.append([start, end, [], 0])
        elif kind == tokenize.FSTRING_END and opened:
            begin, from_, pieces, _ = opened.pop()
            if from_ < start:
                pieces.append(("content", from_, start))
            out.append((begin, end, pieces))
        elif kind == tokenize.OP and opened:
            state = opened[-1]
            if text == "{":
                if state[3] == 0:
                    if state[1] < start:
                        state[2].append(("content", state[1], start))
                    brace = start
                state[3] += 1
            elif text == "}" and state[3]:
                state[3] -= 1
                if state[3] == 0:
                    state[2].append(("hole", brace, end))
                    state[1] = end
    return sorted(out)


#: Relations of a text; the last three, and they alone, need its tokens.
RELATIONS = ("symbols", "calls", "imports", "idents", "texts", "literals")
FROM_TOKENS = frozenset(RELATIONS[3:])


def parse_code(path: str, text: str, tree: ast.Module | None = None, base: tuple[int, int, int] = (0, 0, 0),
               first: bool = True, wanted: Iterable[str] = RELATIONS) -> dict:
    """All rows of a file, as lists of tuples by relation.

    Of a stretch: its tree, the bytes, lines and symbols before it, and whether
    nothing but white space is before it.  Relations that are not wanted may be
    empty."""
    source, refused, error, read = Source(text), [], None, text
    if tree is None:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            tree, read, refused = recovered(text)
            error = "syntax error"
    if tree is None:
        symbols = by_lines(source)
    else:
        walker = _Symbols(source)
        walker.body(tree.body, "", None, 1, True)
        symbols = walker.rows
    inside = Enclosing(symbols)
    tokens, whole = tokens_of(source) if error or not FROM_TOKENS.isdisjoint(wanted) else ([], True)
    if not whole and read is not text:  # what the tokenizer refuses was taken out, too
        tokens, _ = tokens_of(source, read)
    strings = _string_spans(tokens)
    nodes = nodes_of(tree)
    calls, names, regex_arguments, docs, soft = _from_tree(source, nodes, tokens, strings, first)
    for call in calls_by_tokens(source, tokens, refused if tree is not None else [(0, len(source.data) + 1)] if error else []):
        calls.append(call)
        names[call[4] + len(call[2].encode()) - len(call[0].encode())] = "call"
    b0, l0, s0 = base
    line_of = source.line_of if not l0 else lambda byte: l0 + source.line_of(byte)

    def signature(s: Symbol) -> str:
        return collapse(source.cut(s.def_start, s.sig_end))

    symbol_rows = [
        (s0 + n, s.parent if s.parent is None else s0 + s.parent, s.depth, s0 + n, s.dotted, s.name, s.kind, line_of(s.span[0]),
         line_of(max(s.span[1] - 1, s.span[0])), b0 + s.span[0], b0 + s.span[1], b0 + s.def_start, b0 + s.sig_end, signature(s),
         s.decorators, s.params, s.required, s.max_args, s.type_names, s.descendants,
         source.cut(*s.span).rstrip(), source.snap(s.def_start) - s.span[0], s.sig_end - s.span[0],
         line_of(s.def_start), line_of(max(s.sig_end - 1, s.span[0])))
        for n, s in enumerate(symbols)] if "symbols" in wanted else []
    call_rows = sorted(
        ((name, receiver, full, arity, line_of(byte), b0 + byte, inside.of(byte)) for name, receiver, full, arity, byte in calls),
        key=lambda r: (r[4], r[2], r[5])) if "calls" in wanted else []
    ident_rows, text_rows, previous = [], [], ""
    for kind, word, start, _ in tokens:
        converts, previous = previous == "!", word  # the r of {name!r}
        if kind == tokenize.NAME and not keyword.iskeyword(word) and start not in soft and not converts:
            ident_rows.append((b0 + start, line_of(start), word, names.get(start, "reference"), inside.of(start)))
        elif kind == tokenize.COMMENT:
            text_rows.append((b0 + start, line_of(start), word.strip(), "comment", inside.of(start)))
    literal_rows = []
    for start, end, pieces in strings:
        raw = source.cut(start, end)
        for what, low, high in pieces:
            if what == "content":
                text_rows.append((b0 + low, line_of(low), source.cut(low, high).strip(), "string", inside.of(low)))
        prefix = re.match(r"[^\"']*", raw)[0].lower()
        pattern = start in regex_arguments or ("r" in prefix and not REGEX_META.isdisjoint(raw))
        skeleton = "".join(source.cut(low, high) if what == "content" else "<>" for what, low, high in pieces)
        literal_rows.append((b0 + start, line_of(start), "regex" if pattern else "string", raw, skeleton, start in docs, inside.of(start)))
    for kind, word, start, _ in tokens:
        if kind == tokenize.NUMBER:
            literal_rows.append((b0 + start, line_of(start), "number", word, word, start in docs, inside.of(start)))
    literal_rows.sort(key=lambda r: r[0])
    text_rows.sort(key=lambda r: r[0])
    guard = next((l0 + k + 1 for k in range(source.lines) if source.cut(
        source.starts[k], source.starts[k + 1] if k + 1 < source.lines else len(source.data)).lstrip().startswith("if __name__")),
        None) if "if __name__" in text else None
    return {
        "lines": source.lines, "error": error, "n_symbols": len(symbols),
        "has_main_guard": "__name__ ==" in text, "guard_line": guard,
        "symbols": symbol_rows, "calls": call_rows, "imports": sorted(_imports(nodes), key=lambda r: (r[0], r[1], r[2] or "")),
        "idents": ident_rows, "texts": text_rows, "literals": literal_rows}


#: Fields that hold no nodes which anything here looks at.
_PLAIN = frozenset(("ctx", "op", "ops", "id", "attr", "name", "names", "arg", "kind", "type_comment", "asname", "module", "level", "lineno"))
_FIELDS: dict[type, tuple[str, ...]] = {ast.Constant: (), ast.Name: ()}


def nodes_of(tree: ast.Module | None) -> list[ast.AST]:
    """What ``ast.walk`` gives, but for contexts, operators and aliases."""
    if tree is None:
        return []
    out = [tree]
    for node in out:
        kind = node.__class__
        fields = _FIELDS.get(kind)
        if fields is None:
            fields = _FIELDS[kind] = tuple(f for f in node._fields if f not in _PLAIN)
        for name in fields:
            value = getattr(node, name, None)
            if value.__class__ is list:
                out += [v for v in value if isinstance(v, ast.AST)]
            elif isinstance(value, ast.AST):
                out.append(value)
    return out


_BLOCKS = ("body", "orelse", "finalbody")
_ALSO = (ast.Call, ast.Match, getattr(ast, "TypeAlias", ast.Call))
#: The blocks of a kind of node; None for nodes that nothing is read from.
_BLOCK_OF: dict[type, tuple[str, ...] | None] = {}


def _blocks(kind: type) -> tuple[str, ...] | None:
    found = tuple(b for b in _BLOCKS if b in kind._fields)
    _BLOCK_OF[kind] = found or (() if kind in _ALSO else None)
    return _BLOCK_OF[kind]



def _from_tree(source: Source, nodes, tokens, strings, first_text: bool = True):
    """Calls, name kinds by byte, strings handed to regex calls, docstrings, and
    soft keywords used as such."""
    calls, names, patterns, docs, soft = [], {}, set(), set(), set()
    if not nodes:
        previous = ""
        for kind, word, start, _ in tokens:
            if kind == tokenize.NAME:
                if previous in ("def", "class"):
                    names[start] = "definition"
                previous = word
        return calls, names, patterns, docs, soft
    string_starts = {s[0] for s in strings}
    comments = [start for kind, _, start, _ in tokens if kind == tokenize.COMMENT]
    name_starts = [(start, word) for kind, word, start, _ in tokens if kind == tokenize.NAME]
    starts_only = [start for start, _ in name_starts]

    spans = {s: e for s, e, _ in strings}
    for node in nodes:
        kind = node.__class__
        blocks = _BLOCK_OF[kind] if kind in _BLOCK_OF else _blocks(kind)
        if blocks is None:
            continue
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start = source.start(node)
            k = bisect_right(starts_only, start - 1)
            while k < len(name_starts) and name_starts[k][1] in ("def", "class", "async"):
                k += 1
            if k < len(name_starts):
                names[name_starts[k][0]] = "definition"
        elif isinstance(node, ast.Call):
            function = node.func
            start, end = source.start(function), source.end(function)
            bare = not source.data[end:end + 64].lstrip().startswith(b")")
            if bare and isinstance(function, (ast.Name, ast.Attribute)):
                arity = len(node.args) + len(node.keywords)
                if len(node.args) == 1 and isinstance(node.args[0], ast.GeneratorExp) and not node.keywords:
                    whole = node.args[0]
                    if not source.data[end:source.start(whole)].strip():  # its brackets are the call's
                        arity = 1 + sum(1 + len(g.ifs) for g in whole.generators)
                full = collapse(source.cut(start, end))
                if isinstance(function, ast.Name):
                    calls.append((function.id, None, full, arity, source.start(node)))
                    names[start] = "call"
                else:
                    calls.append((function.attr, collapse(source.cut(start, source.end(function.value))) if not _wrapped(source, function) else
                                  collapse(source.cut(start, _before_dot(source, function))), full, arity, source.start(node)))
                    names[end - len(function.attr.encode())] = "call"
            if source.cut(start, end).startswith(REGEX_MODULES):
                for argument in node.args:
                    begin = source.start(argument)
                    if isinstance(argument, (ast.Constant, ast.JoinedStr)) and spans.get(begin) == source.end(argument):
                        patterns.add(begin)
        elif isinstance(node, ast.Match):
            soft.add(source.start(node))
            for case in node.cases:
                begin = source.start(case.pattern)
                k = bisect_right(starts_only, begin - 1) - 1
                while k >= 0 and name_starts[k][1] != "case":
                    k -= 1
                if k >= 0:
                    soft.add(name_starts[k][0])
                soft.update(source.start(p) for p in ast.walk(case.pattern) if isinstance(p, ast.MatchAs) and p.pattern is None and p.name is None)
        elif isinstance(node, getattr(ast, "TypeAlias", ())):
            soft.add(source.start(node))
        for name in blocks:
            block = getattr(node, name, None)
            if isinstance(block, list) and block and isinstance(block[0], ast.Expr):
                first = block[0]
                begin = source.start(first)
                if not isinstance(first.value, (ast.Constant, ast.JoinedStr)) or source.start(first.value) != begin:
                    continue
                if isinstance(node, ast.Module) and (not first_text or comments and comments[0] < begin):
                    continue
                if begin not in string_starts or spans[begin] == source.end(first.value):
                    docs.add(begin)
    return calls, names, patterns, docs, soft


def _before_dot(source: Source, function: ast.Attribute) -> int:
    """The end of the object of an attribute, with its own brackets."""
    end = source.end(function) - len(function.attr.encode())
    return source.data.rfind(b".", 0, end)


def _wrapped(source: Source, function: ast.Attribute) -> bool:
    return b")" in source.data[source.end(function.value):_before_dot(source, function)]


def _imports(nodes) -> set[tuple[str, str, str | None]]:
    out = set()
    for node in nodes:
        if node.__class__ is ast.ImportFrom and not (node.module == "__future__" and not node.level):
            module = "." * node.level + (node.module or "")
            out |= {(module, a.name, a.asname) for a in node.names if a.name != "*"}
        elif node.__class__ is ast.Import:
            out |= {(a.name, a.name, a.asname) for a in node.names}
    return out
