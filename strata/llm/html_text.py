"""Main text of web pages: structure first, a host suffix array over every page.

Each page is cut into segments in page order.  Menus, headers, footers, adverts,
forms, comments and the like are dropped by element, role or class; a declared
article (or main element) drops what stands outside it.  That takes structure:
an advert or a menu that no other page has cannot be told by repetition.

The token streams of all pages of a host, dropped segments included, go through
the host's suffix array, which sorts all suffixes by their first MIN_RUN tokens.
A run of MIN_RUN tokens, or a whole segment of MIN_SEGMENT, is boilerplate where
it stands on one in SHARE of the host's distinct bodies, and on LEAST_BODIES.
Structure guards what may go: of undecided text any such run, inside an article
only whole segments of MIN_RUN tokens or more, never a part of one.

Pages with equal text are one body, so copies are no evidence against each other.

A host whose streams exceed GROUP_BYTES is dealt into blocks by body.  What a
SHARE of the host's bodies have, a SHARE of at least one block's have; so each
block names its candidates, all blocks count the candidates of all, and the sums
decide.  The result is that of one array, however the host is dealt.

Defined results: null and empty html give an empty text; markup that never
closes is read as far as it goes; repeated rows get equal texts; a null url is a
host of its own, by row; a page without any text is no body; an empty table gives
an empty result; further columns are ignored.  Nothing is capped: pages are read whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.blocks import expand, squeeze
from strata.llm.common import Scratch, attach_unique, batches, get_file, put_file
from strata.llm.textvec import run_hashes

MIN_RUN = 10
MIN_SEGMENT = 4
SHARE = 2
LEAST_BODIES = 3
GROUP_BYTES = 8 << 20
BATCH_BYTES = 2 << 20
#: Streams that a task holds before it sends them on, packed by host.
BUNDLE_BYTES = 16 << 20
BUNDLE = "host string, block long, pages binary"
KEPT, UNDECIDED, DROPPED = 0, 1, 2
#: An undecided segment with more of its characters in links is a menu.
MOST_LINKED = 0.6

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<(?![a-zA-Z/!?]))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")

_RAW = frozenset("script style noscript template iframe textarea title xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split())
_DROP_TAG = frozenset(
    "nav footer aside form button select option fieldset dialog menu head svg canvas object audio video".split())
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_DROP_NAME = frozenset(
    "nav navbar navigation menu footer sidebar ad ads advert adverts advertisement advertising banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice popup modal overlay subscribe subscription newsletter signup "
    "share sharing social related recommended breadcrumb breadcrumbs pagination pager comment comments respond replies "
    "disqus widget toolbar masthead skip".split())
_ROOT = frozenset(["article", "main"])
#: An open <p> or <li> ends where one of these begins.
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split())


def _dropped(tag: str, rest: str, in_root: bool) -> bool:
    if tag in _DROP_TAG or (tag == "header" and not in_root):
        return True
    if not rest.strip(" /"):
        return False
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name == "role" and value in _DROP_ROLE:
            return True
        if name in ("class", "id") and not _DROP_NAME.isdisjoint(_SPLIT.split(value)) and tag not in ("html", "body"):
            return True
    return False


def _is_root(tag: str, rest: str) -> bool:
    return tag in _ROOT or ("role" in rest and re.search(r"role\s*=\s*[\"']?(main|article)\b", rest, re.I) is not None)


def segments(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block in page order, with white space collapsed."""
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, in a root, in a link
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    state, linked, rooted, raw_until = UNDECIDED, 0, False, None

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            kind = state
            if kind == UNDECIDED and linked > MOST_LINKED * len(text):
                kind = DROPPED
            out.append((kind, text))
        parts.clear()
        linked = 0

    def settle() -> None:
        nonlocal state
        now = UNDECIDED
        if stack:
            _, drop, root, _ = stack[-1]
            now = DROPPED if drop else KEPT if root else UNDECIDED
        if now != state:
            flush()
            state = now

    at, end = 0, len(page)
    while at < end:
        if raw_until:
            close = re.compile(rf"</{raw_until}[\s/>]", re.I).search(page, at)
            at, raw_until = (close.start() if close else end), None
            if at == end:
                break
        match = _PIECE.match(page, at)
        if match is None:  # a tag with an open quote, or one that never ends
            close = page.find(">", at)
            if close < 0:
                break
            at = close + 1
            continue
        at = match.end()
        text = match["text"]
        if text is not None:
            if state != DROPPED:
                text = entities.unescape(text) if "&" in text else text
                parts.append(text)
                if stack and stack[-1][3]:
                    linked += len(text.strip())
            continue
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush()
        if match["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    settle()
                    break
                if stack[k][0] in _ROOT and tag in _INLINE:
                    break
            continue
        rest = match["rest"]
        if tag in _RAW and not rest.endswith("/"):
            raw_until = tag
            continue
        if tag in _VOID:
            if tag == "br":
                parts.append(" ")
            continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in _INLINE:
                    break
        if rest.endswith("/") and tag not in _DROP_TAG:
            continue
        _, drop, root, link = stack[-1] if stack else ("", False, False, False)
        root = root or _is_root(tag, rest)
        drop = drop or _dropped(tag, rest, root)
        rooted = rooted or (root and not drop)
        stack.append((tag, drop, root, link or tag == "a"))
        settle()
    flush()
    if rooted:  # a declared article settles what stands outside it
        return [(DROPPED if kind == UNDECIDED else kind, text) for kind, text in out]
    return out


def _streams(pages: list[list[list[str]]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pages' streams as one: token numbers, page of each place, the hash of
    the ``run`` tokens from it, and whether these stand inside one page.  A
    segment's border is a token as well, so short segments repeat as a whole."""
    words: defaultdict[str, int] = defaultdict()
    words.default_factory = words.__len__  # the next number for a new word
    words[""] = 0
    stream: list[int] = []
    page_of: list[int] = []
    ends: list[int] = []
    for number, page in enumerate(pages):
        for segment in page:
            stream.append(0)
            stream.extend(map(words.__getitem__, segment))
        stream.append(-1 - number)  # no run crosses a page
        page_of.extend([number] * (len(stream) - len(page_of)))
        ends.append(len(stream) - 1)
    n = len(stream)
    tokens, page_at = np.array(stream, np.int64), np.array(page_of, np.int64)
    table = np.array([_number(w) for w in words], np.uint64)
    hashes = np.zeros(n, np.uint64)
    found = run_hashes(np.where(tokens < 0, np.uint64(0), table[np.maximum(tokens, 0)]), run)
    hashes[:len(found)] = found
    return tokens, page_at, hashes, np.arange(n) + run <= np.array(ends)[page_at]


def _suffixes(tokens: np.ndarray, owner: np.ndarray, run: int) -> np.ndarray:
    """For each place of the streams the number of owners of its first ``run`` tokens.

    The suffix array is built by prefix doubling and holds the suffixes in the
    order of these tokens.  ``owner`` ascends.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable") if run == 1 else None
    length = 1
    while length < run:
        step = min(length, run - length)
        after = np.zeros(n, np.int64)
        after[:max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        length += step
    owner, sorted_rank = owner[order], rank[order]
    first = np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1]))
    other = first.copy()
    other[1:] |= owner[1:] != owner[:-1]
    bounds = np.flatnonzero(first)
    count = np.empty(n, np.int64)
    count[order] = np.repeat(np.add.reduceat(other.astype(np.int64), bounds), np.diff(np.concatenate((bounds, [n]))))
    return count


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def _runs(pages: list[list[list[str]]], starts: np.ndarray, run: int) -> list[list[np.ndarray]]:
    """Which tokens of each segment stand in a run that begins at one of the starts."""
    n = sum(1 + sum(1 + len(segment) for segment in page) for page in pages)
    change = np.zeros(n + run + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + run, -1)
    hit = np.cumsum(change)[:n] > 0
    out, at = [], 0
    for page in pages:
        marks = []
        for segment in page:
            marks.append(_whole_runs(hit[at + 1:at + 1 + len(segment)], run))
            at += 1 + len(segment)
        at += 1
        out.append(marks)
    return out


def repeated(pages: list[list[list[str]]], run: int = MIN_RUN) -> list[list[np.ndarray]]:
    """For the tokens of each segment of each page: do they stand in a run that
    another page has too?"""
    tokens, page_at, _, _ = _streams(pages, run)
    return _runs(pages, np.flatnonzero(_suffixes(tokens, page_at, run) > 1), run)


def _whole_runs(hit: np.ndarray, run: int) -> np.ndarray:
    """A run that reaches over a border takes a short segment whole or leaves it."""
    if not hit.any():
        return hit
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    out = hit.copy()
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if high - low < run and high - low < len(hit):
            out[low:high] = False
    return out


def _digest(*parts: str) -> bytes:
    return hashlib.blake2b("\0".join(parts).encode(), digest_size=16).digest()


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments as lines, a digit for the kind before each.

    Of equal shapes (kinds and texts but for dropped ones) on a host, the one
    with the least dropped text counts; a task sends those it cannot rule out.
    """
    least: dict[bytes, bytes] = {}
    for batch in batches(it, 2, BATCH_BYTES):
        bodies, shapes, asides, streams, sent = [], [], [], [], []
        for where, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            cut = segments(page or "")
            lines = [f"{kind}{text}" for kind, text in cut]
            bodies.append(_digest(" ".join(text for kind, text in cut if kind != DROPPED)))
            shapes.append(_digest(where, *[t for t, (kind, _) in zip(lines, cut, strict=True) if kind != DROPPED]))
            asides.append(_digest(*lines))
            streams.append("\n".join(lines))
            send = bool(cut and where) and asides[-1] < least.get(shapes[-1], b"\xff" * 17)
            if send:
                least[shapes[-1]] = asides[-1]
            sent.append(send)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in (bodies, shapes, asides)),
             pa.array(streams, pa.string()), pa.array(sent, pa.bool_())],
            names=["page", "host", "body", "shape", "aside", "stream", "sent"])


class Block:
    """Pages of a host: for each of its shapes the page with the least dropped
    text, and the runs and segments of all of them by their hashes."""

    def __init__(self, table: pa.Table):
        columns = (table.column(c).to_pylist() for c in ("body", "shape", "aside", "stream"))
        rows = {row[1]: row for row in sorted(zip(*columns, strict=True), reverse=True)}  # the least stays
        rows = sorted(rows.values())
        number: dict[bytes, int] = {}
        self.owners = np.array([number.setdefault(body, len(number)) for body, *_ in rows], np.int64)
        self.bodies, self.shapes = len(number), [shape for _, shape, *_ in rows]
        lines = [stream.split("\n") for *_, stream in rows]
        self.kinds = [[int(line[0]) for line in page] for page in lines]
        self.tokens = [[line[1:].split(" ") for line in page] for page in lines]
        self.stream, self.page_at, self.hashes, self.inside = _streams(self.tokens, MIN_RUN)
        self.whole = [[_number("\n" + line[1:]) if len(t) >= MIN_SEGMENT else None for line, t in zip(page, told, strict=True)]
                      for page, told in zip(lines, self.tokens, strict=True)]

    def _segments(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, number of bodies) of the whole segments."""
        having: dict[int, set[int]] = {}
        for owner, page in zip(self.owners.tolist(), self.whole, strict=True):
            for key in page:
                if key is not None:
                    having.setdefault(key, set()).add(owner)
        return np.array(list(having), np.uint64), np.array([len(x) for x in having.values()], np.int64)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, number of bodies) of all runs, by the suffix array, and segments."""
        count = _suffixes(self.stream, self.owners[self.page_at], MIN_RUN)
        runs, at = np.unique(self.hashes[self.inside], return_index=True)
        keys, having = self._segments()
        both, first = np.unique(np.concatenate((runs, keys)), return_index=True)
        return both, np.concatenate((count[self.inside][at], having))[first]

    def candidates(self) -> np.ndarray:
        keys, count = self.counted()
        return keys[SHARE * count >= self.bodies]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The number of bodies that have each of the ascending keys, here and
        there runs of other blocks, so found by hash and not by order."""
        if not len(keys):
            return np.zeros(0, np.int64)
        places = np.flatnonzero(self.inside & np.isin(self.hashes, keys))
        pairs = np.unique(np.searchsorted(keys, self.hashes[places]) * self.bodies + self.owners[self.page_at[places]])
        out = np.bincount(pairs // self.bodies, minlength=len(keys))
        found, having = self._segments()
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        known = keys[at] == found
        out[at[known]] = having[known]
        return out

    def cuts(self, keys: np.ndarray) -> pa.Table:
        """(shape, cuts) of the pages that lose something to the keys: segment
        among those not dropped, first token, token after the last."""
        runs = _runs(self.tokens, np.flatnonzero(self.inside & np.isin(self.hashes, keys)), MIN_RUN)
        known = set(keys.tolist())
        shapes, out = [], []
        for shape, kinds, whole, found in zip(self.shapes, self.kinds, self.whole, runs, strict=True):
            spans, number = [], -1
            for kind, key, hit in zip(kinds, whole, found, strict=True):
                if kind == DROPPED:
                    continue
                number += 1
                if key in known and (kind == UNDECIDED or len(hit) >= MIN_RUN):
                    spans += [number, 0, len(hit)]
                elif kind == UNDECIDED and hit.any():
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()
                    for low, high in zip(edges[::2], edges[1::2], strict=True):
                        spans += [number, low, high]
            if spans:
                shapes.append(shape)
                out.append(np.array(spans, "<i4").tobytes())
        return pa.table({"shape": pa.array(shapes, pa.binary()), "cuts": pa.array(out, pa.binary())})


def _boilerplate(keys: np.ndarray, count: np.ndarray, bodies: int) -> np.ndarray:
    return keys[(SHARE * count >= bodies) & (count >= LEAST_BODIES)]


def _bundle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of one host and block that a task meets, packed together: pages of a
    host are alike, so they take far less room in the shuffle than one by one."""
    held: dict[tuple[str, int | None], list[tuple]] = {}
    size = 0

    def seal() -> pa.RecordBatch:
        keys = sorted(held, key=lambda key: (key[0], key[1] or 0))
        packed = [_pack(pa.table({name: pa.array(values, kind) for (name, kind), values in zip(
            _PAGE, zip(*held.pop(key), strict=True), strict=True)})) for key in keys]
        return pa.RecordBatch.from_arrays(
            [pa.array([where for where, _ in keys], pa.string()), pa.array([block for _, block in keys], pa.int64()),
             pa.array(packed, pa.binary())], names=["host", "block", "pages"])

    for batch in it:
        for where, block, *row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            held.setdefault((where, block), []).append(row)
            size += len(row[-1])
            if size >= BUNDLE_BYTES:
                yield seal()
                size = 0
    if held:
        yield seal()


_PAGE = (("body", pa.binary()), ("shape", pa.binary()), ("aside", pa.binary()), ("stream", pa.string()))


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return squeeze(sink.getvalue().to_pybytes())


def _unpack(bundles: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(expand(pages.as_py())).read_all() for pages in bundles])


def _decide(table: pa.Table) -> pa.Table:
    """A host of one block."""
    block = Block(_unpack(table.column("pages")))
    return block.cuts(_boilerplate(*block.counted(), block.bodies))


def _across(sent: DataFrame, scratch: Scratch) -> DataFrame:
    """Hosts of several blocks: candidates of each block, counts in all, cuts.

    What the blocks of a host say meets in one task and goes back to them as a
    file in the shared folder: candidates and counts, no streams.
    """
    dealt = scratch.keep(sent.groupBy("host", "block").applyInArrow(_freeze, "host string, pages binary"), "blocks", codec="uncompressed")
    folder = scratch.path("hosts")

    def place(where: str, what: str) -> str:
        return f"{folder}/{_digest(where).hex()}.{what}"

    def read(where: str, what: str) -> np.ndarray:
        return np.frombuffer(get_file(place(where, what)), np.uint64)

    def each(work: Callable[[str, Block], pa.RecordBatch]) -> Callable:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for at, where in enumerate(batch.column(0).to_pylist()):
                    yield from work(where, Block(_unpack(batch.column(1).slice(at, 1)))).to_batches()
        return run

    def name(where: str, block: Block) -> pa.Table:
        return pa.table({"host": [where], "said": pa.array([block.candidates().tobytes()], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        where = table.column("host")[0].as_py()
        keys = np.zeros(0, np.uint64)
        for said in table.column("said"):
            keys = np.union1d(keys, np.frombuffer(said.as_py(), np.uint64))
        put_file(place(where, "candidates"), keys.tobytes())
        return pa.table({"n": pa.array([len(keys)], pa.int64())})

    def tell(where: str, block: Block) -> pa.Table:
        counts = block.counts(read(where, "candidates"))
        return pa.table({"host": [where], "bodies": pa.array([block.bodies], pa.int64()),
                         "said": pa.array([counts.astype(np.int64).tobytes()], pa.binary())})

    def settle(table: pa.Table) -> pa.Table:
        where = table.column("host")[0].as_py()
        keys = read(where, "candidates")
        total = np.zeros(len(keys), np.int64)
        for said in table.column("said"):
            total += np.frombuffer(said.as_py(), np.int64)
        keys = _boilerplate(keys, total, pa.compute.sum(table.column("bodies")).as_py())
        put_file(place(where, "boilerplate"), keys.tobytes())
        return pa.table({"n": pa.array([len(keys)], pa.int64())})

    def cut(where: str, block: Block) -> pa.Table:
        return block.cuts(read(where, "boilerplate"))

    scratch.keep(dealt.mapInArrow(each(name), "host string, said binary").groupBy("host").applyInArrow(gather, "n long"), "named")
    scratch.keep(dealt.mapInArrow(each(tell), "host string, bodies long, said binary").groupBy("host").applyInArrow(
        settle, "n long"), "told")
    return dealt.mapInArrow(each(cut), "shape binary, cuts binary")


def _freeze(table: pa.Table) -> pa.Table:
    """The bundles of a block as one."""
    return pa.table({"host": [table.column("host")[0].as_py()], "pages": pa.array([_pack(_unpack(table.column("pages")))], pa.binary())})


def _finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        texts = []
        for stream, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = [line[1:] for line in stream.split("\n") if line and int(line[0]) != DROPPED]
            if cuts:
                words = [line.split(" ") for line in lines]
                for segment, low, high in np.frombuffer(cuts, "<i4").reshape(-1, 3).tolist()[::-1]:
                    del words[segment][low:high]
                lines = [" ".join(w) for w in words if w]
            texts.append(" ".join(lines))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page", "text"])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: id, url, text, n_chars."""
    scratch = Scratch(pages.sparkSession, "html")
    page = F.struct(F.col(id_col).alias("id"), F.col(url).alias("url"))
    schema = pages.select(page.alias("page")).schema["page"].dataType.simpleString()
    parsed = scratch.keep(pages.select(page.alias("page"), host(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(
        _parse, f"page {schema}, host string, body binary, shape binary, aside binary, stream string, sent boolean"), "parsed")
    sent = parsed.where("sent")
    # Only hosts of several blocks, at most one for each GROUP_BYTES of all streams.
    large = scratch.keep(sent.groupBy("host").agg(F.sum(F.length("stream") + 16).alias("bytes")).where(
        F.col("bytes") > GROUP_BYTES).select("host", F.ceil(F.col("bytes") / GROUP_BYTES).alias("blocks")), "large")
    some = not large.isEmpty()
    dealt = sent.join(F.broadcast(large), "host", "left") if some else sent.withColumn("blocks", F.lit(None).cast("long"))

    def bundles(rows: DataFrame, block: Column) -> DataFrame:
        return rows.select("host", block.alias("block"), *[name for name, _ in _PAGE]).mapInArrow(_bundle, BUNDLE)

    cuts = bundles(dealt.where("blocks is null"), F.lit(None).cast("long")).groupBy("host").applyInArrow(
        _decide, "shape binary, cuts binary")
    if some:
        blocked = bundles(dealt.where("blocks is not null"), F.pmod(F.xxhash64("body"), F.col("blocks")))
        cuts = cuts.unionByName(_across(blocked, scratch))
    cuts = scratch.keep(cuts, "cuts")
    if cuts.isEmpty():
        told = parsed.withColumn("cuts", F.lit(None).cast("binary"))
    else:
        weighed = cuts.join(parsed.groupBy("shape").agg(F.count("*").alias("n")), "shape")
        told = attach_unique(parsed, scratch.keep(weighed, "weighed"), "shape", "n")
    return told.select("page", "stream", "cuts").mapInArrow(_finish, f"page {schema}, text string").select(
        F.col("page.id").alias(id_col), F.col("page.url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
