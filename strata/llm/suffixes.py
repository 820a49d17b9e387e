"""Suffix-array dedup: repeated strings of LENGTH bytes, found on a BWT.

The Burrows-Wheeler transform is built over phrases, as in prefix-free parsing,
so it never sees a text twice.  Every window of LENGTH bytes belongs to the
smallest GRAM hash in it, its anchor; the neighbouring windows of one anchor
span a phrase.  Equal windows have equal anchors, so they meet in the bucket of
the anchor's hash, whatever documents they are in.

Round 1: blocks send (anchor, phrase) hashes to the buckets.  A phrase that an
earlier place has too is covered whole.  An anchor with one phrase is settled.
Round 2: where an anchor has several phrases, the first copy of each is sent to
the bucket, whose phrases form one text.  ``expand_intervals`` builds the BWT
of that text and extends all intervals backward, breadth first, so common
prefixes come out by increasing value until LENGTH is reached; the intervals
that are left hold windows equal in LENGTH bytes, and the earliest stays.
An anchor in very many contexts, such as a common line, is parted by the bytes
beside it, so that no text grows with it (``parted``).

Defined results: texts are UTF-8 bytes, whole; null and empty texts have none;
windows never cross documents; rows that share an id are taken in stored order;
a null id comes last (as 2**63 - 1, which is reserved for it) and stays null; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm import blocks as B
from strata.llm import textvec
from strata.llm.common import Scratch

LENGTH = 100
GRAM = 32
PIECE = 1 << 18
_NO_ID = 2**63 - 1
_SPREAD = np.uint64(0xA0761D6478BD642F)


# ---- the transform ----------------------------------------------------------

def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes, the empty one included, in the order of their first ``depth``
    bytes at least; by prefix doubling from packed keys of seven symbols.

    Once a suffix stands alone its place is final, so each round sorts only
    those that still share a rank.
    """
    n = len(text) + 1
    symbols = np.zeros(n + 7, np.uint64)
    symbols[:n - 1] = text
    symbols[:n - 1] += np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | symbols[k:k + n]
    order = np.argsort(key)
    rank = _ranks(key, order)
    length = 7
    while length < depth:
        ranked = rank[order]
        alone = np.ones(n, bool)
        alone[1:] = ranked[1:] != ranked[:-1]
        alone[:-1] &= ranked[1:] != ranked[:-1]
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        some = order[places]
        after = np.zeros(len(some), np.int64)
        inside = some + length < n
        after[inside] = rank[some[inside] + length] + 1
        key = rank[some] * (n + 1) + after
        again = np.argsort(key)
        key, some = key[again], some[again]
        order[places] = some
        # A rank is the place where its run of equals begins.
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[some] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        length *= 2
    return order


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix the place where the run of its equals begins."""
    ranked = key[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    out = np.empty(len(key), np.int64)
    out[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    return out


def expand_intervals(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, borders): row k opens an interval where borders[k] is set,
    and the rows of an interval agree in their first ``length`` bytes.

    Two neighbouring rows that one symbol precedes become neighbours when that
    symbol is put before them, and their common prefix is one longer than the
    least between the two rows.  Round by round, the borders whose value was
    found last split the pairs that span them; a pair that no border below
    ``length`` splits stays one interval.
    """
    order = suffix_order(text, length)
    n = len(order)
    before = np.zeros(n, np.uint16)
    inner = order > 0
    before[inner] = text[order[inner] - 1].astype(np.uint16) + np.uint16(1)
    by_symbol = np.argsort(before, kind="stable")  # row k is what row by_symbol[k] extends to
    symbols = before[by_symbol]
    paired = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1  # rows whose upper neighbour has their symbol
    borders = np.ones(n + 1, bool)
    borders[paired] = False
    low, high = by_symbol[paired - 1].astype(np.int32), by_symbol[paired].astype(np.int32)
    paired = paired.astype(np.int32)
    done = 0
    for _ in range(length - 1):
        seen = np.cumsum(borders[:n], dtype=np.int32)
        split = np.flatnonzero(seen[high] > seen[low])
        if len(split) == done:  # none but those that were split before
            break
        borders[paired[split]] = True
        done = len(split)
        if 8 * done > len(paired):  # leave out what is settled, now and then
            left = np.ones(len(paired), bool)
            left[split] = False
            paired, low, high, done = paired[left], low[left], high[left], 0
    return order, borders[:n]


def repeated_windows(text: np.ndarray, may_start: np.ndarray, length: int) -> np.ndarray:
    """Which places start a window that an earlier allowed place starts too."""
    order, borders = expand_intervals(text, length)
    allowed = np.concatenate((may_start, [False]))[order]
    rows, interval = order[allowed], np.cumsum(borders)[allowed]
    out = np.zeros(len(text), bool)
    if len(rows):
        first = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
        least = np.repeat(np.minimum.reduceat(rows, first), np.diff(np.concatenate((first, [len(rows)]))))
        out[rows[rows > least]] = True
    return out


# ---- phrases ----------------------------------------------------------------

class Phrases:
    """The phrases of a block: places of their windows, anchors and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.length = length
        width, total = length - gram + 1, max(0, len(data) - length + 1)
        last_start = np.repeat(offsets[1:], np.diff(offsets)).astype(np.int32) - length if total else None
        begins, anchors, ends, last = [], [], [], (-1, -1)
        for at in range(0, total, PIECE):
            to = min(at + PIECE, total)
            grams = textvec.run_hashes(textvec._RANDOM[data[at:to - 1 + length]], gram)
            picked = textvec.minima(grams, width)
            may = np.flatnonzero(np.arange(at, to, dtype=np.int32) <= last_start[at:to])
            if not len(may):
                continue
            picked = picked[may]
            fresh = np.concatenate(([True], picked[1:] != picked[:-1]))
            if at + int(picked[0]) == last[0]:  # a phrase goes on from the piece before
                fresh[0] = False
            begin = np.flatnonzero(fresh)
            if len(begin):
                begins.append(may[begin] + at)
                anchors.append(grams[picked[begin]])
                closed = may[begin[begin > 0] - 1] + at
                if last[0] >= 0:
                    closed = np.concatenate(([last[1] if begin[0] == 0 else closed[0]], closed[int(begin[0] > 0):]))
                ends.append(closed)
            last = (at + int(picked[-1]), at + int(may[-1]))
        if last[0] >= 0:
            ends.append(np.array([last[1]]))
        empty = np.zeros(0, np.int64)
        self.start = np.concatenate(begins) if begins else empty
        self.end = np.concatenate(ends) + length if ends else empty
        # Anchors are small hashes by choice; mixed again they spread over the buckets.
        self.anchor = textvec.mix(np.concatenate(anchors) ^ _SPREAD) if anchors else np.zeros(0, np.uint64)
        whole = textvec.word_hashes(data, self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        self.phrase = whole >> np.uint64(16)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        # Distinct (anchor, phrase), sorted, each with its first place in the block.
        order = np.lexsort((self.phrase, self.anchor))
        a, p = self.anchor[order], self.phrase[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1]))) if len(a) else np.zeros(0, bool)
        self.entry_of = np.empty(len(a), np.int64)
        self.entry_of[order] = np.cumsum(new) - 1
        self.first = order[new]  # lexsort is stable: the earliest place comes first


def ask_blob(phrases: Phrases, ids: np.ndarray, a: int, b: int) -> bytes:
    rows = phrases.first[a:b]
    p = np.ascontiguousarray(phrases.phrase[rows].view(np.uint8).reshape(-1, 8)[:, :6])
    return B.join_blobs([B.pack_sorted(phrases.anchor[rows]), p.tobytes(), B.pack_numbers(ids[phrases.doc[rows]])])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where the rows of sorted keys begin to differ from the row above."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def settle(blocks: list[int], blobs: list[bytes]) -> list[bytes]:
    """Round 1 in a bucket: two bits an entry, (covered, sent on)."""
    anchors, phrases, ids, owner = [], [], [], []
    for number, blob in enumerate(blobs):
        a, p, d = B.split_blobs(blob)
        anchors.append(B.unpack_sorted(a))
        planes = np.zeros((len(anchors[-1]), 8), np.uint8)
        planes[:, :6] = np.frombuffer(p, np.uint8).reshape(-1, 6)
        phrases.append(planes.view(np.uint64).ravel())
        ids.append(B.unpack_numbers(d))
        owner.append(np.full(len(ids[-1]), number))
    a, p, d, o = map(np.concatenate, (anchors, phrases, ids, owner))
    order = np.lexsort((o, d, p, a))  # blobs come in the order of their blocks
    sa, sp = a[order], p[order]
    first = _runs(sa, sp)
    group = np.flatnonzero(_runs(sa))
    several = np.repeat(np.add.reduceat(first.astype(np.int64), group) > 1, np.diff(np.concatenate((group, [len(a)]))))
    covered, sent = np.empty(len(a), bool), np.empty(len(a), bool)
    covered[order] = ~first
    sent[order] = first & several
    cuts = np.cumsum([len(x) for x in anchors])[:-1]
    return [B.join_blobs([B.squeeze(np.packbits(x).tobytes()), B.squeeze(np.packbits(y).tobytes())])
            for x, y in zip(np.split(covered, cuts), np.split(sent, cuts), strict=True)]


def settled(phrases: Phrases, answers: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each entry: covered, sent on; and the entries' bucket bounds."""
    bounds = B.bucket_bounds(phrases.anchor[phrases.first], buckets)
    covered, sent = np.zeros(int(bounds[-1]), bool), np.zeros(int(bounds[-1]), bool)
    for k, blob in answers.items():
        n = int(bounds[k + 1] - bounds[k])
        for out, bits in zip((covered, sent), B.split_blobs(blob), strict=True):
            out[bounds[k]:bounds[k + 1]] = np.unpackbits(np.frombuffer(B.expand(bits), np.uint8), count=n).view(bool)
    return covered, sent, bounds


def send_blob(phrases: Phrases, entries: np.ndarray, ids: np.ndarray, data: np.ndarray) -> bytes:
    """The phrases of some entries, by anchor, with their places."""
    rows = phrases.first[entries]
    text = b"".join(data[s:e].tobytes() for s, e in zip(phrases.start[rows].tolist(), phrases.end[rows].tolist(), strict=True))
    return B.join_blobs([B.squeeze(text), B.pack_numbers(phrases.end[rows] - phrases.start[rows]),
                         B.pack_numbers(ids[phrases.doc[rows]]), B.pack_numbers(rows), B.pack_sorted(phrases.anchor[rows])])


#: Phrases of a bucket are transformed in runs of whole anchors of this size.
TEXT_BYTES = 1 << 18
#: The phrases of an anchor that hold more than this are parted (``parted``).
HOT_BYTES = 1 << 19


def _phrase_places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Every byte place of the phrases, one phrase after another."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))


def _hashes_at(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    found = textvec.run_hashes(textvec._RANDOM[data], n)
    return found[np.minimum(at, len(found) - 1)] if len(found) else np.zeros(len(at), np.uint64)


def parted(data: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, length: int, gram: int):
    """Phrases of an anchor in two parts each: (start, size, key) of the parts.

    Windows that begin well ahead of the anchor have the bytes before it in common
    wherever they are equal, the others those after it.  So parts with different
    keys have no equal window, every window lies in one part, and an anchor that
    stands in very many contexts falls apart.
    """
    half = (length - gram) // 2
    place = _phrase_places(start, size)
    same = textvec.mix(_hashes_at(data, place, gram) ^ _SPREAD) == np.repeat(anchor, size)
    own = np.repeat(np.arange(len(start)), size)
    last = start + size - length  # the last window begins here, and the anchor not before it
    found = np.flatnonzero(same & (place >= last[own]) & (place + gram <= (start + size)[own]))
    at = place[found[np.searchsorted(own[found], np.arange(len(start)))]]
    left = np.flatnonzero(at - half >= start)
    to = np.minimum(at - half, last)[left]
    right = np.flatnonzero(last > at - half)
    since = np.maximum(at - half + 1, start)[right]
    before = _hashes_at(data, (at - half)[left], half) if half else np.zeros(len(left), np.uint64)
    after = _hashes_at(data, (at + gram)[right], length - half + 1 - gram)
    return (np.concatenate((start[left], since)), np.concatenate((to - start[left] + length, (start + size)[right] - since)),
            np.concatenate((before, ~after)), np.concatenate((left, right)))


def interval_answers(length: int, gram: int):
    def answer(blocks: list[int], blobs: list[bytes]) -> list[bytes]:
        """Round 2 in a bucket: for each window of each phrase, is it a repeat?"""
        parts = [B.split_blobs(blob) for blob in blobs]
        texts = [np.frombuffer(B.expand(p[0]), np.uint8) for p in parts]
        sizes, docs, rows = ([B.unpack_numbers(p[k]) for p in parts] for k in (1, 2, 3))
        data, size, doc, row = np.concatenate(texts), np.concatenate(sizes), np.concatenate(docs), np.concatenate(rows)
        anchor = np.concatenate([B.unpack_sorted(p[4]) for p in parts])
        own = np.repeat(np.arange(len(parts)), [len(s) for s in sizes])
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        order = np.lexsort((row, own, doc, anchor))  # in an anchor the earliest place first
        out = np.zeros(len(data), bool)

        def settle_runs(start: np.ndarray, size: np.ndarray, key: np.ndarray, hot: int | None) -> None:
            """Texts of whole keys, the earliest place of each first, one after another."""
            first = np.append(np.flatnonzero(_runs(key)), len(key)) if len(key) else np.zeros(1, np.int64)
            filled, at = np.concatenate(([0], np.cumsum(size))), 0
            while at < len(first) - 1:
                to = max(at + 1, int(np.searchsorted(filled[first], filled[first[at]] + TEXT_BYTES, "right")) - 1)
                some = slice(first[at], first[to])
                at, n = to, size[some]
                if hot is not None and int(n.sum()) > hot:
                    begin, long, keys, number = parted(data, start[some], n, key[some], length, gram)
                    again = np.lexsort((number, keys))
                    settle_runs(begin[again], long[again], keys[again], None)
                    continue
                place = _phrase_places(start[some], n)
                within = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
                out[place[repeated_windows(data[place], within < np.repeat(n - length + 1, n), length)]] = True

        settle_runs(start[order], size[order], anchor[order], HOT_BYTES)
        cuts = np.cumsum([len(t) for t in texts])[:-1]
        return [B.squeeze(np.packbits(part).tobytes()) for part in np.split(out, cuts)]

    return answer


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row a document: n_bytes, n_removed, n_spans and the hash of what stays."""

    def finish(ids, data, offsets, gone) -> pa.RecordBatch:
        raw = data.tobytes()
        change = np.diff(gone.astype(np.int8), prepend=np.int8(0))
        change[offsets[:-1][offsets[:-1] < len(data)]] = gone[offsets[:-1][offsets[:-1] < len(data)]]
        spans = np.concatenate(([0], np.cumsum(change > 0)))
        removed = np.concatenate(([0], np.cumsum(gone)))
        n = removed[offsets[1:]] - removed[offsets[:-1]]
        hashes = []
        for a, b, cut in zip(offsets[:-1].tolist(), offsets[1:].tolist(), n.tolist(), strict=True):
            hashes.append(hashlib.sha256(data[a:b][~gone[a:b]].tobytes() if cut else raw[a:b]).hexdigest())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == _NO_ID), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()),
             pa.array(spans[offsets[1:]] - spans[offsets[:-1]], pa.int64()), pa.array(hashes)],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = removals(docs, finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text, length, gram)
    return out.withColumnRenamed("id", id_col)


def removals(docs: DataFrame, finish, schema: str, id_col: str, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Run ``finish(ids, data, offsets, gone)`` with the repeated bytes marked."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    frozen, n_bytes, _ = B.freeze(docs, scratch, id_col, text)
    buckets = B.n_buckets(n_bytes)

    def ask(grp, block, ids, data, offsets, _) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(data, offsets, length, gram)
        bounds = B.bucket_bounds(phrases.anchor[phrases.first], buckets)
        yield B.question_batch(grp, block, bounds, lambda a, b: ask_blob(phrases, ids, a, b))

    round1 = B.ask(B.each_block(frozen, ask, B.QUESTION), settle, scratch, "round1", buckets)

    def send(grp, block, ids, data, offsets, answers) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(data, offsets, length, gram)
        _, sent, bounds = settled(phrases, answers, buckets)
        entries = np.flatnonzero(sent)
        cut = np.searchsorted(entries, bounds)
        yield B.question_batch(grp, block, cut, lambda a, b: send_blob(phrases, entries[a:b], ids, data))

    round2 = B.ask(B.each_block(frozen, send, B.QUESTION, round1), interval_answers(length, gram), scratch, "round2", buckets)
    said = B.Answers(round1)

    def judge(grp, block, ids, data, offsets, answers) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(data, offsets, length, gram)
        covered, sent, bounds = settled(phrases, said.of(grp, block), buckets)
        entry = phrases.entry_of
        again = np.ones(len(entry), bool)
        again[phrases.first] = False
        whole = covered[entry] | again  # a later copy in the block, or an earlier elsewhere
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, phrases.start[whole], 1)
        np.add.at(change, phrases.end[whole], -1)
        entries = np.flatnonzero(sent)
        cut = np.searchsorted(entries, bounds)
        for k, blob in answers.items():
            rows = phrases.first[entries[cut[k]:cut[k + 1]]]
            size = phrases.end[rows] - phrases.start[rows]
            bits = np.unpackbits(np.frombuffer(B.expand(blob), np.uint8), count=int(size.sum())).view(bool)
            at = _phrase_places(phrases.start[rows], size)[bits]
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
        yield finish(ids, data, offsets, np.cumsum(change[:-1]) > 0)

    return B.each_block(frozen, judge, schema, round2)
