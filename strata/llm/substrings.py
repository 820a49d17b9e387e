"""Substring dedup by level-wise doubling of repeated windows.

Levels are window lengths: SEED words, then twice as many, and so on up to the
full window, where the last doubling is clipped.  At each level every full
window that is still a candidate is represented by the smallest hash among its
windows of the level's length, its anchor: equal full windows have equal
anchors in the same place, so a full window whose anchor stands in one document
alone is no repeat and ends there.  Only survivors are extended to the next
length, and the levels end early if none is left.  At the last level windows
that also start in a document with a smaller id are repeats, and the words that
they cover are removed.  Longer repeats are unions of these windows, so no
further level adds a word.

Full windows are compared by two hashes of 64 and 32 bits, in their block and in
their bucket; the candidates of the levels between by one of 64, where a false
hit costs a question and no word.

Defined results: words are judged on the input, whole, and windows never cross
documents; null and empty texts have no words; among rows of one id neither is
smaller, so repeated rows keep what no smaller id has; a null id counts as the
largest, 2**63 - 1, which is reserved for it, and stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import blocks as B
from strata.llm import textvec
from strata.llm.common import Scratch, get_file, put_file

WINDOW = 13
SEED = 4
_NO_ID = 2**63 - 1
_SPREAD = np.uint64(0xA0761D6478BD642F)
_SECOND = np.uint64(0xE7037ED1A0B428DB)


def levels(window: int) -> list[int]:
    """The window lengths from the seed to the full window."""
    out = [min(SEED, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class Words:
    """The words of a block, their hashes, and the full windows that are candidates."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, alive: np.ndarray | None = None):
        self.starts, self.ends, self.first = textvec.word_bounds(data, offsets, textvec.SPACE)
        self.h = textvec.word_hashes(data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        n = max(0, len(self.h) - window + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1:]) if n else np.zeros(0, np.int64)
        self.window = window
        if alive is not None:
            self.at = self.at[alive]

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each candidate: the place and hash of its anchor of this length.

        Anchors are small hashes by choice; mixed again they spread over the buckets.
        """
        grams = textvec.run_hashes(self.h, length)
        chosen = textvec.minima(grams, self.window - length + 1)[self.at]
        return chosen, textvec.mix(grams[chosen] ^ _SPREAD)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The two hashes of each candidate's full window."""
        second = textvec.run_hashes(textvec.mix(self.h ^ _SECOND), self.window)[self.at]
        return textvec.run_hashes(self.h, self.window)[self.at], (second >> np.uint64(32)).astype(np.uint32)


def distinct_anchors(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct anchor hashes, which of them several documents have, and
    the number of each candidate's anchor among them."""
    chosen, hashes = words.anchors(length)
    if not len(chosen):
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    fresh = np.concatenate(([True], chosen[1:] != chosen[:-1]))
    places, some = chosen[fresh], hashes[fresh]
    order = np.argsort(some, kind="stable")
    some, docs = some[order], words.doc[places[order]]
    first = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
    several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
    return some[first], several, np.searchsorted(some[first], hashes)


def survivors(words: Words, length: int, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """Which candidates have an anchor that several documents have."""
    known, several, number = distinct_anchors(words, length)
    return (several | gathered(answers, B.bucket_bounds(known, buckets)))[number]


def gathered(answers: dict[int, bytes], bounds: np.ndarray) -> np.ndarray:
    """The answered bits of all buckets, in the order of the hashes asked."""
    out = np.zeros(int(bounds[-1]), bool)
    for k, blob in answers.items():
        n = int(bounds[k + 1] - bounds[k])
        out[bounds[k]:bounds[k + 1]] = np.unpackbits(np.frombuffer(B.expand(blob), np.uint8), count=n).view(bool)
    return out


def _bits(mask: np.ndarray) -> bytes:
    return B.squeeze(np.packbits(mask).tobytes())


def met_elsewhere(blocks: list[int], blobs: list[bytes]) -> list[bytes]:
    """Level 1 in a bucket: does another block have this hash too?"""
    parts = [B.unpack_sorted(b) for b in blobs]
    every = np.sort(np.concatenate(parts), kind="stable")
    twice = every[1:][every[1:] == every[:-1]]
    return [_bits(_among(p, twice)) for p in parts]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def by_hash(h: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows are neighbours, in the order in which they
    came, and where a new window begins in it."""
    order = np.argsort(h, kind="stable")
    hs, ss = h[order], second[order]
    same = hs[1:] == hs[:-1]
    if (ss[1:] != ss[:-1])[same].any():  # different windows with one first hash
        order = np.lexsort((second, h))
        hs, ss = h[order], second[order]
    return order, np.concatenate(([True], (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])))[:len(h)]


def met_earlier(blocks: list[int], blobs: list[bytes]) -> list[bytes]:
    """The last level in a bucket: does a smaller document of another block have it?"""
    parts = []
    for blob in blobs:
        hashes, second, docs = B.split_blobs(blob)
        parts.append((B.unpack_sorted(hashes), np.frombuffer(second, "<u4"), B.unpack_numbers(docs)))
    h, second, d = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order, fresh = by_hash(h, second)
    first, ds = np.flatnonzero(fresh), d[order]
    least = np.repeat(np.minimum.reduceat(ds, first), np.diff(np.concatenate((first, [len(h)]))))
    earlier = np.empty(len(h), bool)
    earlier[order] = least < ds
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [_bits(part) for part in np.split(earlier, cuts)]


class Windows:
    """The distinct full windows of a block's candidates, by hash, each with the
    first document that has it, and the number of each candidate's window."""

    def __init__(self, words: Words):
        h, second = words.windows()
        order, fresh = by_hash(h, second)
        self.number = np.empty(len(h), np.int64)
        self.number[order] = np.cumsum(fresh) - 1
        some = order[fresh]
        self.h, self.second, self.least = h[some], second[some], words.doc[words.at[some]]  # documents ascend within equals


def repeats(docs: DataFrame, finish, schema: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
            carry: bool = False, trace: list[tuple[int, int]] | None = None) -> DataFrame:
    """Run ``finish(ids, data, offsets, words, covered)`` with the repeated words of
    every block marked.  ``trace`` gets each level's length and the number of
    hashes that the blocks asked about."""
    scratch = Scratch(docs.sparkSession, "substrings")
    frozen, n_bytes, _ = B.freeze(docs, scratch, id_col, text, carry)
    buckets = B.n_buckets(n_bytes)
    lengths, root, folder = levels(window), scratch.root, None

    def candidates(level: int, block: int, data: np.ndarray, offsets: np.ndarray, answers: dict[int, bytes]) -> Words:
        """What is left after the level before; each block's mask is kept as a file
        in the shared folder, so that no level is judged twice."""
        if not level:
            return Words(data, offsets, window)
        places = kept(level - 1, block) if level > 1 else None
        words = Words(data, offsets, window, places)
        keep = np.flatnonzero(survivors(words, lengths[level - 1], answers, buckets))
        left = keep if places is None else places[keep]
        alive = np.zeros(int(left[-1]) + 1 if len(left) else 0, bool)
        alive[left] = True
        put_file(f"{root}/alive{level}/{block}", B.squeeze(np.packbits(alive).tobytes()))
        words.at = words.at[keep]
        return words

    def kept(level: int, block: int) -> np.ndarray:
        """The candidates of a block that are left before a level, by number."""
        return np.flatnonzero(np.unpackbits(np.frombuffer(B.expand(get_file(f"{root}/alive{level}/{block}")), np.uint8)))

    def ask_anchors(level: int):
        def ask(grp, block, ids, data, offsets, answers) -> Iterator[pa.RecordBatch]:
            known, _, _ = distinct_anchors(candidates(level, block, data, offsets, answers), lengths[level])
            yield B.question_batch(grp, block, B.bucket_bounds(known, buckets), lambda a, b: B.pack_sorted(known[a:b]))
        return ask

    def ask_windows(grp, block, ids, data, offsets, answers) -> Iterator[pa.RecordBatch]:
        w = Windows(candidates(len(lengths) - 1, block, data, offsets, answers))
        yield B.question_batch(grp, block, B.bucket_bounds(w.h, buckets), lambda a, b: B.join_blobs(
            [B.pack_sorted(w.h[a:b]), w.second[a:b].astype("<u4").tobytes(), B.pack_numbers(ids[w.least[a:b]])]))

    for level, length in enumerate(lengths):
        full = length == window
        questions = B.each_block(frozen, ask_windows if full else ask_anchors(level), B.QUESTION, folder)
        folder = B.ask(questions, met_earlier if full else met_elsewhere, scratch, f"level{level}", buckets)
        n = B.asked(frozen, folder)
        if trace is not None:
            trace.append((length, n))
        if not n:  # no candidate is left
            break
    ended, last = not n, len(lengths) - 1

    def judge(grp, block, ids, data, offsets, answers) -> Iterator[pa.RecordBatch]:
        if ended:
            words = Words(data, offsets, window)
            yield finish(ids, data, offsets, words, np.zeros(len(words.h), bool))
            return
        words = Words(data, offsets, window, kept(last, block) if last else None)
        w = Windows(words)
        earlier = gathered(answers, B.bucket_bounds(w.h, buckets))
        hit = earlier[w.number] | (ids[w.least[w.number]] < ids[words.doc[words.at]])
        yield finish(ids, data, offsets, words, textvec.covered(len(words.h), words.at[hit], window))

    return B.each_block(frozen, judge, schema, folder)


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a document: n_words, n_removed and the hash of what is kept."""

    def finish(ids, data, offsets, words, marks) -> pa.RecordBatch:
        raw, removed, hashes = data.tobytes(), [], []
        for row in range(len(ids)):
            a, b = int(words.first[row]), int(words.first[row + 1])
            cut = marks[a:b]
            kept = raw[offsets[row]:offsets[row + 1]].split()
            removed.append(int(cut.sum()))
            if removed[-1]:
                kept = [w for w, gone in zip(kept, cut.tolist(), strict=True) if not gone]
            hashes.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == _NO_ID), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()),
             pa.array(hashes)], names=["id", "n_words", "n_removed", "kept_sha256"])

    out = repeats(docs, finish, "id long, n_words long, n_removed long, kept_sha256 string", id_col, text, window)
    return out.withColumnRenamed("id", id_col)


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, without the repeated words.

    A text that loses words becomes its kept words joined by one space; one
    that loses none stays as it is, null included.  Rows whose words are all
    repeats are left out.
    """
    whole = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{text}`").isNull().alias("_null"))
    row_type = whole.select(F.struct(*[F.col(f"`{c}`") for c in whole.columns if c != text]).alias("row")).schema["row"].dataType

    def finish(ids, data, offsets, words, marks) -> pa.RecordBatch:
        raw, texts, rows = data.tobytes(), [], []
        for row in range(len(ids)):
            cut = marks[int(words.first[row]):int(words.first[row + 1])]
            body = raw[offsets[row]:offsets[row + 1]]
            if cut.any():
                if cut.all():
                    continue
                body = b" ".join([w for w, gone in zip(body.split(), cut.tolist(), strict=True) if not gone])
            rows.append(row)
            texts.append(body.decode())
        return pa.RecordBatch.from_arrays(
            [ids.rows.take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], names=["row", "kept"])

    out = repeats(whole, finish, f"row {row_type.simpleString()}, kept string", id_col, text, window, carry=True)
    return out.select(*[
        F.when(~F.col("row._null"), F.col("kept")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
