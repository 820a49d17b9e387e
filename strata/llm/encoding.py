"""Whole texts to token ids with the tokenizers library, at cache speed.

Encoding a text equals joining the encodings of its chunks wherever the
tokenizer's own pre-tokenizer is bound to cut.  Both cutters below only cut at
such places, judged from ASCII and Latin-1 neighbours alone, so they do not
depend on any library's Unicode tables.  Each distinct chunk is encoded once.
A text that may hold an added token, such as <|endoftext|>, goes to the library
whole, which finds these before the pre-tokenizer cuts.

``Encoder.batch`` cuts a whole batch at its ASCII white space by array
operations, looks the pieces up by hash, length, first and last bytes, and lays
out their ids; only pieces not met before pass through the cutters.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from strata.llm import textvec

#: Chunks longer than this are encoded but not remembered.
CHUNK_CHARS = 64
#: The memory of chunks has two generations of this many entries; the older is
#: dropped when the younger is full, and what was used meanwhile has moved over.
CACHE_ENTRIES = 300_000
#: Pieces that ``batch`` remembers, of some sixty bytes each.
PIECES = 1 << 20

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: White space on which Unicode tables of regular-expression engines differ.
_BEYOND_LATIN = re.compile("[^\x00-\xff]")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85᠎​﻿]")
#: For byte-level BPE: a space belongs to the word after it, longer runs leave
#: their last space to it; a run of Latin letters or of ASCII marks (not ')
#: ends where an ASCII character of another kind, or the text's end, follows.
_BYTE_LEVEL = re.compile(
    rf" ?[{_LETTERS}]+(?=[\s!-/:-@\[-`{{-~]|\Z)"
    r"| ?[!-&(-/:-@\[-`{-~]+(?=[\sA-Za-z0-9]|\Z)"
    r"| ?\S+|\s+(?!\S)|\s+")
#: The same white space and that of Unicode as UTF-8, but for ASCII's: lead byte,
#: second byte, range of the third byte.
_WIDE_SPACE = ((0xC2, 0x85, None), (0xC2, 0xA0, None), (0xE1, 0x9A, (0x80, 0x80)), (0xE1, 0xA0, (0x8E, 0x8E)), (0xE2, 0x80, (0x80, 0x8B)),
               (0xE2, 0x80, (0xA8, 0xAF)), (0xE2, 0x81, (0x9F, 0x9F)), (0xE3, 0x80, (0x80, 0x80)), (0xEF, 0xBB, (0xBF, 0xBF)))
#: A chunk that is one pre-token for certain, so the model alone encodes it.
_ONE = re.compile(rf" ?[{_LETTERS}]+")
#: By byte: 1 for a letter, 2 for a mark (not '); either's runs are pre-tokens of
#: their own.  Of two-byte characters those after C3 are letters, but for two.
_KIND = np.zeros(256, np.int8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: For word-end BPE, which drops white space: ASCII white space only.
_WORDS = re.compile(rf"[{_LETTERS}]+(?=[ \t-\r!-&(-/:-@\[-`{{-~]|\Z)|[^ \t-\r]+")


class _Chunks(dict):
    """Encodings by chunk; what is missing is taken from the older generation
    or encoded, and remembered."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        got = self.older.get(chunk)
        if got is None:
            got = self.encode(chunk)
        if len(chunk) <= CHUNK_CHARS:
            self[chunk] = got
        return got

    def turn(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()


class _Pieces:
    """Ids by piece of a text, under a hash, the length and the first and last
    eight bytes.  When there are too many, those go that were met once only
    since the last time, and all if that is too little."""

    def __init__(self):
        self.keys = {"h": np.zeros(0, np.uint64), "size": np.zeros(0, np.int64), "head": np.zeros(0, np.uint64), "tail": np.zeros(0, np.uint64)}
        self.first, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens, self.seen = np.zeros(0, np.uint32), np.zeros(0, bool)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of sorted hashes, and which of them are known."""
        at = np.searchsorted(self.keys["h"], h)
        at[at == len(self.keys["h"])] = 0
        return at, self.keys["h"][at] == h if len(self.keys["h"]) else np.zeros(len(h), bool)

    def add(self, keys: dict[str, np.ndarray], ids: list[int], n: list[int]) -> None:
        n = np.array(n, np.int64)
        first = len(self.tokens) + np.cumsum(n) - n
        self.tokens = np.concatenate((self.tokens, np.array(ids, np.uint32)))
        at = np.searchsorted(self.keys["h"], keys["h"])
        self.keys = {k: np.insert(v, at, keys[k]) for k, v in self.keys.items()}
        self.first, self.n, self.seen = np.insert(self.first, at, first), np.insert(self.n, at, n), np.insert(self.seen, at, False)

    def keep(self) -> None:
        slots = np.flatnonzero(self.seen)
        if 4 * len(slots) > 3 * len(self.n):
            slots = slots[:0]
        self.tokens = self.tokens[_places(self.first[slots], self.n[slots])]
        self.keys = {k: v[slots] for k, v in self.keys.items()}
        self.n = self.n[slots]
        self.first = np.cumsum(self.n) - self.n
        self.seen = np.zeros(len(slots), bool)


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Every place of runs of n that begin at first, one run after another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    With ``literal`` the library is told to read added tokens as any other text;
    the operators leave it at its default, which is to find them.
    """

    def __init__(self, path: str, literal: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = None
        if literal:
            self.tokenizer.encode_special_tokens = True
        elif tokens := self.tokenizer.get_added_tokens_decoder():
            # Whatever the case: some tokenizers match them in lowered text.
            self.added = re.compile("|".join(re.escape(t.content) for t in tokens.values()), re.IGNORECASE)
        self.byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.cutter = _BYTE_LEVEL if self.byte_level else _WORDS
        self.model = self.tokenizer.model
        # How the library itself writes letters and the space as bytes.
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        letters = [chr(c) for c in range(256) if re.fullmatch(f"[{_LETTERS}]", chr(c))]
        self.spelling = {ord(c): spell(c)[0][0] for c in letters}
        if self.byte_level:
            self.spelling[32] = spell(" a")[0][0][0]
        self.known = _Chunks(self.chunk)
        self.pieces = _Pieces()

    def chunk(self, chunk: str) -> bytes:
        """One chunk; a word of letters goes to the model without detours."""
        if len(chunk) <= CHUNK_CHARS and _ONE.fullmatch(chunk):
            word = chunk if self.byte_level else chunk.lower()
            return array("I", [t.id for t in self.model.tokenize(word.translate(self.spelling))]).tobytes()
        return self.whole(chunk)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def cut(self, text: str) -> list[str] | None:
        if _ODD_SPACE.search(text) or (self.added and self.added.search(text)):
            return None
        if not self.byte_level and not _BEYOND_LATIN.search(text):
            text = text.lower()  # as the tokenizer does; here letter by letter
        return self.cutter.findall(text)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        self.known.turn()
        get, out = self.known.__getitem__, []
        for text in texts:
            cut = self.cut(text)
            out.append(self.whole(text) if cut is None else b"".join(map(get, cut)))
        return out

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and their bounds;
        null is an empty text."""
        data, offsets = textvec.buffers(texts)
        starts, ends, kind = self._cut(data, offsets)
        first = np.searchsorted(starts, offsets)
        body = data if self.byte_level else textvec.LOWER[data]  # the other tokenizer lowers its text
        size = ends - starts
        h = textvec.word_hashes(body, starts, ends)
        keys = {"h": h, "size": size, "head": _eight(body, starts, size, False), "tail": _eight(body, starts, size, True)}
        order = np.argsort(h)
        sorted_h = h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = sorted_h[1:] != sorted_h[:-1]
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(fresh) - 1
        some = order[fresh]  # a piece of each hash
        _, known = self.pieces.find(h[some])
        new = some[~known]
        if len(new):
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            odd = np.concatenate(([0], np.cumsum(kind != 1)))
            begin = starts[new] + (data[starts[new]] == 0x20)
            pure = (odd[ends[new]] == odd[begin]) & (size[new] <= CHUNK_CHARS)
            self.pieces.add({k: v[new] for k, v in keys.items()}, *self._fresh(words, pure.tolist()))
        slots, _ = self.pieces.find(h[some])
        slot, row = slots[number], np.repeat(np.arange(len(texts)), np.diff(first))
        # Rows to be encoded by the cutters: a piece with the hash of another, and what the cut above does not judge.
        alone = np.zeros(len(texts), bool)
        for k in ("size", "head", "tail"):
            alone[row[self.pieces.keys[k][slot] != keys[k]]] = True
        alone |= self._doubtful(data, offsets)
        n = np.insert(self.pieces.n[slot], first[1:], 1)  # the end id
        begin = np.insert(self.pieces.first[slot], first[1:], len(self.pieces.tokens))
        ids = np.append(self.pieces.tokens, np.uint32(end))[_places(begin, n)]
        bounds = np.concatenate(([0], np.cumsum(n)))[first + np.arange(len(first))]
        self.pieces.seen[slots[known]] = True
        if len(self.pieces.n) > PIECES:
            self.pieces.keep()
        return (ids, bounds) if not alone.any() else self._mended(texts, ids, bounds, alone, end)

    def _fresh(self, words: list[str], pure: list[bool]) -> tuple[list[int], list[int]]:
        """Ids of pieces, one after another, and their number; a pure one is a run
        of letters, which the model encodes without detours."""
        ids, n, tokenize, space = [], [], self.model.tokenize, self.spelling.get(32, "")
        for word, letters in zip(words, pure, strict=True):
            if letters:
                word = word if self.byte_level else word.lower()
                word = word.replace(" ", space) if word.isascii() else word.translate(self.spelling)
                got = [t.id for t in tokenize(word)]
            else:
                got = array("I", self.encode((word,))[0])
            ids += got
            n.append(len(got))
        return ids, n

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces in the order of the text: runs of letters, of marks, and what
        is left of words.  Where white space is not dropped, a word takes the
        space before it, and of the white space before that all but its last
        character is one piece.  Also what each byte is, as in _KIND."""
        starts, ends, first = textvec.word_bounds(data, offsets, textvec.SPACE)
        if self.byte_level:
            starts, ends = self._spaced(data, offsets, starts, ends, first)
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[_LATIN[data[lead + 1]]]
        kind[lead] = kind[lead + 1] = 1
        inner = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1
        at = np.searchsorted(starts, inner, "right")
        inside = (starts[at - 1] < inner) & (inner < ends[at - 1])  # not where one text ends and the next begins
        inner, at = inner[inside], at[inside]
        return np.insert(starts, at, inner), np.insert(ends, at - 1, inner), kind

    def _spaced(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        before = np.empty_like(starts)  # where the white space before a word begins
        before[1:] = ends[:-1]
        before[first[:-1][np.diff(first) > 0]] = offsets[:-1][np.diff(first) > 0]
        gap = starts - before
        last = np.where(gap > 0, data[starts - 1], 0)
        begin = starts - (last == 0x20)
        single = np.flatnonzero((gap > 0) & (last != 0x20))
        longer = np.flatnonzero(gap > 1)
        tail = offsets[:-1].copy()  # white space at the end of a row
        tail[row] = ends  # the last word of a row is written last
        tailed = np.flatnonzero(tail < offsets[1:])
        more = np.concatenate((starts[single] - 1, before[longer], tail[tailed]))
        upto = np.concatenate((starts[single], starts[longer] - 1, offsets[1:][tailed]))
        order = np.argsort(more)
        more, upto = more[order], upto[order]
        at = np.searchsorted(begin, more)
        return np.insert(begin, at, more), np.insert(ends, at, upto)

    def _doubtful(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with white space beyond ASCII or what may begin an added token."""
        hits = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
        if len(data) > 1:
            for lead, second, third in _WIDE_SPACE:
                at = np.flatnonzero((data[:-1] == lead) & (data[1:] == second))
                if third and len(at):
                    after = data[np.minimum(at + 2, len(data) - 1)]
                    at = at[(after >= third[0]) & (after <= third[1])]
                hits.append(at)
            if self.added:
                low = textvec.LOWER[data]
                for token in self.tokenizer.get_added_tokens_decoder().values():
                    lead = token.content.lower().encode()[:2]
                    hits.append(np.flatnonzero((low[:-1] == lead[0]) & (low[1:] == lead[-1])) if len(lead) > 1 else np.flatnonzero(low == lead[0]))
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.concatenate(hits), "right") - 1] = True
        return out

    def _mended(self, texts: pa.Array, ids: np.ndarray, bounds: np.ndarray, alone: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        parts, n, at = [], np.diff(bounds), 0
        for row in np.flatnonzero(alone).tolist():
            own = np.frombuffer(self.encode([texts[row].as_py() or ""])[0], np.uint32)
            parts += [ids[bounds[at]:bounds[row]], own, np.array([end], np.uint32)]
            n[row], at = len(own) + 1, row + 1
        parts.append(ids[bounds[at]:])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(n)))

    def rest(self) -> None:
        """Between tasks, keep no more than one generation."""
        if len(self.known) + len(self.known.older) > CACHE_ENTRIES:
            self.known.older = {}


def _eight(data: np.ndarray, starts: np.ndarray, size: np.ndarray, last: bool) -> np.ndarray:
    """The first or last eight bytes of each piece, or as many as it has, as a number."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    windows = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    found = windows[starts + np.maximum(size - 8, 0) if last else starts]
    return found & (np.uint64(2**64 - 1) >> (8 * np.maximum(8 - size, 0)).astype(np.uint64))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, literal=False)
    return _ENCODERS[path]


def resolve(name: str) -> str:
    """A tokenizer file by its public name or its path, looked up on the executor."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
