"""Words and their hashes over Arrow text buffers, without a string per word.

A batch of texts is one UTF-8 buffer with offsets.  Hashes are polynomial over
bytes or words modulo 2**64, from random tables fixed by a seed, then mixed;
equal input gives equal hashes on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_PIECE = 1 << 18
#: Hashes are compared without their lowest bits, which hold a place instead.
_PLACES = 1 << 25
_B = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    step = np.uint64(base)
    while have < n:
        more = min(have, n - have)
        out[have:have + more] = out[:more] * step
        step = step * step
        have += more
    return out


with np.errstate(over="ignore"):
    _UP = _powers(int(_B), _PIECE + 1)
    _DOWN = _powers(pow(int(_B), -1, 2**64), _PIECE + 1)

#: White space by which words are cut: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters, which are folded later, and digits.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of the first word of each row."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~breaks[data]
    before, here = inside[:-1].copy(), inside[1:]
    before[offsets[:-1]] = 0  # a row begins as after a break
    starts = np.flatnonzero((here[:-1] == 1) & (before[:-1] == 0))
    after = inside[2:].copy()
    cut = offsets[1:] - 1
    after[cut[cut >= 0]] = 0  # and ends as before one
    ends = np.flatnonzero((inside[1:-1] == 1) & (after == 0)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A hash for each word, in pieces of the buffer so that memory stays small."""
    out = np.empty(len(starts), np.uint64)
    table = _RANDOM if fold is None else _RANDOM[fold]
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, low + _PIECE, "right")))
            high = int(ends[to - 1])
            if high - low > _PIECE:  # one very long word
                out[at] = _long(data[low:high], table)
            else:
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum(table[data[low:high]] * _UP[:high - low], out=sums[1:])
                s, e = starts[at:to] - low, ends[at:to] - low
                out[at:to] = (sums[e] - sums[s]) * _DOWN[s]
            at = to
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _long(word: np.ndarray, table: np.ndarray) -> np.uint64:
    total, scale = np.uint64(0), np.uint64(1)
    for at in range(0, len(word), _PIECE):
        part = word[at:at + _PIECE]
        total = total + scale * (table[part] * _UP[:len(part)]).sum(dtype=np.uint64)
        scale = scale * _UP[len(part)]
    return total


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive numbers, by doubling the length."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, out_n, double, length, base = None, 0, h, 1, int(_B) | 1
        while True:
            if n & length:
                if out is None:
                    out, out_n = double, length
                else:
                    scale = np.uint64(pow(base, length, 2**64))
                    out = out[:len(out) - length] * scale + double[out_n:out_n + len(out) - length]
                    out_n += length
            if 2 * length > n:
                break
            scale = np.uint64(pow(base, length, 2**64))
            double = double[:-length] * scale + double[length:]
            length *= 2
        return mix(out[:len(h) - n + 1] ^ np.uint64(n))


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest hash in every ``width`` neighbours.

    Compared by the upper bits, the first of equals wins, so equal neighbours
    choose the same place wherever they stand.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(h) > _PLACES:
        step = _PLACES - width + 1
        return np.concatenate([minima(h[at:at + _PLACES], width) + at for at in range(0, n, step)])
    low = np.uint64(_PLACES - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, 2**64 - 1, np.uint64)
    padded[:len(key)] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & low).astype(np.int64)


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places lie inside a run that begins at one of the starts."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0
