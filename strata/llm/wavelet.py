"""Token ids in wavelet-matrix files: one compressed, searchable file a shard.

A wavelet matrix keeps a sequence as bit planes, most significant bit first;
after each plane the sequence is split stably, zeros before ones.  A directory
holds the ones ahead of every BLOCK bits: rank counts inside one block, select
searches the directory and then one block.  So a file gives any token
(``access``), counts a token in a range (``count``) and finds its occurrences
(``occurrences``) from the directories and the frames of the planes that hold
the blocks it asks for; no plane is expanded.

A shard numbers its tokens by frequency, so the upper planes are nearly all
zeros, which are quick to split and compress well; the file has the numbering.

File: MAGIC, a JSON header with the length of each section, then the sections,
each compressed with zstd by itself: document ids (int64), document starts
(int64), tokens by frequency (uint32), and for every plane its directory
(uint32) and its packed bits in frames of FRAME bytes.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import Scratch, batches, get_file, open_fs, ordered_id, put_file, task_number

MAGIC = b"STRATAWM"
#: Bits of a block, bytes of a frame (whole blocks), places that are looked up at once.
BLOCK = 512
FRAME = 1 << 15
ROWS = 2048
LEVEL = 1
BATCH_BYTES = 2 << 20
#: Text bytes of a range of ids and the most ranges; tokens of a shard.  A range
#: larger than a shard writes several, so a task never holds more than one.
RANGE_BYTES = 12 << 20
MOST_RANGES = 20_000
SHARD_TOKENS = 1 << 23


class Plane:
    """Packed bits, big bit first, in frames that are loaded when they are asked for."""

    KEPT = 64

    def __init__(self, n: int, counts: np.ndarray, load: Callable[[int], np.ndarray], frame: int):
        self.n, self.counts, self.load, self.frame = n, counts, load, frame
        self.n_bytes = -(-n // 8)
        self.frames, self.read, self.held = -(-self.n_bytes // frame), 0, {}
        self.zeros = n - int(counts[-1])

    def part(self, k: int) -> np.ndarray:
        if k not in self.held:
            if len(self.held) >= self.KEPT:
                self.held.pop(next(iter(self.held)))
            self.held[k] = self.load(k)
            self.read += 1
        return self.held[k]

    def whole(self) -> np.ndarray:
        return np.concatenate([self.load(k) for k in range(self.frames)]) if self.frames else np.zeros(0, np.uint8)

    def blocks(self, block: np.ndarray) -> np.ndarray:
        """The bytes of each block, one row a block; zeros beyond the end."""
        per = BLOCK // 8
        out = np.zeros((len(block), per), np.uint8)
        at = block * per
        frame = at // self.frame
        for k in np.unique(frame[at < self.n_bytes]).tolist():
            rows = np.flatnonzero((frame == k) & (at < self.n_bytes))
            part = self.part(k)
            padded = np.concatenate((part, np.zeros(-len(part) % per, np.uint8))).reshape(-1, per)
            out[rows] = padded[(at[rows] - k * self.frame) // per]
        return out

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Rank: the ones ahead of each place."""
        block, out = at // BLOCK, np.empty(len(at), np.int64)
        for k in range(0, len(at), ROWS):
            some, b = at[k:k + ROWS], block[k:k + ROWS]
            bits = 8 * np.arange(BLOCK // 8)[None, :]
            left = np.clip(some[:, None] - b[:, None] * BLOCK - bits, 0, 8)
            mask = (0xFF00 >> left).astype(np.uint8)
            out[k:k + ROWS] = self.counts[b] + np.bitwise_count(self.blocks(b) & mask).sum(1)
        return out

    def select(self, rank: np.ndarray, bit: int) -> np.ndarray:
        """The place of the ones, or zeros, of the ranks given, from 0."""
        directory = self.counts.astype(np.int64)
        if not bit:
            directory = np.arange(len(directory)) * BLOCK - directory
        out = np.empty(len(rank), np.int64)
        for k in range(0, len(rank), ROWS):
            some = rank[k:k + ROWS]
            block = np.searchsorted(directory, some, "right") - 1
            bits = np.unpackbits(self.blocks(block), axis=1) == bit
            ahead = np.cumsum(bits, axis=1, dtype=np.int32)
            out[k:k + ROWS] = block * BLOCK + (ahead > (some - directory[block])[:, None]).argmax(1)
        return out

    def bits(self, at: np.ndarray) -> np.ndarray:
        place = at % BLOCK
        return (self.blocks(at // BLOCK)[np.arange(len(at)), place // 8] >> (7 - place % 8).astype(np.uint8)) & 1


def _plane(packed: np.ndarray, n: int) -> Plane:
    return Plane(n, _block_counts(packed), lambda k: packed[k * FRAME:(k + 1) * FRAME], FRAME)


class WaveletMatrix:
    def __init__(self, planes: list[Plane], n: int, symbols: np.ndarray):
        """symbols: the value behind each number."""
        self.n, self.planes, self.symbols = n, planes, symbols

    @property
    def frames_read(self) -> int:
        return sum(p.read for p in self.planes)

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        seen = np.bincount(values) if len(values) else np.zeros(1, np.int64)
        symbols = np.flatnonzero(seen)
        symbols = symbols[np.argsort(-seen[symbols], kind="stable")].astype(np.uint32)
        width = np.uint16 if len(symbols) <= 1 << 16 else np.uint32
        number = np.zeros(len(seen), width)
        number[symbols] = np.arange(len(symbols))
        at, planes = number[values], []
        for k in range(max(1, (len(symbols) - 1).bit_length()) - 1, -1, -1):
            ones = (at & width(1 << k)) != 0
            planes.append(_plane(np.packbits(ones), len(values)))
            # By places: a mask of random bits is several times slower.
            at = np.concatenate((at[np.flatnonzero(~ones)], at[np.flatnonzero(ones)]))
        return cls(planes, len(values), symbols)

    def values(self) -> np.ndarray:
        """The whole sequence: planes are undone from the last to the first."""
        n = self.n
        if not n:
            return np.zeros(0, np.uint32)
        at = np.zeros(n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            if plane.zeros < n:
                ones = np.unpackbits(plane.whole(), count=n).view(bool)
                back = np.empty_like(at)
                back[np.flatnonzero(~ones)] = at[:plane.zeros]
                back[np.flatnonzero(ones)] = at[plane.zeros:] | at.dtype.type(1 << k)
                at = back
        return self.symbols[at]

    def _number(self, value: int) -> int | None:
        found = np.flatnonzero(self.symbols == value)
        return int(found[0]) if len(found) else None

    def access(self, positions: np.ndarray) -> np.ndarray:
        at, out = np.asarray(positions, np.int64), np.zeros(len(positions), np.int64)
        for plane in self.planes:
            bit, ones = plane.bits(at), plane.ones(at)
            at = np.where(bit == 1, plane.zeros + ones, at - ones)
            out = out << 1 | bit
        return self.symbols[out]

    def _range(self, number: int, low: int, high: int) -> tuple[int, int]:
        for level, plane in enumerate(self.planes):
            a, b = plane.ones(np.array([low, high])).tolist()
            if number >> (len(self.planes) - 1 - level) & 1:
                low, high = plane.zeros + a, plane.zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token at positions low up to high."""
        number = self._number(value)
        if number is None:
            return 0
        a, b = self._range(number, low, self.n if high is None else high)
        return b - a

    def occurrences(self, value: int, low: int = 0, high: int | None = None) -> list[int]:
        """Positions of a token, by select on every plane from the last up."""
        number = self._number(value)
        if number is None:
            return []
        a, b = self._range(number, low, self.n if high is None else high)
        at = np.arange(a, b)
        for level in range(len(self.planes) - 1, -1, -1):
            bit, plane = number >> (len(self.planes) - 1 - level) & 1, self.planes[level]
            at = plane.select(at - plane.zeros if bit else at, bit)
        return at.tolist()


def _block_counts(packed: np.ndarray) -> np.ndarray:
    whole = -(-len(packed) // 8)
    words = np.zeros(whole * 8, np.uint8)
    words[:len(packed)] = packed
    ones = np.bitwise_count(words.view(np.uint64)).astype(np.int64)
    per = BLOCK // 64
    blocks = np.zeros(-(-whole // per) * per, np.int64)
    blocks[:whole] = ones
    return np.concatenate(([0], np.cumsum(blocks.reshape(-1, per).sum(1)))).astype(np.uint32)


def write_shard(ids: np.ndarray, starts: np.ndarray, tokens: np.ndarray) -> bytes:
    """One file: the documents' ids, their starts and the end, and the matrix."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    matrix = WaveletMatrix.build(tokens)
    sections = [pack(x.tobytes()) for x in (ids.astype("<i8"), starts.astype("<i8"), matrix.symbols.astype("<u4"))]
    for plane in matrix.planes:
        sections.append(pack(plane.counts.astype("<u4").tobytes()))
        sections += [pack(plane.load(k).tobytes()) for k in range(plane.frames)]
    header = json.dumps({"tokens": len(tokens), "documents": len(ids), "planes": len(matrix.planes), "frame": FRAME,
                         "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


def read_shard(data: bytes | Callable[[int, int], bytes]) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """A shard from its bytes, or from a function that gives some of them by
    place and number; frames are read when they are needed."""
    import zstandard

    fetch = data if callable(data) else lambda at, n: data[at:at + n]
    lead = fetch(0, 12)
    if lead[:8] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    size = struct.unpack_from("<I", lead, 8)[0]
    header = json.loads(fetch(12, size))
    ends = 12 + size + np.cumsum([0, *header["sections"]])

    def section(k: int, kind: str) -> np.ndarray:
        at, to = int(ends[k]), int(ends[k + 1])
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(fetch(at, to - at)), kind)

    planes, n = [], header["tokens"]
    each = 1 + -(-(-(-n // 8)) // header["frame"])  # a directory and its frames
    for k in range(header["planes"]):
        at = 3 + k * each
        planes.append(Plane(n, section(at, "<u4"), lambda f, at=at: section(at + 1 + f, "u1"), header["frame"]))
    return section(0, "<i8"), section(1, "<i8"), WaveletMatrix(planes, n, section(2, "<u4"))


def open_shard(uri: str) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """A shard that is read from its file piece by piece."""
    store, path = open_fs(uri)
    source = store.open_input_file(path)
    return read_shard(lambda at, n: source.read_at(n, at))


def write(docs: DataFrame, scratch: Scratch, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and write the shards; one manifest row a file.

    Ranges of ids are cut at quantiles and sorted, and each writes one shard or
    several, so the files in (range, shard) order hold the corpus in id order.
    A null id is written as the largest id, 2**63 - 1, and read back null.
    """
    key = ordered_id(id_col)
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    ranges = min(MOST_RANGES, 1 + size // RANGE_BYTES)
    if ranges > 1:
        cuts = docs.select(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
        cuts = sorted(set(cuts))
    else:
        cuts = []
    bounds = np.array(cuts, np.int64)
    folder = scratch.path("shards")

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strata.llm.encoding import encoder, resolve

        enc = encoder(resolve(tokenizer))
        narrow = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches(it, 1, BATCH_BYTES):
            ids, ends = enc.batch(batch.column(1), 0)
            width = np.dtype(narrow).itemsize
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [
                None, pa.py_buffer((width * ends).astype(np.int64)), pa.py_buffer(ids.astype(narrow))]).cast(pa.binary())
            number = np.searchsorted(bounds, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), batch.column(0), pa.array([width] * len(packed), pa.int32()), packed], names=["range", "id", "width", "ids"])
        enc.rest()

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, runs, held, here, shard = [], [], 0, None, 0

        def finish() -> pa.RecordBatch:
            tokens = np.concatenate(runs)
            starts = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
            data = write_shard(np.array(ids, np.int64), starts, tokens)
            uri = f"{folder}/range-{here:06d}-{shard:04d}-{task_number()}-{zlib.crc32(data):08x}.wm"
            put_file(uri, data)
            return pa.RecordBatch.from_arrays(
                [pa.array([here], pa.int32()), pa.array([shard], pa.int32()), pa.array([uri]), pa.array([len(ids)], pa.int64()),
                 pa.array([len(tokens)], pa.int64()), pa.array([len(data)], pa.int64())],
                names=["range", "shard", "path", "documents", "tokens", "bytes"])

        for batch in it:
            for number, doc, width, code in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if runs and (number != here or held >= SHARD_TOKENS):
                    yield finish()
                    ids, runs, held, shard = [], [], 0, shard + 1 if number == here else 0
                here = number
                ids.append(doc)
                runs.append(np.frombuffer(code, f"<u{width}"))
                held += len(runs[-1])
        if runs:
            yield finish()

    coded = docs.select(key.alias("id"), F.col(text).alias("text")).mapInArrow(
        encode, "range int, id long, width int, ids binary")
    ordered = coded.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions(
        "range", "id", F.crc32("ids"), F.octet_length("ids"))
    return scratch.keep(ordered.mapInArrow(
        build, "range int, shard int, path string, documents long, tokens long, bytes long"), "manifest")


def read(manifest: DataFrame, files: int) -> DataFrame:
    """One row a document from the files: id, start, n_tokens, ids_crc32."""

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, starts, matrix = read_shard(get_file(uri))
                whole = matrix.values().astype("<u4", copy=False).data.cast("B")
                cut = (4 * starts).tolist()
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == 2**63 - 1), pa.array(starts[:-1] + base), pa.array(np.diff(starts)),
                     pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "crc"])

    # One narrow row a shard meets here.
    before = Window.orderBy("range", "shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return based.repartition(max(1, files)).mapInArrow(decode, "id long, start long, n_tokens long, crc long")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the corpus and read it back; one row a document.

    Defined results: a null or empty text is the end id alone; an empty table
    writes no file and gives an empty result; other columns are ignored.
    """
    manifest = write(docs, Scratch(docs.sparkSession, "wavelet"), tokenizer, id_col, text)
    back = read(manifest, manifest.count())
    return back.select(F.col("id").alias(id_col), "start", "n_tokens", F.col("crc").alias("ids_crc32"))
