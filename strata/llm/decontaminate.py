"""Benchmark decontamination by winnowing.

Every window of WINDOW consecutive words is represented by the smallest hash of
its GRAM-word grams, so a shared window always shares its fingerprint.
Training fingerprints are joined with those of the test items; each hit is
extended to the windows around it, and a window counts only if its words, not
its hashes, equal those of an item.  An item of fewer words than a window is
one window of its own length.

The test side is indexed on the driver and sent to the executors if its texts
hold at most ``BLOCK_BYTES``, which makes some hundred bytes of index a word; the
documents are then scanned in place.  A larger benchmark is never collected:
``joined`` meets its fingerprints with those of the documents in a join, extends
the hits on the documents that have some, and joins the words of these windows
with those of the items.

Defined results: null and empty texts have no words, no hits and no items;
items without words match nothing; equal items under several ids all count and
an item with a null id marks words but is not listed; repeated documents are
judged one by one; an empty table on either side gives no hits; other columns
are ignored.  Texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import textvec
from strata.llm.common import Scratch, batches

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20


def _words(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text, lower case, and their hashes."""
    data, offsets = textvec.buffers(pa.array([text], pa.string()))
    starts, ends, _ = textvec.word_bounds(data, offsets, textvec.MARKS)
    raw = textvec.LOWER[data].tobytes()
    words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return textvec.word_hashes(data, starts, ends, textvec.LOWER) if words else np.zeros(0, np.uint64), words


def _windows(words: list[bytes], n: int) -> list[bytes]:
    return [b" ".join(words[at:at + n]) for at in range(len(words) - n + 1)]


def _prints(h: np.ndarray, n: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of n words its fingerprint: the smallest gram hash in a whole
    window, the run's own hash otherwise.  (Places of the runs, fingerprints.)"""
    if n < window:
        own = textvec.run_hashes(h, n)
        return np.arange(len(own)), own
    grams = textvec.run_hashes(h, gram)
    chosen = textvec.minima(grams, window - gram + 1)
    return np.arange(len(chosen)), grams[chosen]


class Index:
    """Windows and fingerprints of test items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.exact: dict[bytes, set[str]] = {}
        runs: dict[int, set[int]] = {}
        prints: set[int] = set()
        for item, text in items:
            h, words = _words(text)
            if not words:
                continue
            n = min(window, len(h))
            for run in _windows(words, n):
                ids = self.exact.setdefault(run, set())
                if item is not None:
                    ids.add(item)
            runs.setdefault(n, set()).update(textvec.run_hashes(h, n).tolist())
            if n == window:
                prints.update(_prints(h, n, window, gram)[1].tolist())
        self.runs = {n: np.array(sorted(found), np.uint64) for n, found in runs.items()}
        self.prints = np.array(sorted(prints), np.uint64)

    def candidates(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts) of windows whose hashes equal those of an item."""
        for n, known in self.runs.items():
            if len(h) < n:
                continue
            if n == self.window:
                grams = textvec.run_hashes(h, self.gram)
                chosen = textvec.minima(grams, n - self.gram + 1)
                places = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
                hit = np.zeros(len(grams), bool)
                hit[places[_among(grams[places], self.prints)]] = True
                starts = np.flatnonzero(hit[chosen])
                if not len(starts):
                    continue
                whole = textvec.run_hashes(h, n)[starts]
            else:
                whole = textvec.run_hashes(h, n)
                starts = np.arange(len(whole))
            yield n, starts[_among(whole, known)]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def scan(data: np.ndarray, offsets: np.ndarray, index: Index) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Words of each row, its hit windows (first word, length) and its items."""
    starts, ends, first = textvec.word_bounds(data, offsets, textvec.MARKS)
    h = textvec.word_hashes(data, starts, ends, textvec.LOWER)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    hits: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    items: list[set[str]] = [set() for _ in range(rows)]
    for n, at in index.candidates(h):
        at = at[row[at] == row[at + n - 1]]
        for k in at.tolist():
            words = [textvec.LOWER[data[s:e]].tobytes() for s, e in
                     zip(starts[k:k + n].tolist(), ends[k:k + n].tolist(), strict=True)]
            found = index.exact.get(b" ".join(words))
            if found is not None:
                r = int(row[k])
                hits[r].append((k - int(first[r]), n))
                items[r] |= found
    return np.diff(first), hits, items


SPANS = "spans array<struct<low:int,high:int>>"


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open runs of words, sorted and joined."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row a document: id, n_words, hit runs of words, sorted item ids."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    out = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = f"id {out.schema['id'].dataType.simpleString()}, n_words long, {SPANS}, items array<string>"
    if size > BLOCK_BYTES:
        return joined(out, items, schema, window, gram)
    held = items.where(F.octet_length("text") > 0).collect()  # BLOCK_BYTES rows at most
    index = spark.sparkContext.broadcast(Index([(r.item, r.text) for r in held], window, gram))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1, BATCH_BYTES):
            words, hits, found = scan(*textvec.buffers(batch.column(1)), index.value)
            yield _report(batch.column(0), words, [[(a, a + n) for a, n in row] for row in hits], [sorted(row) for row in found])

    return out.mapInArrow(work, schema)


def _report(ids: pa.Array, words: np.ndarray, spans: list[list[tuple[int, int]]], items: list[list[str]]) -> pa.RecordBatch:
    spans_type = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(words, pa.int64()), pa.array([[{"low": a, "high": b} for a, b in _merge(row)] for row in spans], spans_type),
         pa.array(items, pa.list_(pa.string()))], names=["id", "n_words", "spans", "items"])


def joined(docs: DataFrame, items: DataFrame, schema: str, window: int, gram: int) -> DataFrame:
    """The same for a benchmark of any size: nothing of it is collected or broadcast.

    A fingerprint or window that many documents have is one row on the items'
    side, so Spark may split its rows.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    kept = scratch.keep(docs.select(F.monotonically_increasing_id().alias("key"), "id", "text"), "docs")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1, BATCH_BYTES):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, words = _words(text)
                n = min(window, len(words))
                if n:
                    runs, (_, prints) = _windows(words, n), _prints(h, n, window, gram)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(runs), pa.string()), pa.array([n] * len(runs), pa.int32()), pa.array(prints.view(np.int64)),
                         pa.array(runs, pa.binary())], names=["item", "n", "print", "words"])

    parts = scratch.keep(items.mapInArrow(cut, "item string, n int, print long, words binary"), "items")
    lengths = [r.n for r in parts.select("n").distinct().collect()]  # as many as a window has words, at most

    def marks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1, BATCH_BYTES):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, _ = _words(text)
                for n in lengths:
                    found = np.unique(_prints(h, n, window, gram)[1])
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key] * len(found), pa.int64()), pa.array([n] * len(found), pa.int32()),
                             pa.array(found.view(np.int64))], names=["key", "n", "print"])

    hit = kept.select("key", "text").mapInArrow(marks, "key long, n int, print long").join(
        parts.select("n", "print").distinct(), ["n", "print"], "left_semi").groupBy("key").agg(
        F.collect_list(F.struct("n", "print")).alias("prints"))

    def extend(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1, BATCH_BYTES):
            for key, text, prints in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                h, words = _words(text)
                for n in {p["n"] for p in prints}:
                    places, own = _prints(h, n, window, gram)
                    known = np.array(sorted(p["print"] for p in prints if p["n"] == n), np.int64)
                    at = places[_among(own.view(np.int64), known)].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array([n] * len(at), pa.int32()),
                         pa.array([b" ".join(words[a:a + n]) for a in at], pa.binary())], names=["key", "low", "n", "words"])

    candidates = kept.select("key", "text").join(hit, "key").select("key", "text", "prints").mapInArrow(
        extend, "key long, low int, n int, words binary")
    met = scratch.keep(candidates.join(parts.groupBy("words").agg(F.collect_set("item").alias("found")), "words").select(
        "key", "low", (F.col("low") + F.col("n")).alias("high"), "found"), "met")
    spans = met.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    listed = met.select("key", F.explode("found").alias("item")).distinct().groupBy("key").agg(
        F.array_sort(F.collect_list("item")).alias("items"))

    def report(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1, BATCH_BYTES):
            _, _, first = textvec.word_bounds(*textvec.buffers(batch.column(1)), textvec.MARKS)
            yield _report(batch.column(0), np.diff(first), [[(s["low"], s["high"]) for s in row or ()] for row in batch.column(2).to_pylist()],
                          [row or [] for row in batch.column(3).to_pylist()])

    return kept.join(spans, "key", "left").join(listed, "key", "left").select("id", "text", "spans", "items").mapInArrow(report, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the query reports of each document's hits."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["high"] - s["low"])
    return found.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a word in any item's window, with all their columns."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("body"))
    found = find(whole, benchmark, "row", "body")
    return found.where(F.size("spans") == 0).select("id.*")
