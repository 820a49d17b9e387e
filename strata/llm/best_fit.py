"""Best-fit-decreasing packing, computed on lengths and carried out by rank.

How a piece packs depends on its length alone, so the packing is computed once
on the histogram of lengths: at most ``capacity`` numbers, whatever the size of
the corpus.  Open bins with equal room form ranges of consecutive numbers; a
segment tree over the capacities finds the tightest room that fits in
logarithmic time.  The result, a table of placements of length ``L`` by rank,
equals packing the pieces one by one, longest first, over the whole corpus.

Pieces then find their place by their rank among pieces of equal length.  Ranks
are dealt in cells of each length, so no length lands in one task.

Defined results: a null or empty text is the end id alone; repeated rows and
repeated ids are packed as separate documents; null ids stay null; an empty
table gives an empty result; other columns are ignored.  A document longer than
the capacity is cut into full pieces and a rest, whatever its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import Scratch, batches

#: A length's ranks are dealt in cells of this many rows, or of more where there
#: would be over MOST_CELLS of them.
CELL_ROWS = 10_000
MOST_CELLS = 1 << 20
BATCH_BYTES = 2 << 20
PIECES = "id long, piece int, start long, length int, crc long"


class RoomTree:
    """A segment tree over capacities 0..top: which rooms have open bins."""

    def __init__(self, top: int):
        self.leaves = 1
        while self.leaves < top + 1:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += bins
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that has an open bin."""
        at = length + self.leaves
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, from rank, to rank, first bin, pieces a bin, offset).

    Best-fit decreasing puts piece after piece of one length into a bin while
    that bin, now tighter, still fits them; so a bin takes ``room // length``.
    """
    tree, ranges = RoomTree(capacity), {}
    placed, bins = [], 0

    def put_back(room: int, first: int, count: int) -> None:
        if room and count:
            ranges.setdefault(room, []).append((first, count))
            tree.add(room, count)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                room, first, count = capacity, bins, -(-left // each)
                bins += count
            else:
                first, count = ranges[room].pop()
                tree.add(room, -count)
                each = room // length
            full = min(count, left // each)
            if full:
                placed.append((length, rank, rank + full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put_back(room - each * length, first, full)
            used = full
            if left and full < count:
                placed.append((length, rank, rank + left, first + full, left, capacity - room))
                put_back(room - left * length, first + full, 1)
                rank, left, used = rank + left, 0, full + 1
            put_back(room, first + used, count - used)
    return placed


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text: str) -> DataFrame:
    """Encode whole texts, add the end id 0 and cut what is longer than a bin."""

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strata.llm.encoding import encoder, resolve

        enc = encoder(resolve(tokenizer))
        for batch in batches(it, 1, BATCH_BYTES):
            ids, bounds = enc.batch(batch.column(1), 0)
            n = np.diff(bounds)
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, length = piece * capacity, np.minimum(capacity, n[doc] - piece * capacity)
            raw = ids.astype("<u4", copy=False).data.cast("B")
            at = 4 * (bounds[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int32()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "crc"])
        enc.rest()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(encode, PIECES)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048,
         id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece, with its sequence and its place there."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.keep(cut_pieces(docs, tokenizer, capacity, id_col, text), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    each = max(CELL_ROWS, sum(histogram.values()) // MOST_CELLS)
    salts = spark.createDataFrame([(length, 1 + n // each) for length, n in histogram.items()], "length int, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn(  # one row a length, capacity of them at most
        "salt", F.pmod(F.xxhash64("id", "piece", "start", "crc"), F.col("salts")).cast("int")).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    placements = spark.createDataFrame(
        plan(histogram, capacity), "length int, low long, high long, first long, each long, used int")
    # A length has few placements; a cell gets those that its ranks meet.
    by_length = placements.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("low", "high", "first", "each", "used"))).alias("steps"))
    cells = scratch.keep(counts.select("length", "salt", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).join(
        F.broadcast(by_length), "length").select("length", "salt", "ahead", F.filter("steps", lambda s: (
            s["high"] > F.col("ahead")) & (s["low"] < F.col("ahead") + F.col("n"))).alias("steps")), "cells")
    in_cell = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "crc")
    # Rows and cells are spread by the same two columns.
    ranked = (salted.withColumn("r", F.row_number().over(in_cell) - 1).join(cells, ["length", "salt"])
              .withColumn("rank", F.col("ahead") + F.col("r")))
    step = F.filter("steps", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    found = ranked.select("id", "piece", "start", "length", "crc", "rank", step.alias("s"))
    turn = F.col("rank") - F.col("s.low")
    return found.select(
        F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        (F.col("s.first") + F.floor(turn / F.col("s.each"))).cast("long").alias("sequence_id"),
        (F.col("s.used") + turn % F.col("s.each") * F.col("length")).cast("long").alias("offset"))
