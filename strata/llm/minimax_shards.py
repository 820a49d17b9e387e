"""Sharding by minimax contiguous partition, with DataFrame functions only.

Rows with equal text form one atomic group.  Groups stand in one fixed order;
a shard is a contiguous run of them.  The capacity is the smallest for which a
greedy left-to-right fill needs no more than the wanted number of shards, found
by binary search.  The driver never sees the groups: it holds at most some ten
thousand group ends (``_Ends``), asks for finer ones only where a cut may
fall, and stops when the capacity is exact.

Order of groups: first the groups with more than 1/HEAVY of the rows (fewer
than HEAVY of them), by digest; then the others by the leading digest bits and
the digest.  A heavy group's rows are numbered in cells of about CELL_ROWS and a
light one's in its bucket, so no task gets a hot group whole.

Defined results: a null text counts as an empty one; a null id stays null and
comes last in its group; repeated rows are separate members of one group; an
empty table gives an empty result; other columns are ignored.  A group larger
than an equal share cannot be split, so its shard is as large as it is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import HEAVY, Scratch, ordered_id

OVERHEAD = 16
#: Least and most buckets of light groups; least cells of a heavy one; rows that a
#: cell is meant for.  Cells number at most MOST_BUCKETS + SALTS * HEAVY + rows / CELL_ROWS.
BUCKETS, MOST_BUCKETS = 1 << 12, 1 << 16
SALTS = 64
CELL_ROWS = 1_000_000
FIRST_CELLS = 512
FINER = 64


class _Ends:
    """Known group ends, and the open gaps that may hold more of them."""

    def __init__(self, total: int):
        self.total, self.points, self.open = total, [0, total], []

    def refine(self, found: list[tuple[int, int]], looked_into: list[tuple[int, int]]) -> None:
        """Add what was found; the gaps that were looked into hold nothing else."""
        self.points = sorted({*self.points, *(p for span in found for p in span)})
        done, gaps = set(looked_into), set()
        for low, high in [gap for gap in self.open if gap not in done] + found:
            inside = self.points[bisect_left(self.points, low):bisect_right(self.points, high)]
            gaps.update(zip(inside, inside[1:], strict=False))
        self.open = sorted(gaps)
        self.open_low = [low for low, _ in self.open]

    def below(self, x: int, hopeful: bool) -> int:
        """The greatest end up to x; hopeful: as if open gaps were full of ends."""
        if x >= self.total:
            return self.total
        if hopeful and (i := bisect_right(self.open_low, x) - 1) >= 0 and x < self.open[i][1]:
            return x
        return self.points[bisect_right(self.points, x) - 1]

    def walk(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        cuts, at = [], 0
        for _ in range(shards):
            at = self.below(at + capacity, hopeful)
            cuts.append(at)
        return cuts

    def least(self, shards: int, hopeful: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, shards, hopeful)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def balanced(self, capacity: int, shards: int) -> list[int]:
        """Cuts under the capacity, each as near an equal share as it allows."""
        need = [self.total]
        for _ in range(shards - 1):
            need.append(self.points[bisect_left(self.points, max(0, need[-1] - capacity))])
        need = need[::-1]
        cuts, at = [], 0
        for k in range(shards - 1):
            ideal = at + (self.total - at) / (shards - k)
            a = bisect_left(self.points, max(need[k], at))
            b = bisect_right(self.points, at + capacity)
            i = min(max(bisect_left(self.points, ideal), a), b - 1)
            if i > a and ideal - self.points[i - 1] <= self.points[i] - ideal:
                i -= 1
            at = self.points[i]
            cuts.append(at)
        return cuts


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id, size, text_crc32, shard, slot, group digest."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = scratch.keep(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("crc"), F.unhex(F.sha2(body, 256)).alias("digest")), "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bar = max(SALTS, n // HEAVY)
    heavy_rows = (rows.groupBy("digest").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
                  .where(F.col("n") > bar).orderBy("digest").collect())
    heavy, base, light_from = [], 0, 0
    for row in heavy_rows:
        cells = max(SALTS, row.n // CELL_ROWS)
        heavy.append((bytearray(row.digest), light_from, cells, base, base + row.bytes))
        base, light_from = base + row.bytes, light_from + cells
    hot = F.broadcast(spark.createDataFrame(heavy, "digest binary, hot long, cells long, g_start long, g_end long"))
    buckets = min(MOST_BUCKETS, max(BUCKETS, n // CELL_ROWS))
    order = ordered_id("id")
    celled = rows.join(hot, "digest", "left").withColumn("cell", F.when(
        F.col("hot").isNotNull(), F.col("hot") + F.pmod(F.xxhash64("id", F.lit(7)), "cells")
    ).otherwise(light_from + F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % buckets))
    cell = Window.partitionBy("cell")
    in_group = Window.partitionBy("cell", "digest")
    to_group = cell.orderBy("digest").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = scratch.keep(celled.select(
        "id", "size", "crc", "digest", "cell", "g_start", "g_end",
        F.sum("size").over(to_group).alias("to_end"), F.sum("size").over(in_group).alias("own"),
        (F.row_number().over(cell.orderBy("digest", order, "id")) - 1).alias("row")), "placed")
    scratch.drop("rows")
    # One row a cell; see the bound above.
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.keep(placed.groupBy("cell").agg(F.sum("size").alias("b"), F.count("*").alias("c")).select(
        "cell", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0")), "bases")
    group_end = F.coalesce("g_end", F.col("b0") + F.col("to_end"))
    group_start = F.coalesce("g_start", F.col("b0") + F.col("to_end") - F.col("own"))
    known = placed.join(F.broadcast(bases), "cell").select(
        "id", "size", "crc", "digest", group_start.alias("start"), group_end.alias("end"),
        (F.col("c0") + F.col("row")).alias("row"))
    cuts = _cuts(known, total, shards)
    number = sum(((F.col("start") >= c).cast("int") for c in cuts), F.lit(0))
    numbered = known.withColumn("shard", number)
    counts = {r["shard"]: r["n"] for r in numbered.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    first, at = [], 0
    for k in range(shards):
        first.append(at)
        at += counts.get(k, 0)
    first_row = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("shard") + 1)
    return numbered.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("row") - first_row).cast("long").alias("slot"), "digest")


def _cuts(known: DataFrame, total: int, shards: int) -> list[int]:
    if not total:
        return [0] * (shards - 1)
    ends = _Ends(total)
    step = max(1, total // (shards * FIRST_CELLS))
    where, gaps = F.lit(True), []
    while True:
        found = known.where(where).groupBy(F.floor(F.col("end") / step).alias("k")).agg(
            F.min("end").alias("low"), F.max("end").alias("high")).collect()
        ends.refine([(r.low, r.high) for r in found], gaps)
        sure, hoped = ends.least(shards, False), ends.least(shards, True)
        if sure == hoped:
            return ends.balanced(sure, shards)
        reach = list(zip(ends.walk(hoped, shards, False), ends.walk(sure, shards, True), strict=True))
        gaps = [(a, b) for a, b in ends.open if any(low <= b and a <= high for low, high in reach)]
        step = max(1, step // FINER)
        where = _inside(gaps)


def _inside(gaps: list[tuple[int, int]]):
    """Ends strictly inside one of the gaps, with neighbouring gaps joined."""
    joined: list[list[int]] = []
    for low, high in sorted(gaps):
        if joined and low <= joined[-1][1] + 1 or len(joined) > 200 and joined:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    out = F.lit(False)
    for low, high in joined:
        out = out | F.col("end").between(low, high)
    return out
