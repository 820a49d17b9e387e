"""MinHash near-dedup: minima, bands, verification, components.

1. Each document's set of shingles gives rows * bands minima under
   universal hash functions.  Documents with equal sets form a class; only its
   smallest id goes on, so a hot group of copies is one row from here.
2. Classes that agree in all rows minima of a band are linked to the smallest
   of the band, which makes stars and not all pairs; large-star and small-star
   turn them into candidate groups.
3. Inside a candidate group every class is compared with the group's centre, its
   least id, on the full sets; those linked with it are settled.  The others are
   screened against all by their signatures and confirmed on the full sets.
   Groups above BLOCK_BYTES are cut into blocks of that size by their distance
   from the centre; pairs of blocks that the triangle inequality cannot rule out
   are tasks of their own (``large_links``), and a task holds two blocks.  A
   task returns a spanning forest of the confirmed links of its pairs, which
   keeps every component.
4. The forests' components are the result.

Shingle size and threshold are parameters; bands and screen follow from the
threshold.  A pair at it shares no band with a chance of about 3e-7 and fails
the screen, set six deviations below, with one of about 1e-9; no other step
loses a link.  Group sizes, partners and candidates are not capped.

Defined results: null and empty texts have an empty set and are linked with
nothing; a text of fewer words than a
shingle is one shingle; rows that share an id are
one node, linked if any of their texts is; a null id stays null and comes last
(the id 2**63 - 1 is reserved for it, here and in the other operators);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import textvec
from strata.llm.common import Scratch, attach_unique, batches, get_file, ordered_id, put_file
from strata.llm.components import components

SHINGLE = 3
PERCENT = 85
#: Minima of a signature at most, the chance that a pair at the threshold meets
#: in no band, and the deviations between the threshold and the screen.
MINIMA = 192
MISSED = 3e-7
DEVIATIONS = 5.8
#: Sets and signatures of a block; larger groups are cut into blocks.
BLOCK_BYTES = 2 << 20
#: Sets and signatures that one task of small groups confirms, on average.
TASK_BYTES = 2 << 20
#: Rows whose signatures are compared at once, columns of an incidence matrix.
LEFT, RIGHT, COLUMNS = 128, 512, 4096
#: Partitions of block pairs at most; a partition takes its pairs one by one.
MOST_TASKS = 20_000
SEEN = 100_000
BATCH_BYTES = 2 << 20
_NO_ID = 2**63 - 1
_DRAW = np.random.Generator(np.random.PCG64(85))
_A = _DRAW.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_C = _DRAW.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)


def banding(percent: int) -> tuple[int, int, int]:
    """Minima a band, bands, and the equal minima that the screen asks for: the
    longest bands that MINIMA has enough of."""
    share = percent / 100
    for rows in range(MINIMA, 0, -1):
        chance = share**rows
        bands = math.ceil(math.log(MISSED) / math.log1p(-chance)) if chance < 1 else 1
        if rows * bands <= MINIMA:
            n = rows * bands
            return rows, bands, max(0, int((share - DEVIATIONS * math.sqrt(share * (1 - share) / n)) * n))
    raise ValueError(f"{percent} percent wants more than {MINIMA} minima")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after another, and bounds."""
    starts, ends, first = textvec.word_bounds(data, offsets, textvec.SPACE)
    h = textvec.word_hashes(data, starts, ends, textvec.LOWER)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(h) - size + 1)
    at = np.flatnonzero(row[:n] == row[size - 1:]) if n else np.zeros(0, np.int64)
    owner, value = [row[at]], [textvec.run_hashes(h, size)[at]] if n else [np.zeros(0, np.uint64)]
    for short in range(1, size):  # the whole sequence as one
        rows = np.flatnonzero(counts == short)
        if len(rows):
            owner.append(rows)
            value.append(textvec.run_hashes(h, short)[first[rows]])
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[fresh], value[fresh]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def signatures(value: np.ndarray, bounds: np.ndarray, minima: int) -> np.ndarray:
    """The minima of each row, 16 bits of each; rows without shingles are zero."""
    out = np.zeros((len(bounds) - 1, minima), np.uint16)
    rows = np.flatnonzero(np.diff(bounds))
    if len(rows):
        x, begin = (value >> np.uint64(32)).astype(np.uint32), bounds[rows]
        for k in range(minima):
            least = np.minimum.reduceat(x * _A[k] + _C[k], begin)
            out[rows, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


def sketch(docs: DataFrame, id_col: str, text: str, shingle: int, minima: int) -> DataFrame:
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1, BATCH_BYTES):
            value, bounds = shingle_sets(*textvec.buffers(batch.column(1)), shingle)
            marks = signatures(value, bounds, minima)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds), pa.int64()),
                 pa.array([_digest(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                 pa.array([m.tobytes() for m in marks], pa.binary())], names=["id", "n", "digest", "sig"])

    return docs.select(ordered_id(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(
        work, "id long, n long, digest binary, sig binary")


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return np.array([self.root(x) for x in rows.tolist()], np.int64)


class Sets:
    """Shingle sets and signatures of some classes, as Arrow has them, in the order of their ids."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("id")
        self.table, self.ids = table, table.column("id").to_numpy()
        self.value, bounds = _numbers(table.column("shingles"), np.uint64)
        self.bounds, self.sizes = bounds, np.diff(bounds)
        marks, ends = _numbers(table.column("sig"), np.uint16)
        self.marks = marks.reshape(len(self.ids), -1) if len(ends) > 1 else marks.reshape(0, 1)

    def __len__(self) -> int:
        return len(self.ids)

    def of(self, row: int) -> np.ndarray:
        return self.value[self.bounds[row]:self.bounds[row + 1]]


def _numbers(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = textvec.buffers(column.combine_chunks())
    return data.view(kind), offsets // np.dtype(kind).itemsize


def shared_with(one: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one sorted set with each of many."""
    at = np.searchsorted(one, value)
    at[at == len(one)] = 0
    sums = np.concatenate(([0], np.cumsum(one[at] == value)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _similar(both: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (left + right - both)


def _shared(s: Sets, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all left with all right rows, by products of
    incidence matrices over the shingles that both sides have."""
    parts = []
    for rows in (left, right):
        value = np.concatenate([s.of(r) for r in rows.tolist()])
        parts.append((value, np.repeat(np.arange(len(rows)), s.sizes[rows])))
    common = np.intersect1d(parts[0][0], parts[1][0])
    cells = []
    for value, owner in parts:
        at = np.minimum(np.searchsorted(common, value), max(0, len(common) - 1))
        keep = common[at] == value if len(common) else np.zeros(len(value), bool)
        column, owner = at[keep], owner[keep]
        order = np.argsort(column, kind="stable")
        cells.append((column[order], owner[order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), COLUMNS):
        dense = []
        for (column, owner), n in zip(cells, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(column, [at, at + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(common) - at)), np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T  # whole numbers below 2**24 are exact
    return out.astype(np.int64)


def link(s: Sets, left: np.ndarray, right: np.ndarray, forest: Forest, percent: int, least: int) -> Iterator[tuple[int, int]]:
    """Links of left with right rows, but for those between rows that are connected
    already.  A pair of rows that both sides have is taken once."""
    among = np.zeros(len(s), bool)
    among[left] = True
    for a in (left[k:k + LEFT] for k in range(0, len(left), LEFT)):
        for b in (right[k:k + RIGHT] for k in range(0, len(right), RIGHT)):
            roots, others = forest.roots(a), forest.roots(b)
            if len(np.unique(np.concatenate((roots, others)))) == 1:
                continue
            same = (s.marks[a][:, None, :] == s.marks[b][None, :, :]).sum(2, dtype=np.uint16)
            i, j = np.nonzero(same >= least)
            x, y = s.sizes[a][i], s.sizes[b][j]
            keep = (roots[i] != others[j]) & (~among[b][j] | (a[i] < b[j])) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            i, j, x, y = i[keep], j[keep], x[keep], y[keep]
            if len(i) > 4 * (len(a) + len(b)):
                linked = _similar(_shared(s, a, b)[i, j], x, y, percent)
                pairs = zip(a[i[linked]].tolist(), b[j[linked]].tolist(), strict=True)
            else:
                pairs = ((u, v) for u, v in zip(a[i].tolist(), b[j].tolist(), strict=True)
                         if forest.root(u) != forest.root(v) and _similar(
                             len(np.intersect1d(s.of(u), s.of(v), assume_unique=True)), s.sizes[u], s.sizes[v], percent))
            for u, v in pairs:
                if forest.join(u, v):
                    yield u, v


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})


def group_links(s: Sets, percent: int, least: int) -> list[tuple[int, int]]:
    """A spanning forest of a group's links: first those of the centre, its least
    id, then those of the classes that are not linked with it."""
    forest, out = Forest(len(s)), []
    near = np.flatnonzero(_similar(shared_with(s.of(0), s.value, s.bounds), s.sizes[0], s.sizes, percent))
    out += [(int(s.ids[0]), int(s.ids[r])) for r in near.tolist() if forest.join(0, r)]
    rest = np.setdiff1d(np.arange(1, len(s)), near)
    out += [(int(s.ids[u]), int(s.ids[v])) for u, v in link(s, rest, np.arange(len(s)), forest, percent, least)]
    return out


def _confirmer(percent: int, least: int) -> Callable[[pa.Table], pa.Table]:
    def confirm(table: pa.Table) -> pa.Table:
        """The whole groups of one bucket."""
        table = table.combine_chunks()
        groups = table.column("grp").to_numpy()
        order = np.argsort(groups, kind="stable")
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
            out += group_links(Sets(_once(table.take(pa.array(rows)))), percent, least)
        return _edges(out)

    return confirm


def _once(table: pa.Table) -> pa.Table:
    """One row of each id and set: repeated rows are one node."""
    rows = {key: k for k, key in enumerate(zip(*(table.column(c).to_pylist() for c in ("id", "digest")), strict=True))}
    return table if len(rows) == table.num_rows else table.take(pa.array(sorted(rows.values())))


def _set_of(folder: str, name: str) -> np.ndarray:
    return np.frombuffer(get_file(f"{folder}/{name}"), np.uint64)


def large_links(full: DataFrame, scratch: Scratch, percent: int, least: int) -> DataFrame:
    """Links of the groups above BLOCK_BYTES, as (u, v).

    Every class is compared with its group's centre, whose set is a file in the
    shared folder.  Those linked with it are one component.  The others lie
    in blocks of equal distance, and a block of theirs is compared with every
    block that the triangle inequality (Jaccard distance is a metric) does not
    rule out.  Blocks are files as well, so a task holds two of them at most
    and no set is sent twice through a shuffle.
    """
    folder, far = scratch.path("large"), 10 * (100 - percent) + 2

    def note(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for grp, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                put_file(f"{folder}/centre-{grp}", values)
            yield batch.select(["grp"])

    centres = full.where("id = grp").groupBy("grp").agg(F.min(F.struct("digest", "shingles")).alias("c")).select("grp", "c.shingles")
    scratch.keep(centres.mapInArrow(note, "grp long"), "centres")

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in it:
            linked, far_off = [], []
            for grp, values in zip(batch.column("grp").to_pylist(), batch.column("shingles"), strict=True):
                if grp not in known:
                    if len(known) > 64:
                        known.clear()
                    known[grp] = _set_of(folder, f"centre-{grp}")
                own = np.frombuffer(values.as_buffer(), np.uint64)
                both = len(np.intersect1d(own, known[grp], assume_unique=True))
                union = len(own) + len(known[grp]) - both
                linked.append(100 * both >= percent * union)
                far_off.append(1000 * (union - both) // union + (not linked[-1]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "digest", "sig", "shingles", "grp")), pa.array(linked), pa.array(far_off, pa.int32())],
                names=["id", "digest", "sig", "shingles", "grp", "linked", "q"])

    measured = scratch.keep(full.select("id", "digest", "sig", "shingles", "grp").mapInArrow(
        measure, "id long, digest binary, sig binary, shingles binary, grp long, linked boolean, q int"), "measured")
    cell = F.struct("grp", "linked", "q").alias("cell")
    sizes = measured.select(cell, (F.octet_length("shingles") + F.octet_length("sig")).alias("bytes")).groupBy("cell").agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    # At most a thousand distances a group meet in a window.
    before = Window.partitionBy("cell.grp", "cell.linked").orderBy("cell.q").rowsBetween(Window.unboundedPreceding, -1)
    cells = scratch.keep(sizes.select(
        "cell", "n", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / BLOCK_BYTES).alias("first"),
        F.ceil(F.col("bytes") / BLOCK_BYTES).alias("parts")), "cells")
    dealt = attach_unique(measured.withColumn("cell", cell), cells, "cell", "n", "inner").withColumn(
        "block", F.col("first") + F.pmod(F.xxhash64("id", "digest"), F.col("parts")))

    def write(table: pa.Table) -> pa.Table:
        grp, linked, block = (table.column(c)[0].as_py() for c in ("grp", "linked", "block"))
        sink = pa.BufferOutputStream()
        rest = _once(table.select(["id", "digest", "sig", "shingles"]).combine_chunks())
        with pa.ipc.new_stream(sink, rest.schema) as out:
            out.write_table(rest)
        put_file(f"{folder}/{grp}-{int(linked)}-{block}", sink.getvalue())
        q = table.column("q").to_numpy()
        return pa.table({"grp": [grp], "linked": [linked], "block": [block], "low": pa.array([q.min()], pa.int32()), "high": pa.array([q.max()], pa.int32())})

    blocks = scratch.keep(dealt.select("id", "digest", "sig", "shingles", "grp", "linked", "q", "block").groupBy(
        "grp", "linked", "block").applyInArrow(write, "grp long, linked boolean, block long, low int, high int"), "blocks")
    a, b = blocks.where("not linked").alias("a"), blocks.alias("b")
    pairs = scratch.keep(a.join(b, F.col("a.grp") == F.col("b.grp")).where(
        (F.col("b.linked") | (F.col("b.block") >= F.col("a.block")))
        & (F.col("b.low") <= F.col("a.high") + far) & (F.col("a.low") <= F.col("b.high") + far)).select(
        "a.grp", F.col("a.block").alias("i"), F.col("b.linked").cast("int").alias("linked"), F.col("b.block").alias("j")), "pairs")

    def read(name: str) -> pa.Table:
        return pa.ipc.open_stream(get_file(f"{folder}/{name}")).read_all()

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for grp, i, linked, j in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                parts = [read(f"{grp}-0-{i}")] + ([] if (i, 0) == (j, linked) else [read(f"{grp}-{linked}-{j}")])
                both = pa.concat_tables([p.append_column("side", pa.array([k] * len(p), pa.int8())) for k, p in enumerate(parts)])
                s = Sets(both)
                side = s.table.column("side").to_numpy()
                forest = Forest(len(s))
                right = np.flatnonzero(side == len(parts) - 1)
                if linked:
                    for r in right[1:].tolist():
                        forest.join(int(right[0]), r)
                found = [(int(s.ids[u]), int(s.ids[v])) for u, v in link(s, np.flatnonzero(side == 0), right, forest, percent, least)]
                yield from _edges(found).to_batches()

    compared = pairs.repartition(max(1, min(pairs.count(), MOST_TASKS))).mapInArrow(compare, "u long, v long")
    return compared.unionByName(measured.where("linked").select(F.col("id").alias("u"), F.col("grp").alias("v")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept.

    Linked are documents whose sets of ``shingle``-word shingles have a Jaccard
    similarity of ``percent`` hundredths or more.
    """
    per_band, n_bands, least_equal = banding(percent)
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = scratch.keep(sketch(docs, id_col, text, shingle, per_band * n_bands), "rows")
    full = rows.where("n > 0")
    classes = scratch.keep(full.groupBy("digest").agg(
        F.min(F.struct("id", "sig")).alias("least"), F.first("n").alias("n"), F.count("*").alias("members")).select(
        "digest", F.col("least.id").alias("id"), F.col("least.sig").alias("sig"), "n", "members"), "classes")
    width = 2 * per_band
    bands = classes.select("id", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(n_bands - 1)),
        lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))).alias("band"))
    hubs = scratch.keep(bands.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    stars = attach_unique(bands, hubs, "band", "n", "inner").select(F.col("id").alias("u"), F.col("hub").alias("v"))
    grouped = components(stars, scratch, "cc")
    least = grouped.groupBy("v").agg(F.count("*").alias("n"))
    nodes = scratch.keep(grouped.select(F.col("u").alias("id"), F.col("v").alias("grp")).unionByName(
        least.select(F.col("v").alias("id"), F.col("v").alias("grp"))), "nodes")
    weight = 8 * F.col("n") + 2 * per_band * n_bands
    sizes = scratch.keep(classes.select("id", "n").join(nodes, "id").groupBy("grp").agg(
        F.count("*").alias("size"), F.sum(weight).alias("bytes")), "sizes")
    dealt = attach_unique(nodes, sizes, "grp", "size", "inner")
    picked = classes.select(F.col("id").alias("node"), "id", "digest", "sig").join(dealt, "id")
    wide = picked.drop("id").join(docs.select(ordered_id(id_col).alias("node"), F.col(text).alias("text")), "node")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()  # repeated rows of an id mostly stand together
        for batch in batches(it, 1, BATCH_BYTES):
            value, bounds = shingle_sets(*textvec.buffers(batch.column(1)), shingle)
            parts = [value[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            keep = []
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if key not in seen and _digest(parts[k]) == key[1]:
                    keep.append(k)
                    seen.add(key)
            if len(seen) > SEEN:
                seen.clear()
            if keep:
                take = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [take.column(0), *(take.column(c) for c in (2, 3, 4, 5)), pa.array([parts[k].tobytes() for k in keep], pa.binary())],
                    names=["id", "digest", "sig", "grp", "bytes", "shingles"])

    full = scratch.keep(wide.select("node", "text", "digest", "sig", "grp", "bytes").mapInArrow(
        sets, "id long, digest binary, sig binary, grp long, bytes long, shingles binary"), "sets")
    small, large = sizes.where(F.col("bytes") <= BLOCK_BYTES), sizes.where(F.col("bytes") > BLOCK_BYTES)
    tasks = 1 + (small.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] // TASK_BYTES)
    links = full.where(F.col("bytes") <= BLOCK_BYTES).withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(tasks))).select(
        "task", "id", "digest", "sig", "grp", "shingles").groupBy("task").applyInArrow(_confirmer(percent, least_equal), "u long, v long")
    if not large.isEmpty():
        links = links.unionByName(large_links(full.where(F.col("bytes") > BLOCK_BYTES), scratch, percent, least_equal))
    found = components(links, scratch, "final")
    settled = classes.select("digest", "id", "members").join(
        found.select(F.col("u").alias("id"), F.col("v").alias("least")), "id", "left").select(
        "digest", F.coalesce("least", "id").alias("component"), "members")
    told = attach_unique(rows.where("n > 0").select("id", "n", "digest"),
                         scratch.keep(settled, "settled"), "digest", "members", "inner").select("id", "n", "component")
    every = told.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return every.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("component") != _NO_ID, F.col("component")).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"))
