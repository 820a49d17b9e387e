"""Frozen blocks of documents, and questions that blocks put to hash buckets.

Operators on substrings must compare every document with every other without
moving the texts around.  So the documents are written once, as rows that each
hold some megabytes of whole texts (``freeze``).  Each block then sends sorted
hashes to hash buckets (``ask``), a bucket meets all hashes of its range,
answers one bit or byte for each, and the answers go back to the block's group
as files in the shared folder, where the task that next reads the block finds
them.  What is shuffled is hashes and bits; texts stay where they are.

A hash that a third of all documents share comes once from each block, so a hot
passage costs a bucket one entry a block and not one a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, batches, open_fs, ordered_id, task_number

BLOCK_BYTES = 4 << 20
#: Text bytes whose hashes one bucket answers for, and the most buckets.  A block
#: sends each bucket one row, so both bounds keep the number of rows in hand;
#: corpora beyond their product want larger blocks and workers.
BUCKET_TEXT = 6 << 20
MOST_BUCKETS = 1 << 16
FROZEN = "grp int, block long, n_docs int, n_bytes long, texts binary"
QUESTION = "bucket int, grp int, block long, n int, blob binary"
ANSWER = "grp int, block long, bucket int, n int, blob binary"


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def freeze(docs: DataFrame, scratch: Scratch, id_col: str, text: str, carry: bool = False) -> tuple[DataFrame, int, int]:
    """Write the blocks; returns them, their text bytes and their number.

    With ``carry`` a block also holds the other columns of its rows, as ``row``.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, number = task_number(), 0
        held, size = [], 0

        def finish() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            table = table.take(pa.array(order))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays(
                [pa.array([grp], pa.int32()), pa.array([(grp << 32) + number], pa.int64()),
                 pa.array([table.num_rows], pa.int32()), pa.array([size], pa.int64()),
                 pa.array([squeeze(sink.getvalue().to_pybytes())], pa.binary())],
                names=["grp", "block", "n_docs", "n_bytes", "texts"])

        for batch in batches(it, 1, BLOCK_BYTES):
            batch = batch.set_column(1, "text", batch.column(1).cast(pa.large_binary()).fill_null(b""))
            own = pa.compute.sum(pa.compute.binary_length(batch.column(1))).as_py() or 0
            if held and size + own > BLOCK_BYTES:
                yield finish()
                held, size, number = [], 0, number + 1
            held.append(batch)
            size += own
        if held:
            yield finish()

    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")] if carry else []
    blocks = scratch.keep(docs.select(ordered_id(id_col).alias("id"), F.col(text).alias("text"), *others).mapInArrow(
        work, FROZEN), "blocks", codec="uncompressed")
    n_bytes, n_blocks = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    return blocks, n_bytes, n_blocks


class Ids(np.ndarray):
    """A block's ids; ``rows`` has the carried columns, if any."""

    rows: pa.Array | None = None


def thaw(texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids ascending, bytes, offsets) of a block."""
    from strata.llm.textvec import buffers

    table = pa.ipc.open_stream(expand(texts)).read_all().combine_chunks()
    column = table.column("text")
    column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    ids = table.column("id").to_numpy().view(Ids)
    if "row" in table.column_names:
        ids.rows = table.column("row").combine_chunks()
    return ids, *buffers(column)


def each_block(blocks: DataFrame, work: Callable, schema: str, answers: str | None = None) -> DataFrame:
    """Run ``work(grp, block, ids, data, offsets, answers)`` on every block.

    ``answers``: the folder of an ``ask``; work gets its blobs by bucket.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Answers(answers) if answers else None
        for batch in it:
            for at in range(batch.num_rows):
                grp, block = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                ids, data, offsets = thaw(batch.column(2)[at].as_py())
                yield from work(grp, block, ids, data, offsets, read.of(grp, block) if read else {})

    return blocks.select("grp", "block", "texts").mapInArrow(run, schema)


def asked(blocks: DataFrame, folder: str) -> int:
    """The number of hashes that were asked for in an ``ask``."""
    answers = blocks.sparkSession.read.schema(ANSWER).parquet(folder)
    return answers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Answers:
    """The answers to the blocks of a group, read from the shared folder."""

    def __init__(self, folder: str):
        self.folder, self.grp, self.rows = folder, None, {}

    def of(self, grp: int, block: int) -> dict[int, bytes]:
        if grp != self.grp:
            import pyarrow.parquet as pq

            self.grp, self.rows = grp, {}
            store, path = open_fs(f"{self.folder}/grp={grp}")
            from pyarrow import fs

            for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if info.is_file and info.base_name.endswith(".parquet"):
                    with store.open_input_file(info.path) as src:
                        table = pq.ParquetFile(src).read()
                    for b, k, blob in zip(*(table.column(c).to_pylist() for c in ("block", "bucket", "blob")), strict=True):
                        self.rows.setdefault(b, {})[k] = blob
        return self.rows.get(block, {})


def n_buckets(n_bytes: int) -> int:
    return min(MOST_BUCKETS, max(1, -(-n_bytes // BUCKET_TEXT)))


def bucket_bounds(h: np.ndarray, buckets: int) -> np.ndarray:
    """Cuts of sorted 64-bit hashes into equal hash ranges, buckets + 1 of them."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(h, edges), [len(h)])).astype(np.int64)


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte planes together, compressed."""
    d = np.diff(h, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(blob), np.uint8).reshape(8, -1)
    d = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    with np.errstate(over="ignore"):
        return np.cumsum(d, dtype=np.uint64)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers as byte planes above their smallest, compressed."""
    low = int(x.min()) if len(x) else 0
    y = (x.astype(np.int64) - low).astype(np.uint64)
    return low.to_bytes(8, "little", signed=True) + squeeze(np.ascontiguousarray(y.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_numbers(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(blob[8:]), np.uint8).reshape(8, -1)
    y = np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)
    return y + int.from_bytes(blob[:8], "little", signed=True)


def join_blobs(parts: list[bytes]) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return head + b"".join(parts)


def split_blobs(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob[:4], "<u4")[0])
    sizes = np.frombuffer(blob[4:4 + 4 * n], "<u4").tolist()
    out, at = [], 4 + 4 * n
    for size in sizes:
        out.append(blob[at:at + size])
        at += size
    return out


def question_batch(grp: int, block: int, bounds: np.ndarray, blobs: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """One row for each bucket that the block has hashes for."""
    used = [k for k in range(len(bounds) - 1) if bounds[k] < bounds[k + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([grp] * len(used), pa.int32()), pa.array([block] * len(used), pa.int64()),
         pa.array([int(bounds[k + 1] - bounds[k]) for k in used], pa.int32()),
         pa.array([blobs(int(bounds[k]), int(bounds[k + 1])) for k in used], pa.binary())],
        names=["bucket", "grp", "block", "n", "blob"])


def ask(questions: DataFrame, answer: Callable[[list[int], list[bytes]], list[bytes]], scratch: Scratch, tag: str, buckets: int) -> str:
    """Let each bucket answer its blocks; returns the folder of the answers.

    The partitions are as many as the buckets: their work follows the text
    behind them and not the few bytes by which they would be merged.

    ``answer(blocks, blobs)`` gives a blob for each blob, in the same order.
    """

    def meet(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        order = sorted(range(len(blocks)), key=blocks.__getitem__)
        blobs, grps = table.column("blob").to_pylist(), table.column("grp").to_pylist()
        said = answer([blocks[i] for i in order], [blobs[i] for i in order])
        bucket = table.column("bucket")[0].as_py()
        return pa.table({
            "grp": pa.array([grps[i] for i in order], pa.int32()), "block": pa.array([blocks[i] for i in order], pa.int64()),
            "bucket": pa.array([bucket] * len(order), pa.int32()), "n": table.column("n").take(pa.array(order)), "blob": pa.array(said, pa.binary())})

    answers = questions.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, ANSWER)
    answers.repartition("grp").write.partitionBy("grp").option("compression", "uncompressed").parquet(scratch.path(tag))
    return scratch.path(tag)
