"""What the training-data operators share: scratch tables, files, hot-key joins.

Intermediate tables go below ``spark.checkpoint.dir``, the one folder that the
driver and all executors see, so a lost executor costs a task and not a job.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: list[tuple[SparkSession, str]] = []

#: A key with more than 1/HEAVY of all rows is heavy, so fewer than HEAVY keys are.
HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a local master, which
    is one machine, may go without; it gets a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="strata-shared-")
        spark.conf.set("spark.checkpoint.dir", configured)
        _ROOTS.append((spark, configured))
    if configured.startswith("/"):
        configured = "file://" + configured
    return configured.rstrip("/")


def _delete(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _sweep() -> None:
    for spark, root in _ROOTS:
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


class Scratch:
    """A folder of written tables that belongs to one operator call.

    Results read from it lazily, so it lives until the driver process ends;
    ``drop`` frees a table that no result needs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strata-{name}-{uuid.uuid4().hex[:12]}"
        _ROOTS.append((spark, self.root))

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def keep(self, df: DataFrame, tag: str, by: str | None = None, codec: str = "zstd") -> DataFrame:
        """Write df once and read it back, which also cuts its lineage."""
        writer = df.write.option("compression", codec)
        if by:
            writer = writer.partitionBy(by)
        writer.parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, tag: str) -> None:
        _delete(self.spark, self.path(tag))


def open_fs(uri: str):
    """(filesystem, path) for a folder in the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file under a temporary name, then move it into place."""
    store, path = open_fs(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def get_file(uri: str) -> bytes:
    store, path = open_fs(uri)
    with store.open_input_file(path) as src:
        return src.read()


def attach_unique(rows: DataFrame, side: DataFrame, key: str, weight: str, how: str = "left") -> DataFrame:
    """Join rows to a side with one row a key, whatever the skew of rows.

    ``weight`` counts the rows of the key in ``rows``.  Keys above 1/HEAVY of
    all rows, fewer than HEAVY by counting, are broadcast; the others meet in
    an ordinary shuffled join, where none of them is large.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    bar = max(1, total // HEAVY)
    side_columns = [c for c in side.columns if c != key]
    heavy = F.broadcast(side.where(F.col(weight) > bar)).withColumn("_hot", F.lit(True))
    marked = rows.join(heavy.select(key, "_hot"), key, "left")
    hot = marked.where(F.col("_hot")).drop("_hot").join(heavy.drop("_hot"), key)
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(
        side.where(F.col(weight) <= bar), key, how)
    return hot.select(*rows.columns, *side_columns).unionByName(cold.select(*rows.columns, *side_columns))


def ordered_id(name: str) -> Column:
    """An id for ordering: null ids come after every other id.  They take the
    largest number, 2**63 - 1, which is reserved for them: no row may have it."""
    return F.coalesce(F.col(name).cast("long"), F.lit(2**63 - 1))


def task_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def batches(it: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of one column.

    A single longer row still comes alone, whole.
    """
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(first, i - first)
                first = i
                held = 0
            held += size
        yield batch.slice(first, n - first)
