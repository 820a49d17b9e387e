"""New files of a folder into the relations, as a Structured Streaming query.

Each micro-batch parses the files that arrived and appends their wide
rows to a table; re-reading a changed file appends newer rows, and ``latest`` keeps
the newest of each path.  Spark's file stream passes over names that begin with
an underscore; trees that have such files are indexed by ``relations.build``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from strata.plans.relations import Code, parse_code

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Parse what is there and not yet read, then stop."""
    arriving = (spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.{py,pyi}").load(folder))

    def append(batch: DataFrame, number: int) -> None:
        files = batch.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
        parse_code(files).withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

    return (arriving.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest(spark: SparkSession, table: str) -> Code:
    newest = Window.partitionBy("path").orderBy(F.desc("modified"), F.desc("batch"))
    rows = spark.read.parquet(table).withColumn("_n", F.rank().over(newest))
    return Code(rows.where("_n = 1").drop("_n", "batch"))
