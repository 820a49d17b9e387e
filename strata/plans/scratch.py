"""Tables written once and read back, below the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a local master, which
    is one machine, may go without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="strata-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
        atexit.register(shutil.rmtree, shared.removeprefix("file://"), ignore_errors=True)
    return ("file://" + shared if shared.startswith("/") else shared).rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back; it stays as long as the folder does."""
    path = f"{shared_dir(df.sparkSession)}/strata-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
