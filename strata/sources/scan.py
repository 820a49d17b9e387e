"""Files of a tree as rows, with the directories that never count left out."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.address import DOC_FORMATS
from strata.functions.address import doc_format as format_of
from strata.plans.scratch import keep

#: Bytes of listed files that one task opens.
TASK_BYTES = 4 << 20
#: Folders that the driver lists, that a task lists, and that a task is given to begin with.
DRIVER_FOLDERS = 1000
TASK_FOLDERS = 1000
TASK_SHARE = 20
LISTED = "path string, full string, size long, modified timestamp"
Listed = tuple[str, str, int, datetime | None]

#: Directories that are not entered, and manifest file names.
PRUNED = (
    ".git .hg .svn .strata-cache .mypy_cache .pytest_cache .ruff_cache .tox .venv __pycache__ build dist "
    "node_modules site-packages target venv").split()
MANIFESTS = (
    "Cargo.toml Pipfile build.gradle go.mod package.json pom.xml pyproject.toml requirements.txt setup.cfg setup.py "
    "tox.ini").split()


def _entered(name: str) -> bool:
    return name not in PRUNED and not (name.startswith(".") and len(name) > 1)


def _store(root: str) -> tuple[Any, str, str]:
    """(file system, path in it, what to put before its paths)"""
    from pyarrow import fs

    if "://" in root:
        return *fs.FileSystem.from_uri(root), root.split("://")[0] + "://"
    return fs.LocalFileSystem(), os.path.abspath(root), ""


def _walk(root: str, folders: list[str], wanted: Callable[[str], bool], deepest: int | None, most: int) -> tuple[list[Listed], list[str]]:
    """Wanted files in the folders and below, and the folders that are left after
    ``most``; a folder that is gone by now or refused is passed over."""
    from pyarrow import fs

    store, top, scheme = _store(root)
    cut = len(top.rstrip("/")) + 1
    out, todo = [], deque(folders)
    while todo and most:
        most -= 1
        try:
            items = store.get_file_info(fs.FileSelector(todo.popleft()))
        except (FileNotFoundError, PermissionError):
            continue
        for item in items:
            if not scheme and os.path.islink(item.path):
                continue
            place = item.path[cut:]
            if item.type == fs.FileType.Directory:
                if _entered(item.base_name) and (deepest is None or place.count("/") < deepest):
                    todo.append(item.path)
            elif item.is_file and wanted(item.base_name):
                out.append((place, scheme + item.path, item.size, item.mtime))
    return out, list(todo)


def listed_tree(spark: SparkSession, root: str, wanted: Callable[[str], bool], deepest: int | None = None) -> DataFrame:
    """(path, full, size, modified) of the files below root; a file is itself.

    Folders that are not entered, or lie below ``deepest`` levels, are never
    listed.  Spark's own file sources pass over names that begin with an
    underscore, ``__init__.py`` among them, so names are listed here and the
    executors open what is listed.  The driver lists DRIVER_FOLDERS at most; of a
    larger tree the executors list the rest in rounds, TASK_FOLDERS a task, and
    what a task leaves is dealt anew.
    """
    from pyarrow import fs

    store, top, scheme = _store(root)
    info = store.get_file_info(top)
    if info.is_file:
        listed, left = [(info.base_name, scheme + top, info.size, info.mtime)] if wanted(info.base_name) else [], []
    else:
        listed, left = _walk(root, [top] if info.type == fs.FileType.Directory else [], wanted, deepest, DRIVER_FOLDERS)
    files = spark.createDataFrame(sorted(listed), LISTED)
    if not left:
        return files.repartition(_tasks(len(listed), sum(row[2] or 0 for row in listed)))

    def below(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = [folder for batch in it for folder in batch.column(0).to_pylist()]
        found, rest = _walk(root, folders, wanted, deepest, TASK_FOLDERS)
        paths, fulls, sizes, times = zip(*found, *((None, folder, None, None) for folder in rest)) if found or rest else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(fulls, pa.string()), pa.array(sizes, pa.int64()),
             pa.array(times, pa.timestamp("us", "UTC"))], names=["path", "full", "size", "modified"])

    todo, waiting = spark.createDataFrame([(folder,) for folder in left], "folder string"), len(left)
    while waiting:
        found = keep(todo.repartition(-(-waiting // TASK_SHARE)).mapInArrow(below, LISTED), "listing")
        files = files.unionByName(found.where("path is not null"))
        todo = found.where("path is null").select(F.col("full").alias("folder"))
        waiting = todo.count()
    number, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return files.repartition(_tasks(number, size))


def _tasks(files: int, size: int) -> int:
    return max(1, min(files, size // TASK_BYTES + 1))


def opened(files: DataFrame) -> DataFrame:
    """Listed files with their content; one that cannot be read, or that is gone
    by now, is passed over."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in it:
            for k in range(batch.num_rows):
                full = batch.column(1)[k].as_py()
                try:
                    store, place = fs.FileSystem.from_uri(full) if "://" in full else (fs.LocalFileSystem(), full)
                    with store.open_input_file(place) as src:
                        body = src.read()
                except OSError:
                    continue
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [row.column(0), row.column(2), row.column(3), pa.array([body], pa.binary())],
                    names=["path", "size", "modified", "content"])

    return files.select("path", "full", "size", "modified").mapInArrow(
        read, "path string, size long, modified timestamp, content binary")


def read_tree(spark: SparkSession, root: str, wanted: Callable[[str], bool]) -> DataFrame:
    """(path, size, modified, content) of the files below root; a file is itself."""
    return opened(listed_tree(spark, root, wanted))


def _is_source(name: str) -> bool:
    return name.endswith((".py", ".pyi"))


def source_listing(spark: SparkSession, root: str) -> DataFrame:
    """The Python files of a tree, not opened yet."""
    return listed_tree(spark, root, _is_source)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """Python files of a tree; the language is by extension, as written."""
    return read_tree(spark, root, _is_source).withColumn("lang", F.lit("python"))


def doc_files(spark: SparkSession, root: str) -> DataFrame:
    """JSON, YAML and Markdown files; the format is by extension in any case."""
    return read_tree(spark, root, lambda name: format_of(name) is not None).withColumn("format", doc_format(F.col("path")))


def doc_format(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for name, kind in DOC_FORMATS.items():
        out = F.when(end == name, kind).otherwise(out)
    return out


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Build manifests at most two levels below the root."""
    return opened(listed_tree(spark, root, lambda name: name in MANIFESTS or name.startswith("requirements"), deepest=1))


def console_scripts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(address, reason) of the scripts that ``pyproject.toml`` rows declare.

    manifest: (path, text); files: (path).  A script's module is looked up as
    ``module.py``, then as ``module/__main__.py``.
    """
    lines = manifest.where(F.element_at(F.split("path", "/"), -1) == "pyproject.toml").select(
        "path", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("path", "n", F.trim("line").alias("line"))
    down = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.startswith("line", F.lit("[")), F.col("line")), ignorenulls=True).over(down)
    scripts = lines.withColumn("section", section).where(
        F.col("section").isin("[project.scripts]", "[tool.poetry.scripts]") & ~F.startswith("line", F.lit("["))
        & (F.col("line") != "") & ~F.startswith("line", F.lit("#")) & F.contains("line", F.lit("=")))
    target = F.regexp_replace(F.trim(F.regexp_replace("line", r"^[^=]*=", "")), r"^[\"']+|[\"']+$", "")
    split = scripts.select(
        F.trim(F.regexp_extract("line", r"^[^=]*", 0)).alias("name"), target.alias("target")).select(
        "*", F.replace(F.regexp_extract("target", r"^([^:]*):", 1), F.lit("."), F.lit("/")).alias("module"),
        F.regexp_extract("target", r"^[^:]*:(.*)$", 1).alias("function"))
    known = files.select(F.col("path").alias("known"))
    joined = (split.join(known.withColumnRenamed("known", "a"), F.concat("module", F.lit(".py")) == F.col("a"), "left")
              .join(known.withColumnRenamed("known", "b"), F.concat("module", F.lit("/__main__.py")) == F.col("b"), "left"))
    found = F.when(F.contains("target", F.lit(":")), F.coalesce("a", "b"))
    return joined.select(
        F.coalesce(F.concat(found, F.lit("#"), F.col("function")), F.concat("target", F.lit(" (unresolved)"))).alias("address"),
        F.concat(F.lit("console script `"), F.col("name"), F.lit("`")).alias("reason"))
