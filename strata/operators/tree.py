"""Directory maps: languages, sizes at every prefix, entry points, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.plans.relations import Code, Docs

#: Fixed value: decorators that make a function a route, command or task.
ROUTE = r"^@[\w.]+\.(route|get|post|put|patch|delete|head|options|websocket|command|task|on_event|middleware)\b"


def languages(files: DataFrame) -> DataFrame:
    """Files and lines by language; a file that could not be read has none."""
    return files.where("error IS NULL OR error = 'syntax error'").groupBy("lang").agg(
        F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines")).orderBy("lang")


def rollup(files: DataFrame, depth: int | None = None) -> DataFrame:
    """Files and lines below every directory; the root is an empty prefix."""
    parts = F.split("path", "/")
    count = F.size(parts) if depth is None else F.least(F.size(parts), F.lit(depth + 1))
    prefixes = F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(prefixes).alias("prefix"), "lines").groupBy("prefix").agg(
        F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines")).orderBy("prefix")


def entry_points(code: Code, scripts: DataFrame | None = None) -> DataFrame:
    """(address, reason): main guards, functions named main, routes, scripts."""
    symbols = code.symbols
    guards = code.files.where("has_main_guard AND guard_line IS NOT NULL").select(
        F.concat("path", F.lit("#L"), F.col("guard_line").cast("string")).alias("address"), F.lit("__main__ guard").alias("reason"))
    at = F.concat("path", F.lit("#"), "dotted").alias("address")
    mains = symbols.where("kind = 'function' AND name = 'main'").select(at, F.lit("main function").alias("reason"))
    routes = symbols.select(at, F.explode("decorators").alias("reason")).where(F.col("reason").rlike("(?U)" + ROUTE))
    rows = guards.unionByName(mains).unionByName(routes)
    if scripts is not None:
        rows = rows.unionByName(scripts)
    return rows.distinct().orderBy("address", "reason")


def documents(docs: Docs) -> DataFrame:
    """Per document: format, entries, lines."""
    return docs.files.where("error IS NULL").select("path", "format", "entries", F.col("lines").cast("long").alias("lines")).orderBy("path")
