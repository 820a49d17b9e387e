"""Documents by address: outlines, slices and searches over node rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import exprs
from strata.functions.address import DocAddress
from strata.operators.search import matches, within


def doc_address(path: Column, node: Column) -> Column:
    return F.concat(path, F.lit("#"), node)


def outline(nodes: DataFrame, depth: int = 2) -> DataFrame:
    depth = max(1, depth)
    return nodes.where(F.col("depth") <= depth).select(
        "path", doc_address(F.col("path"), F.col("node_path")).alias("address"), "key", "kind", "summary", "start_line",
        "end_line", "depth", F.when(F.col("depth") < depth, 0).otherwise(F.col("n_desc")).alias("hidden_children"),
        "ord").orderBy("path", "ord")


def resolve(nodes: DataFrame, target: DocAddress) -> DataFrame:
    """Nodes at an address: a key step compares keys, a number the position."""
    rows = nodes.where((F.col("path") == target.path) & (F.col("depth") == len(target.steps)))
    for k, (kind, value) in enumerate(target.steps):
        rows = rows.where((F.col("steps")[k] == value) if kind == "key" else (F.col("places")[k] == value))
    return rows


def slices(rows: DataFrame, with_key: bool = False) -> DataFrame:
    """The exact text of each node from its line's start; with its key, the span
    begins at the key but ``lines`` still counts the value's own lines."""
    same = Window.partitionBy("path", "node_path")
    return rows.select(
        "path", doc_address(F.col("path"), F.col("node_path")).alias("address"), "kind",
        (F.col("entry_line") if with_key else F.col("start_line")).alias("start_line"), "end_line",
        (F.col("end_line") - F.col("start_line") + 1).alias("lines"), "summary",
        (F.col("entry_text") if with_key else F.col("slice_text")).alias("text"),
        F.row_number().over(same.orderBy("ord")).alias("number"), F.count("*").over(same).alias("of"), "ord").orderBy("path", "ord")


def find(nodes: DataFrame, pattern: str, exact: bool = False, keys: bool = True, values: bool = True,
         paths: list[str] | None = None) -> DataFrame:
    """Nodes whose key, or whose raw text if it is a scalar, matches.

    A node is one hit; a key that matches is shown before a value that does.
    """
    rows = within(nodes, paths)
    value = F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    by_key = matches(F.col("key"), pattern, exact) if keys else F.lit(False)
    by_value = (F.col("kind") == "scalar") & matches(value, pattern, exact) if values else F.lit(False)
    return rows.where(by_key | by_value).select(
        "path", doc_address(F.col("path"), F.col("node_path")).alias("address"), F.col("start_line").alias("line"),
        F.when(by_key, "key").otherwise("value").alias("where_"),
        exprs.preview(F.when(by_key, F.col("key")).otherwise(F.col("text")), 48).alias("text"), "ord").orderBy("path", "line", "ord")


def sections(texts: DataFrame) -> DataFrame:
    """Markdown sections by SQL alone; texts: path, text.

    Fences are counted down the lines, headings outside them are kept, and a
    section ends before the next heading of its level or a higher one.
    """
    lines = texts.select("path", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn(
        "body", F.regexp_replace("line", r"^[\s\p{Z}]+|\r+$", ""))
    down = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.startswith("body", F.lit("```")) | F.startswith("body", F.lit("~~~"))
    marked = lines.withColumn("open", F.sum(fence.cast("int")).over(down) % 2).where(
        (F.col("open") == 0) & ~fence & F.col("body").rlike(r"^#{1,6}( .*)?$"))
    found = marked.select(
        "path", (F.col("n") + 1).alias("line"), F.length(F.regexp_extract("body", "^#+", 0)).alias("level"),
        F.trim(F.regexp_replace(F.trim(F.regexp_replace("body", "^#+", "")), "#+$", "")).alias("title"))
    # Read upwards, so that the nearest later heading of each level is a running value.
    up = Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    later = found.withColumns({
        f"_{n}": F.last(F.when(F.col("level") <= n, F.col("line")), ignorenulls=True).over(up) for n in range(1, 7)})
    return later.select("path", "line", "level", "title", F.element_at(
        F.array(*[F.col(f"_{n}") for n in range(1, 7)]), F.col("level")).alias("next"))
