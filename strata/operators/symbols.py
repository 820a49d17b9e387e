"""Outlines and slices of code: what a file defines, and the text of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import exprs
from strata.functions.address import Address

KINDS = {"any": None, "all": None, "function": "function", "func": "function", "fn": "function",
         "class": "class", "variable": "variable", "var": "variable"}

#: Bytes of a file in which points and spans are joined.
STRETCH = 1024


def address(path: Column, dotted: Column, line: Column) -> Column:
    """``path#dotted``, or ``path#Ln`` at module level."""
    return F.concat(path, F.lit("#"), F.coalesce(dotted, F.concat(F.lit("L"), line.cast("string"))))


def outline(symbols: DataFrame, depth: int = 2, kind: str = "all") -> DataFrame:
    """Rows of a file outline in source order.

    The kind filter drops rows but not what is below them; symbols below the
    depth are counted on the row that hides them.
    """
    depth, wanted = max(1, depth), KINDS[kind]
    rows = symbols.where(F.col("depth") <= depth)
    if wanted:
        rows = rows.where(F.col("kind") == wanted)
    return rows.select(
        "path", address(F.col("path"), F.col("dotted"), F.col("start_line")).alias("address"), "name", "kind", "signature",
        "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), "depth",
        F.when(F.col("depth") < depth, 0).otherwise(F.col("descendants")).alias("hidden_children"), "ord").orderBy("path", "ord")


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def slices(symbols: DataFrame, addresses: DataFrame, signature_only: bool = False, decorators: bool = True) -> DataFrame:
    """All definitions of each (path, dotted), numbered in source order."""
    found = symbols.join(addresses.select("path", "dotted").distinct(), ["path", "dotted"])
    return _numbered(found, signature_only, decorators).orderBy("path", "dotted", "number")


def _numbered(found: DataFrame, signature_only: bool, decorators: bool) -> DataFrame:
    same = Window.partitionBy("path", "dotted")
    body = F.col("text").cast("binary")
    start = F.lit(0) if decorators else F.col("bare_at")
    end = F.col("sig_at") if signature_only else F.octet_length("text")
    first = F.col("start_line") if decorators else F.col("def_line")
    last = F.col("sig_line") if signature_only else F.col("end_line")
    signature = F.concat_ws(" ", F.array_join("decorators", " "), "signature") if decorators else F.col("signature")
    return found.select(
        "path", F.concat("path", F.lit("#"), "dotted").alias("address"), "kind", "name", "dotted", first.alias("start_line"),
        last.alias("end_line"), (last - first + 1).alias("lines"), F.trim(signature).alias("signature"),
        F.rtrim(F.substring(body, start + 1, end - start).cast("string")).alias("text"),
        F.row_number().over(same.orderBy("ord")).alias("number"), F.count("*").over(same).alias("of"))


def slice_lines(files: DataFrame, target: Address) -> DataFrame:
    """A span of lines of one file; files: path, content."""
    lines = F.split(F.regexp_replace(F.col("content").cast("string"), "\n$", ""), "\n", -1)
    rows = files.where(F.col("path") == target.path).select("path", lines.alias("l"))
    last = F.least(F.lit(target.last), F.size("l"))
    return rows.where(F.size("l") >= target.first).select(
        "path", F.concat("path", F.lit("#"), exprs.line_span(F.lit(target.first), last)).alias("address"),
        F.lit("lines").alias("kind"), exprs.line_span(F.lit(target.first), last).alias("name"),
        F.lit(target.first).alias("start_line"), last.alias("end_line"), (last - target.first + 1).alias("lines"),
        F.rtrim(F.array_join(F.slice("l", target.first, last - target.first + 1), "\n")).alias("text"))


def enclosing(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """The innermost symbol over each (path, byte): an interval join in stretches
    of its file.  Equal points have equal answers, so the join back is by point."""
    spans = symbols.where("span_end > span_start").select("path", "dotted", "span_start", "span_end", "ord").withColumn(
        "_stretch", F.explode(F.sequence(F.floor(F.col("span_start") / STRETCH), F.floor((F.col("span_end") - 1) / STRETCH))))
    places = points.select("path", "byte").distinct().withColumn("_stretch", F.floor(F.col("byte") / STRETCH))
    over = (F.col("byte") >= F.col("span_start")) & (F.col("byte") < F.col("span_end"))
    best = places.join(spans, ["path", "_stretch"]).where(over).groupBy("path", "byte").agg(
        F.max_by("dotted", F.struct("span_start", "ord")).alias("found"))
    return points.join(best, ["path", "byte"], "left").select(*points.columns, "found")


def available(symbols: DataFrame, path: str, most: int = 50) -> DataFrame:
    """What a file offers when an address is not in it, repeats counted."""
    return (symbols.where(F.col("path") == path).groupBy("dotted").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
            .orderBy("ord").limit(most).drop("ord"))
