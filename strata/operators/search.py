"""Search by kind of occurrence, and literals grouped by value."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import exprs
from strata.functions.address import Address
from strata.operators.symbols import address

OCCURRENCES = {"any": None, "all": None, "definition": "definition", "def": "definition", "call": "call",
               "reference": "reference", "ref": "reference"}
LITERAL_KINDS = {"all": None, "any": None, "string": "string", "str": "string", "number": "number", "num": "number",
                 "regex": "regex", "re": "regex"}
CAP = 5000
#: Values whose counts are sent to every task, and their characters at most.
FREQUENT, SHORT = 1000, 1000


class PatternError(ValueError):
    """A pattern that the dialect does not have."""


def matches(text: Column, pattern: str, exact: bool = False) -> Column:
    """Whole equality, or a search; classes are Unicode, and look-around and
    back-references, which need backtracking, are refused."""
    if exact:
        return text == pattern
    if re.search(r"\(\?(?:=|!|<=|<!)|\\[1-9]|\(\?P=|\\k<", re.sub(r"\\\\", "", pattern)):
        raise PatternError(f"pattern `{pattern}`: look-around and back-references are not supported")
    try:  # \p{..} and \z are the JVM's as well, but not Python's
        re.compile(re.sub(r"\\(?:[pP](?:\{\^?\w+\}|\w)|[xX]\{\w+\}|(z))", lambda m: r"\Z" if m[1] else r"\w", pattern))
    except re.error as error:
        raise PatternError(f"pattern `{pattern}`: {error}") from error
    return text.rlike("(?U)" + re.sub(r"\(\?P<", "(?<", pattern))


def matches_whole(text: Column, pattern: str) -> Column:
    """The pattern must span the text, whatever shorter match it also has."""
    return matches(text, f"^(?:{pattern})$")


def within(rows: DataFrame, paths: list[str] | None) -> DataFrame:
    """Rows of some files or folders; several roots may name a file twice."""
    if not paths:
        return rows
    keep = F.lit(False)
    for path in paths:
        root = path.rstrip("/").removeprefix("./")
        keep = keep | F.lit(root in ("", ".")) | (F.col("path") == root) | F.startswith("path", F.lit(root + "/"))
    return rows.where(keep)


def capped(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """The first rows in scan order, which compares paths part by part; the row
    beyond the cap is marked, so a reader knows that there was more."""
    from pyspark.sql import Window

    first = rows.orderBy(F.split("path", "/"), "byte").limit(cap + 1)
    number = F.row_number().over(Window.orderBy(F.split("path", "/"), "byte"))
    return first.withColumn("over_cap", number > cap)


def find(idents: DataFrame, texts: DataFrame, pattern: str, kind: str = "all", exact: bool = False,
         comments: bool = False, strings: bool = False, paths: list[str] | None = None) -> DataFrame:
    """One row a hit: path, line, occurrence, text, enclosing, address, byte."""
    rows = idents
    extra = [name for name, on in (("comment", comments), ("string", strings)) if on]
    if extra:
        rows = rows.unionByName(texts.where(F.col("occurrence").isin(extra)))
    wanted = OCCURRENCES[kind]
    if wanted:
        rows = rows.where(F.col("occurrence") == wanted)
    rows = within(rows, paths).where(matches(F.col("text"), pattern, exact))
    return rows.select(
        "path", "line", "occurrence", exprs.truncate_text(F.col("text")).alias("text"), "enclosing",
        address(F.col("path"), F.col("enclosing"), F.col("line")).alias("address"), "byte")


def find_summary(hits: DataFrame) -> DataFrame:
    """Matches by file, with the symbols that they are in."""
    return hits.groupBy("path").agg(
        F.count("*").alias("matches"), F.array_sort(F.collect_set("enclosing")).alias("symbols")).orderBy("path")


def scope(literals: DataFrame, symbols: DataFrame, files: DataFrame, target: Address | None) -> DataFrame:
    """Literals inside an address: a file, a span of lines, or a symbol."""
    if target is None:
        return literals
    rows = literals.where(F.col("path") == target.path)
    if target.kind == "lines":
        return rows.where(F.col("line").between(target.first, target.last))
    if target.kind == "symbol":
        spans = symbols.where((F.col("path") == target.path) & (F.col("dotted") == target.dotted)).select(
            F.col("path").alias("_path"), "span_start", "span_end")
        inside = (F.col("byte") >= F.col("span_start")) & (F.col("byte") < F.col("span_end"))
        return rows.join(spans, (F.col("path") == F.col("_path")) & inside, "left_semi")
    return rows


def literals(rows: DataFrame, kind: str = "all", match: str | None = None, min_len: int = 2, skeleton: bool = True,
             docstrings: bool = False, paths: list[str] | None = None) -> DataFrame:
    """One row a literal: path, line, kind, value, enclosing, address, byte."""
    value = F.when(F.col("kind") == "number", F.col("raw")).otherwise(F.col("skeleton") if skeleton else F.col("raw"))
    rows = within(rows, paths).withColumn("value", value)
    if LITERAL_KINDS[kind]:
        rows = rows.where(F.col("kind") == LITERAL_KINDS[kind])
    if not docstrings:
        rows = rows.where(~F.col("is_docstring"))
    rows = rows.where((F.col("kind") == "number") | (F.char_length("value") >= min_len))
    if match is not None:
        rows = rows.where(matches(F.col("value"), match))
    return rows.select(
        "path", "line", "kind", "value", "enclosing",
        address(F.col("path"), F.col("enclosing"), F.col("line")).alias("address"), "byte")


def literal_groups(rows: DataFrame) -> DataFrame:
    """Equal literals together, the most frequent first, with their sites."""
    return rows.groupBy("kind", "value").agg(
        F.count("*").alias("count"),
        F.transform(F.array_sort(F.collect_list(F.struct("path", "line", "byte", "address"))),
                    lambda s: F.struct(s["address"].alias("address"), s["line"].alias("line"))).alias("sites")
    ).orderBy(F.desc("count"), "kind", "value")


def literal_sites(rows: DataFrame) -> DataFrame:
    """The groups as rows, one a site: a value that every file has is too many
    sites for one row, and for one task.  So the counts of the most frequent values
    are sent to the sites; those of the rest, each a small part, meet by a join."""
    key = ["kind", "value"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("count"))
    often = counts.where(F.char_length("value") <= SHORT).orderBy(F.desc("count"), *key).limit(FREQUENT)
    sites = rows.join(F.broadcast(often), key).unionByName(
        rows.join(F.broadcast(often.select(*key)), key, "left_anti").join(counts, key))
    return sites.select(*key, "count", "address", "line", "byte")


def literal_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("literals"), F.countDistinct("value").alias("distinct_values")).orderBy("kind")
