"""Scalar functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\p{Z}]+"
_UNIT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"


def estimate_tokens(text: Column) -> Column:
    """Units or a quarter of the characters, whichever is more."""
    return F.greatest(F.regexp_count(text, F.lit(_UNIT)), F.ceil(F.char_length(text) / 4.0)).cast("long")


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def slash_path(path: Column) -> Column:
    bare = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    return F.when(bare == "", ".").otherwise(bare)


def commas(n: Column) -> Column:
    return F.format_number(n, 0)


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(commas(n), F.lit(" "), F.when(n == 1, one).otherwise(many))


def pad(text: Column, width: int) -> Column:
    """Padded on the right, never cut."""
    return F.when(F.char_length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def line_span(first: Column, last: Column) -> Column:
    start = F.concat(F.lit("L"), first.cast("string"))
    return F.when(first == last, start).otherwise(F.concat(start, F.lit("-L"), last.cast("string")))


def indent(depth: Column) -> Column:
    return F.repeat(F.lit("  "), depth)


def cut(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def truncate_text(text: Column) -> Column:
    return cut(F.regexp_replace(F.element_at(F.split(text, "\n"), 1), r"\r$", ""), 60)


def preview(text: Column, limit: int) -> Column:
    return cut(collapse_ws(text), limit)


def summarise(kind: Column, text: Column, count: Column) -> Column:
    return (F.when(kind == "mapping", F.concat(F.lit("{"), count.cast("string"), F.when(count == 1, " key}").otherwise(" keys}")))
            .when(kind == "sequence", F.concat(F.lit("["), count.cast("string"), F.when(count == 1, " item]").otherwise(" items]")))
            .otherwise(preview(text, 48)))


def string_prefix(raw: Column) -> Column:
    return F.lower(F.regexp_extract(raw, "^[^\"']*", 0))


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, '^"+|"+$', "")


def is_test_path(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return (F.contains(path, F.lit("/tests/")) | F.startswith(path, F.lit("tests/")) | F.contains(path, F.lit("/test/"))
            | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py")) | (name == "conftest.py"))


def arity_label(required: Column, most: Column) -> Column:
    return (F.when(most.isNull(), F.concat(required.cast("string"), F.lit("+")))
            .when(required == most, required.cast("string"))
            .otherwise(F.concat_ws("-", required.cast("string"), most.cast("string"))))


def exports(text: Column) -> Column:
    """Names between the first ``__all__``'s brackets, by text alone."""
    tail = F.substr(text, F.instr(text, "__all__"))
    inner = F.substr(tail, F.instr(tail, "[") + 1)
    body = F.substring_index(inner, "]", 1)
    names = F.transform(F.split(body, ","), lambda n: F.regexp_replace(F.trim(F.regexp_replace(n, _SPACE, " ")), "^[\"']+|[\"']+$", ""))
    found = (F.instr(text, "__all__") > 0) & (F.instr(tail, "[") > 0) & (F.instr(inner, "]") > 0)
    return F.when(found, F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))).otherwise(
        F.array().cast("array<string>"))
