"""Files to relations: one opaque parse, then ordinary DataFrames.

``parse_code`` and ``parse_docs`` give wide rows with a struct for each relation:
the n-th row of a stretch has its n-th symbol, its n-th call and so on, or null.
What holds for the whole file stands in one of its rows.  Written as a snapshot,
the structs' fields are separate Parquet columns, so a command reads only what
it selects, and no row grows with the file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import exprs
from strata.functions.apart import Apart

SYMBOLS = (
    "sym_id int, parent_id int, depth int, ord int, dotted string, name string, kind string, start_line int, "
    "end_line int, span_start int, span_end int, def_start int, sig_end int, signature string, decorators array<string>, "
    "params array<string>, required int, max_args int, type_names array<string>, descendants int, text string, "
    "bare_at int, sig_at int, def_line int, sig_line int")
CALLS = "name string, receiver string, full string, arity int, line int, byte int, enclosing string"
IMPORTS = "module string, name string, alias string"
NAMES = "byte int, line int, text string, occurrence string, enclosing string"
LITERALS = "byte int, line int, kind string, raw string, skeleton string, is_docstring boolean, enclosing string"
NODES = (
    "ord int, parent_ord int, depth int, position int, key string, node_path string, kind string, span_start int, "
    "span_end int, entry_start int, start_line int, end_line int, summary string, n_children int, n_desc int, "
    "text string, steps array<string>, places array<int>, slice_text string, entry_text string, entry_line int")


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{n}:{t}" for n, t in (f.split(" ", 1) for f in fields.split(", "))) + ">"


#: All but path and modified are null in all rows of a file but one.
_FILE = ("path string, size long, modified timestamp, hash string, lines int, error string, has_main_guard boolean, guard_line int, "
         "exports array<string>")
_RELATIONS = {"symbols": SYMBOLS, "calls": CALLS, "imports": IMPORTS, "idents": NAMES, "texts": NAMES, "literals": LITERALS}
#: Rows of a record batch of documents.
BATCH = 2048


def wide(wanted: Iterable[str] = _RELATIONS) -> str:
    return ", ".join([_FILE, *[f"{n} {_struct(_RELATIONS[n])}" for n in wanted]])


WIDE = wide()
WIDE_DOCS = f"path string, format string, lines int, error string, entries long, nodes {_struct(NODES)}"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def _text(content) -> str | None:
    if isinstance(content, str) or content is None:
        return content
    try:
        return bytes(content).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _column(rows: list[tuple], kind: pa.DataType, n: int) -> pa.Array:
    """Rows as structs, and nulls up to n."""
    none = n - len(rows)
    if not rows:
        return pa.nulls(n, kind)
    parts = [pa.array(list(values), f.type) for values, f in zip(zip(*rows, strict=True), kind, strict=True)]
    if not none:
        return pa.StructArray.from_arrays(parts, fields=list(kind))
    parts = [pa.concat_arrays([p, pa.nulls(none, p.type)]) for p in parts]
    return pa.StructArray.from_arrays(parts, fields=list(kind), mask=pa.array([False] * len(rows) + [True] * none))


def _batch(schema: pa.Schema, every: dict, once: dict, relations: dict[str, list[tuple]]) -> pa.RecordBatch:
    """The rows of a stretch; ``every`` stands in all, ``once`` in the first of them."""
    n = max(bool(once), *map(len, relations.values()))
    columns = []
    for f in schema:
        if f.name in relations:
            columns.append(_column(relations[f.name], f.type, n))
        elif f.name in every:
            columns.append(pa.array([every[f.name]] * n, f.type))
        else:
            columns.append(pa.array([once.get(f.name)] + [None] * (n - 1), f.type) if n else pa.nulls(0, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _rows_of(text: str, path: str, tree, base: tuple[int, int, int], first: bool, wanted: tuple[str, ...]) -> dict:
    """What ``parse_code`` of a stretch gives, but for relations that are not wanted."""
    from strata.functions.parse_code import RELATIONS
    from strata.functions.parse_code import parse_code as parse

    found = parse(path, text, tree, base, first, wanted)
    return {name: rows for name, rows in found.items() if name in wanted or name not in RELATIONS}


def _rows_before(text: str, path: str, base: tuple[int, int, int], first: bool, wanted: tuple[str, ...]) -> tuple[int, dict | None]:
    """The last place of a text and the rows of what stands before it, if that parses."""
    from strata.functions.stretches import tree_before

    place, tree = tree_before(text)
    return place, None if tree is None else _rows_of(text[:place], path, tree, base, first, wanted)


def _parsed(every: dict, pieces: Iterable[str], once: dict, wanted: tuple[str, ...], schema: pa.Schema, apart: Apart) -> Iterator[pa.RecordBatch]:
    """The rows of a file, stretch by stretch; ``once``: what is known of it."""
    import gc
    import hashlib

    from strata.functions.stretches import Exports, stretches

    size = lines = symbols = 0
    digest, exports, imported = hashlib.sha256(), Exports(), set()
    blank, ended, guarded, guard_line = True, True, False, None

    def before(text: str) -> tuple[int, dict | None]:
        return apart(_rows_before, text, every["path"], (size, lines, symbols), blank, wanted)

    collects = gc.isenabled()
    gc.disable()  # rows hold no cycles, and there are too many to look for some
    try:
        for text, found, last in stretches(pieces, before=before):
            if found is None:
                found = apart(_rows_of, text, every["path"], None, (size, lines, symbols), blank, wanted)
            data = text.encode()
            digest.update(data)
            exports.add(text)
            relations = {name: found[name] for name in wanted}
            if "imports" in relations:  # a name that several stretches import is imported once
                relations["imports"] = [r for r in relations["imports"] if r not in imported]
                imported.update(relations["imports"])
            guarded, guard_line = guarded or found["has_main_guard"], found["guard_line"] if guard_line is None else guard_line
            size, lines, symbols = size + len(data), lines + data.count(b"\n"), symbols + found["n_symbols"]
            blank, ended = blank and not text.strip(), data.endswith(b"\n") if data else ended
            end = {"size": size, "hash": digest.hexdigest(), "lines": max(1, lines + (not ended)), "error": found["error"],
                   "has_main_guard": guarded, "guard_line": guard_line, "exports": exports.names()} | once if last else {}
            yield _batch(schema, every, end, relations)
    finally:
        if collects:
            gc.enable()


def parse_code(files: DataFrame) -> DataFrame:
    """Wide rows of Python files; files: path, content and, if known, size and
    modified.  A file that is not UTF-8 has an error and no relations."""
    content = F.col("content").cast("binary")
    have = set(files.columns)
    ready = files.select(
        "path", content.alias("content"),
        (F.col("size") if "size" in have else F.octet_length(content)).cast("long").alias("size"),
        (F.col("modified") if "modified" in have else F.lit(None)).cast("timestamp").alias("modified"),
        F.sha2(content, 256).alias("hash"),
        exprs.exports(F.try_validate_utf8(F.coalesce(content, F.lit("").cast("binary")).cast("string"))).alias("exports"))
    schema = _arrow(WIDE)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Apart() as apart:
            for batch in it:
                columns = [batch.column(k) for k in range(6)]
                for k in range(batch.num_rows):
                    path, content, size, modified, digest, names = (c[k].as_py() for c in columns)
                    text = _text(content)
                    every, once = {"path": path, "modified": modified}, {"size": size, "hash": digest, "exports": names or []}
                    if text is None:
                        once |= {"error": "not utf-8", "lines": 0, "has_main_guard": False}
                        yield _batch(schema, every, once, {name: [] for name in _RELATIONS})
                    else:
                        yield from _parsed(every, [text], once, tuple(_RELATIONS), schema, apart)

    return ready.mapInArrow(work, WIDE)


def parse_pieces(pieces: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """The wide rows, with some relations, of files that come in pieces: path and
    text, each file's pieces in order and in one partition.  No file is held."""
    shape = wide(wanted)
    schema = _arrow(shape)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs():
            for batch in it:
                paths, texts = (batch.column(k).to_pylist() for k in range(2))
                low = 0
                while low < len(paths):
                    high = len(paths)
                    if paths[-1] != paths[low]:
                        high = next(k for k in range(low, high) if paths[k] != paths[low])
                    yield paths[low], "".join(t for t in texts[low:high] if t is not None)
                    low = high

        with Apart() as apart:
            for path, group in groupby(runs(), key=lambda run: run[0]):
                yield from _parsed({"path": path}, (text for _, text in group), {}, wanted, schema, apart)

    return pieces.select("path", "text").mapInArrow(work, shape)


def parse_docs(files: DataFrame) -> DataFrame:
    """Wide rows of documents; files: path, format, content."""
    schema = _arrow(WIDE_DOCS)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strata.functions.parse_doc import DocError, doc_rows

        for batch in it:
            columns = [batch.column(k) for k in range(3)]
            for k in range(batch.num_rows):
                path, kind, content = (c[k].as_py() for c in columns)
                text, error, lines, entries, nodes = _text(content), None, 0, 0, iter(())
                if text is None:
                    error = "not utf-8"
                else:
                    try:
                        lines, entries, nodes = doc_rows(kind, text)
                    except DocError as problem:
                        error = str(problem)
                once = {"lines": lines, "error": error, "entries": entries}
                while (rows := list(islice(nodes, BATCH))) or once:
                    yield _batch(schema, {"path": path, "format": kind}, once, {"nodes": rows})
                    once = {}

    return files.select("path", "format", F.col("content").cast("binary").alias("content")).mapInArrow(work, WIDE_DOCS)


@dataclass
class Code:
    """The relations of a tree, each a DataFrame keyed by path."""

    wide: DataFrame

    def _of(self, name: str) -> DataFrame:
        """The wide rows that have a relation."""
        return self.wide

    def _rows(self, name: str) -> DataFrame:
        return self._of(name).where(F.col(name).isNotNull()).select("path", f"{name}.*")

    def some(self, name: str, *fields: str) -> DataFrame:
        """A relation with some of its fields."""
        return self._rows(name).select("path", *fields)

    @property
    def files(self) -> DataFrame:
        return self._of("files").where("has_main_guard IS NOT NULL").select(
            "path", F.lit("python").alias("lang"), "size", "modified", "hash", "lines", "error", "has_main_guard", "guard_line",
            exprs.is_test_path(F.col("path")).alias("is_test"),
            F.endswith("path", F.lit("__init__.py")).alias("is_package_init"),
            "exports")

    @property
    def symbols(self) -> DataFrame:
        return self._rows("symbols")

    @property
    def calls(self) -> DataFrame:
        return self._rows("calls")

    @property
    def imports(self) -> DataFrame:
        return self._rows("imports")

    @property
    def idents(self) -> DataFrame:
        return self._rows("idents")

    @property
    def texts(self) -> DataFrame:
        return self._rows("texts")

    @property
    def literals(self) -> DataFrame:
        return self._rows("literals")


class Parts(Code):
    """Relations that are parsed in parts, each when a query first asks for it."""

    def __init__(self, parts: dict[tuple[str, ...], Callable[[], DataFrame]]):
        self._parts, self._have = parts, {}

    def _of(self, name: str) -> DataFrame:
        part = next(p for p in self._parts if name in p)
        if part not in self._have:
            self._have[part] = self._parts[part]()
        return self._have[part]


@dataclass
class Docs:
    wide: DataFrame

    @property
    def files(self) -> DataFrame:
        return self.wide.where("entries IS NOT NULL").select("path", "format", "lines", "error", "entries")

    @property
    def nodes(self) -> DataFrame:
        return self.wide.where("nodes IS NOT NULL").select("path", "format", "nodes.*")


# ---- snapshots --------------------------------------------------------------

def refresh_plan(listing: DataFrame, previous: DataFrame | None,
                 read: Callable[[DataFrame], DataFrame] = lambda files: files) -> tuple[DataFrame, DataFrame | None]:
    """(rows to parse, previous rows to keep with the listing's stat).

    A file is kept when size and time are as before, or else when its bytes are;
    a file that is not listed any more is in neither.  ``read`` opens listed
    files, and only those whose size or time changed.
    """
    if previous is None:
        return read(listing), None
    # One row a file has its hash; the others have its relations only.
    stat = previous.where("hash IS NOT NULL").select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    still = listing.join(stat, "path").where((F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified"))).select("path")
    changed = read(listing.join(still, "path", "left_anti"))
    equal = changed.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.sha2(
        F.col("content").cast("binary"), 256).alias("hash")).join(previous.select("path", "hash"), ["path", "hash"]).drop("hash")
    moved = previous.join(equal, "path").withColumn("size", F.col("_size")).withColumn("modified", F.col("_modified")).drop("_size", "_modified")
    return changed.join(equal.select("path"), "path", "left_anti"), previous.join(still, "path", "left_semi").unionByName(moved)


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """A snapshot, or nothing if it is absent or cannot be read as one."""
    try:
        found = spark.read.parquet(folder)
        whole = {"path", "hash", "symbols", "calls", "exports"} <= set(found.columns)
        return found if whole and isinstance(found.schema["symbols"].dataType, T.StructType) else None
    except Exception:  # noqa: BLE001  any unreadable snapshot is rebuilt
        return None


def build(listing: DataFrame, folder: str | None = None, version: int = 0,
          read: Callable[[DataFrame], DataFrame] = lambda files: files) -> Code:
    """Parse what changed since snapshot ``version`` in ``folder`` and write the next."""
    spark = listing.sparkSession
    if folder is None:
        return Code(parse_code(read(listing)))
    old = read_snapshot(spark, f"{folder}/v{version}") if version else None
    todo, kept = refresh_plan(listing, old, read)
    wide = parse_code(todo)
    if kept is not None:
        wide = wide.unionByName(kept)
    wide.write.mode("overwrite").parquet(f"{folder}/v{version + 1}")
    return Code(spark.read.parquet(f"{folder}/v{version + 1}"))
