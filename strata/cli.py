"""Commands: ``python -m strata code …`` for source trees, ``… doc …`` for documents.

Exit codes: 0 found, 1 nothing found, 2 an error.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.address import AddressError, doc_format, parse_address, parse_doc_address, slash_path
from strata.functions.budget import DEFAULT
from strata.operators import documents, graph, search, symbols, tree
from strata.plans import reports
from strata.plans.relations import Code, Docs, build, parse_code, parse_docs
from strata.session import ship
from strata.sources import scan


class CommandError(Exception):
    """Reported on standard error; ends with exit code 2."""


def _rows(df: DataFrame) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]


def _exists(path: str) -> None:
    if not os.path.exists(path):
        raise CommandError(f"cannot read `{path}`: not found")


def _files(spark: SparkSession, paths: list[str], read) -> DataFrame | None:
    """Files of several roots, each once, under the paths as they were given."""
    out = None
    for root in paths or ["."]:
        if not os.path.exists(root):
            continue
        shown = slash_path(root)
        if os.path.isdir(root):
            prefix = "" if shown == "." else shown.rstrip("/") + "/"
            rows = read(spark, os.path.abspath(root)).withColumn("path", F.concat(F.lit(prefix), "path"))
        else:
            rows = read(spark, os.path.abspath(root)).withColumn("path", F.lit(shown))
        out = rows if out is None else out.unionByName(rows)
    return None if out is None else out.dropDuplicates(["path"])


def _one_file(spark: SparkSession, path: str) -> Code:
    _exists(path)
    if os.path.isdir(path):
        raise CommandError(f"cannot read `{path}`: is a directory")
    if os.path.splitext(path)[1] not in (".py", ".pyi"):
        raise CommandError(f"unsupported language for `{path}`")
    code = Code(parse_code(_files(spark, [path], scan.source_files)).cache())
    _readable(code.files, path)
    return code


def _readable(files: DataFrame, path: str) -> None:
    if files.where("error = 'not utf-8'").count():
        raise CommandError(f"`{path}` is not valid utf-8")


def _index(spark: SparkSession, root: str, cache: bool) -> Code:
    """The relations of a tree; with a cache, only changed files are parsed."""
    listing = _files(spark, [root], scan.source_listing)
    if listing is None:
        return Code(parse_code(spark.createDataFrame([], "path string, content binary")))
    listing = listing.withColumn("path", F.regexp_replace("path", "^" + _regex(slash_path(root).rstrip("/")) + "/", "")) if root != "." else listing
    if not cache:
        return Code(parse_code(scan.opened(listing)).where("error IS NULL OR error = 'syntax error'").cache())
    folder = os.path.join(os.path.abspath(root), ".strata-cache")
    try:
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, ".gitignore"), "w") as ignore:
            ignore.write("*\n")
        have = sorted(int(n[1:]) for n in os.listdir(folder) if n[:1] == "v" and n[1:].isdigit())
        code = build(listing, folder, have[-1] if have else 0, scan.opened)
    except OSError:  # a cache that cannot be written is no cache
        return _index(spark, root, False)
    return Code(code.wide.where("error IS NULL OR error = 'syntax error'"))


def _regex(text: str) -> str:
    return "\\Q" + text + "\\E"


# ---- code -------------------------------------------------------------------

def code_slice(spark, o):
    target = parse_address(o.address)
    if target.kind == "outline":
        return code_map(spark, argparse.Namespace(path=target.path, depth=2, kind="all", budget=o.budget, quiet=o.quiet))
    path, code = slash_path(target.path), _one_file(spark, target.path)
    if target.kind == "lines":
        files = _files(spark, [target.path], scan.source_files)
        lines = code.files.first()["lines"]
        last = min(target.last, lines)
        inside = parse_address(f"{path}#L{min(target.first, last)}-L{last}")
        rows = _rows(symbols.slice_lines(files, inside).withColumn("signature", F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), r"\s+", " "))))
        return reports.slice_report(str(target), rows, o.budget, o.quiet, o.signature_only)
    wanted = spark.createDataFrame([(path, target.dotted)], "path string, dotted string")
    rows = _rows(symbols.slices(code.symbols, wanted, o.signature_only, not o.no_decorators))
    for row in rows:
        row["name"] = row["dotted"]
    if not rows:
        names = [(r["dotted"], r["n"]) for r in _rows(symbols.available(code.symbols, path, 1_000_000))]
        return reports.slice_miss(str(target), target.dotted, path, names)
    return reports.slice_report(str(target), rows, o.budget, o.quiet, o.signature_only)


def code_map(spark, o):
    if o.kind not in symbols.KINDS:
        raise CommandError(f"unknown kind `{o.kind}`: use class, function or all")
    _exists(o.path)
    depth = max(1, o.depth)
    if not os.path.isdir(o.path):
        code = _one_file(spark, o.path)
        return reports.outline_report(slash_path(o.path), code.files.first()["lines"], _rows(symbols.outline(code.symbols, depth, o.kind)), o.budget, o.quiet)
    root = os.path.abspath(o.path)
    listing = scan.source_files(spark, root)
    code = Code(parse_code(listing).cache())
    found = scan.manifests(spark, root).select("path", F.col("content").cast("string").alias("text")).cache()
    points = _rows(tree.entry_points(code, scan.console_scripts(found, listing.select("path"))))
    languages = _rows(tree.languages(code.files))
    return reports.tree_report(
        slash_path(o.path), listing.count(), sum(r["lines"] for r in languages), languages, _rows(tree.rollup(code.files, depth)),
        depth, points, sorted(r["path"] for r in _rows(found.select("path"))), o.budget, o.quiet)


def code_find(spark, o):
    if o.kind not in search.OCCURRENCES:
        raise CommandError(f"unknown kind `{o.kind}`: use definition, call, reference or any")
    if o.context not in ("symbol", "none"):
        raise CommandError(f"unknown context `{o.context}`: use symbol or none")
    search.matches(F.lit(""), o.pattern, o.exact)
    files = _files(spark, o.paths, scan.source_files)
    rows = []
    if files is not None:
        code = Code(parse_code(files))
        wide = code.wide.cache()
        code = Code(wide)
        rows = _rows(search.capped(search.find(code.idents, code.texts, o.pattern, o.kind, o.exact, o.include_comments, o.include_strings)))
    over = any(r["over_cap"] for r in rows)
    rows = sorted((r for r in rows if not r["over_cap"]), key=lambda r: (r["path"], r["line"], r["text"]))
    return reports.find_report(o.pattern, rows, over, o.budget, o.quiet, o.context == "symbol", not (o.include_comments and o.include_strings))


def code_literals(spark, o):
    if o.kind not in search.LITERAL_KINDS:
        raise CommandError(f"unknown kind `{o.kind}`: use string, number, regex or all")
    target = parse_address(o.scope) if o.scope else None
    if o.match is not None:
        search.matches(F.lit(""), o.match)
    files = _files(spark, [target.path] if target else o.paths, scan.source_files)
    rows = []
    if files is not None:
        code = Code(parse_code(files).cache())
        inside = code.literals
        if target is not None:
            inside = search.scope(inside, code.symbols, code.files, parse_address(str(target).replace(target.path, slash_path(target.path), 1)))
        rows = _rows(search.capped(search.literals(inside, o.kind, o.match, o.min_len, not o.no_skeleton, o.include_docstrings)))
    over = any(r["over_cap"] for r in rows)
    rows = sorted((r for r in rows if not r["over_cap"]), key=lambda r: (r["path"], r["line"], r["value"]))
    return reports.literals_report(rows, over, o.budget, o.quiet, not o.no_group, not o.no_skeleton, o.include_docstrings)


def _target(spark, o, command):
    """(code, path, dotted, target rows, report of a miss)."""
    target = parse_address(o.address)
    path = slash_path(target.path)
    if target.kind != "symbol":
        return None, path, "", [], reports.wrong_selector(command, str(target))
    code = _index(spark, o.root, not o.no_cache)
    rows = _rows(code.symbols.where((F.col("path") == path) & (F.col("dotted") == target.dotted)).orderBy("ord"))
    if rows:
        return code, path, target.dotted, rows, None
    names = [r["dotted"] for r in _rows(code.symbols.where(F.col("path") == path).orderBy("ord").select("dotted"))]
    if command == "callers":  # neighbours that repeat are listed once
        names = [n for k, n in enumerate(names) if k == 0 or names[k - 1] != n]
    return code, path, target.dotted, [], reports.index_miss(command, str(target), path, target.dotted, names)


def code_callers(spark, o):
    code, path, dotted, target, miss = _target(spark, o, "callers")
    if miss:
        return miss
    wanted = spark.createDataFrame([(path, dotted)], "path string, dotted string")
    rows = _rows(graph.ordered_callers(graph.callers(code, wanted, not o.no_tests)))
    same_name = code.symbols.where(F.col("name") == target[0]["name"]).count()
    return reports.callers_report(o.address, target[0]["signature"], len(target), same_name, rows, o.budget, o.quiet)


def code_packet(spark, o):
    code, path, dotted, target, miss = _target(spark, o, "packet")
    if miss:
        return miss
    wanted = spark.createDataFrame([(path, dotted)], "path string, dotted string")
    callers = _rows(graph.packet_callers(code, wanted, not o.no_tests).orderBy("rank", "path", "line", "byte"))
    first = target[0]
    shown = {"address": f"{path}#{dotted}", "signature": first["signature"], "start_line": first["start_line"],
             "end_line": first["end_line"], "body": first["text"]}
    return reports.packet_report(o.address, shown, callers, _rows(graph.packet_callees(code, wanted)),
                                 _rows(graph.packet_types(code, wanted)), o.budget, o.quiet)


def code_dead(spark, o):
    code = _index(spark, o.root, not o.no_cache)
    return reports.dead_report(_rows(graph.dead(code)), code.files.count(), o.budget, o.quiet)


# ---- documents --------------------------------------------------------------

def _document(spark, path: str) -> Docs:
    if doc_format(path) is None:
        raise CommandError(f"unsupported format for `{path}`: only json, yaml and markdown documents are read")
    _exists(path)
    docs = Docs(parse_docs(_files(spark, [path], scan.doc_files)).cache())
    _readable(docs.files, path)
    if docs.files.where("error IS NOT NULL").count():
        raise CommandError(f"cannot parse `{path}`")
    return docs


def _doc_outline(docs: Docs, path: str, depth: int, o):
    return reports.doc_outline_report(slash_path(path), doc_format(path), _rows(documents.outline(docs.nodes, depth)), o.budget, o.quiet)


def doc_slice(spark, o):
    target = parse_doc_address(o.address)
    docs, path = _document(spark, target.path), slash_path(target.path)
    if not target.steps:
        return _doc_outline(docs, target.path, 2, o)
    inside = parse_doc_address(f"{path}#{target.raw}")
    rows = _rows(documents.slices(documents.resolve(docs.nodes, inside), o.with_key))
    if rows:
        return reports.doc_slice_report(str(inside), target.format, rows, o.budget, o.quiet)
    return reports.doc_miss(str(inside), target.raw, path, [r["node_path"] for r in _rows(docs.nodes.orderBy("ord").select("node_path"))])


def doc_map(spark, o):
    if not os.path.isdir(o.path):
        return _doc_outline(_document(spark, o.path), o.path, max(1, o.depth), o)
    docs = Docs(parse_docs(scan.doc_files(spark, os.path.abspath(o.path))))
    return reports.doc_tree_report(slash_path(o.path), _rows(tree.documents(docs)), o.budget, o.quiet)


def doc_find(spark, o):
    if o.keys and o.values:
        raise CommandError("--keys and --values are mutually exclusive")
    search.matches(F.lit(""), o.pattern, o.exact)
    files = _files(spark, o.paths, scan.doc_files)
    rows = [] if files is None else _rows(documents.find(
        Docs(parse_docs(files)).nodes, o.pattern, o.exact, not o.values, not o.keys))
    return reports.doc_find_report(o.pattern, rows, o.budget, o.quiet)


# ---- arguments --------------------------------------------------------------

def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--budget", type=int, default=DEFAULT, help="tokens that the output may cost")
    common.add_argument("--json", action="store_true")
    common.add_argument("--no-color", action="store_true", help="accepted; output has no colour")
    common.add_argument("--quiet", action="store_true", help="no closing line")
    main = argparse.ArgumentParser(prog="strata")
    groups = main.add_subparsers(required=True)

    code = groups.add_parser("code", help="source trees").add_subparsers(required=True)
    rooted = argparse.ArgumentParser(add_help=False)
    rooted.add_argument("--no-cache", action="store_true", help="parse everything anew and keep nothing")
    rooted.add_argument("--root", default=".", help="the tree that is indexed")

    def add(to, name, run, *flags, **values):
        command = to.add_parser(name, parents=[common, rooted] if to is code else [common])
        command.set_defaults(run=run)
        for flag in flags:
            command.add_argument(flag, action="store_true")
        for key, options in values.items():
            names = options.pop("names", [key])
            command.add_argument(*names, **options)

    paths = lambda: {"nargs": "*", "default": []}
    number = lambda name, n: {"names": [name], "type": int, "default": n}
    word = lambda name, value: {"names": [name], "default": value}
    add(code, "slice", code_slice, "--signature-only", "--no-decorators", address={})
    add(code, "map", code_map, path={"nargs": "?", "default": "."}, depth=number("--depth", 2), kind=word("--kind", "all"))
    add(code, "find", code_find, "--exact", "--include-comments", "--include-strings", pattern={}, paths=paths(),
        kind=word("--kind", "any"), context=word("--context", "symbol"))
    add(code, "literals", code_literals, "--no-group", "--no-skeleton", "--include-docstrings", paths=paths(),
        kind=word("--kind", "all"), match=word("--match", None), min_len=number("--min-len", 2),
        scope={"names": ["--in"], "dest": "scope", "default": None})
    add(code, "callers", code_callers, "--no-tests", address={})
    add(code, "packet", code_packet, "--no-tests", address={})
    add(code, "dead", code_dead)
    doc = groups.add_parser("doc", help="documents").add_subparsers(required=True)
    add(doc, "slice", doc_slice, "--with-key", address={})
    add(doc, "map", doc_map, path={"nargs": "?", "default": "."}, depth=number("--depth", 2))
    add(doc, "find", doc_find, "--exact", "--keys", "--values", pattern={}, paths=paths())
    return main


def session() -> SparkSession:
    spark = (SparkSession.builder.appName("strata").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(arguments: list[str], spark: SparkSession | None = None) -> tuple[int, str, str]:
    """(exit code, standard output, standard error)."""
    options = parser().parse_args(arguments)
    spark = spark or session()
    ship(spark)
    try:
        found = options.run(spark, options)
    except (AddressError, CommandError, search.PatternError) as error:
        return 2, "", f"strata: {error}\n"
    out = json.dumps(found.json, indent=2, sort_keys=True, ensure_ascii=False) + "\n" if options.json else found.text
    return 0 if found.found else 1, out, ""


def main() -> int:
    code, out, err = run(sys.argv[1:])
    sys.stdout.write(out)
    sys.stderr.write(err)
    return code
