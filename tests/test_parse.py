"""Parsing: own fixtures for each rule."""

import pytest

from strata.functions.address import AddressError, doc_format, line_span, parse_address, parse_doc_address, slash_path
from strata.functions.budget import Part, commas, estimate_tokens, lay_out, pad, plural, shown, within
from strata.functions.parse_code import parse_code
from strata.functions.parse_doc import DocError, parse_doc

SYMBOL = ("id parent depth ord dotted name kind start_line end_line span_start span_end def_start sig_end signature "
          "decorators params required max_args type_names descendants text bare_at sig_at def_line sig_line").split()


def symbols(text):
    return [dict(zip(SYMBOL, row, strict=True)) for row in parse_code("t.py", text)["symbols"]]


def test_nested_symbols_and_spans():
    text = "# before\n@wrap(1)\n@other\nclass A(B):\n    LIMIT = 2\n    x = 3\n    class C:\n        def go(self, é: int = 1): return é\n"
    got = symbols(text)
    assert [(s["dotted"], s["kind"], s["depth"], s["start_line"], s["end_line"], s["descendants"]) for s in got] == [
        ("A", "class", 1, 2, 8, 3), ("A.LIMIT", "variable", 2, 5, 5, 0), ("A.C", "class", 2, 7, 8, 1), ("A.C.go", "function", 3, 8, 8, 0)]
    assert got[0]["decorators"] == ["@wrap(1)", "@other"] and got[0]["signature"] == "class A(B):"
    assert got[3]["signature"] == "def go(self, é: int = 1):" and got[3]["type_names"] == ["int"]
    assert got[0]["text"].startswith("@wrap(1)") and got[0]["def_line"] == 4


@pytest.mark.parametrize("parameters, params, required, most", [
    ("self, a, b=1", ["self", "a", "b"], 1, 2), ("a, *rest, **kw", ["a", "*rest", "**kw"], 1, None),
    ("a, *rest: int", ["a", "*rest"], 2, 2), ("a, **kw: int", ["a", "**kw"], 2, 2), ("a, /, b, *, c, d=2", ["a", "b", "c", "d"], 3, 4),
    ("", [], 0, 0)])
def test_arity(parameters, params, required, most):
    got = symbols(f"class K:\n    def f({parameters}): pass\n")[1]
    assert (got["params"], got["required"], got["max_args"]) == (params, required, most)


def test_constants_only_outside_functions():
    text = "A = 1\n_B = 2\nc = 3\nD: int = 4\nE, F = 1, 2\nG = H = 5\nif A:\n    I = 6\ndef f():\n    J = 7\n"
    assert [s["dotted"] for s in symbols(text)] == ["A", "D", "G", "I", "f"]


def test_conditional_definitions():
    text = "try:\n    def a(): pass\nexcept E:\n    def b(): pass\nfinally:\n    def c(): pass\nmatch x:\n    case 1:\n        def d(): pass\n"
    assert [s["dotted"] for s in symbols(text)] == ["a", "b", "c", "d"]


def test_calls():
    text = "@deco(1)\ndef f(x):\n    self.a(1, k=2, *r)\n    (x)(3)\n    h(i for i in x if i)\n    (a.b).c()\n    x[0]()\nf()\n"
    got = [(name, receiver, full, arity, line, inside) for name, receiver, full, arity, line, _, inside in parse_code("t.py", text)["calls"]]
    assert got == [("deco", None, "deco", 1, 1, "f"), ("a", "self", "self.a", 3, 3, "f"), ("h", None, "h", 3, 5, "f"),
                   ("c", "(a.b)", "(a.b).c", 0, 6, "f"), ("f", None, "f", 0, 8, None)]


def test_imports():
    text = "from __future__ import annotations\nimport a.b, c as d\nfrom .m import x, y as z\nfrom .. import q\nfrom w import *\nimport a.b\n"
    assert parse_code("t.py", text)["imports"] == [
        ("..", "q", None), (".m", "x", None), (".m", "y", "z"), ("a.b", "a.b", None), ("c", "c", "d")]


def test_names():
    text = "def go(n): return go(n.go(1), go)\nmatch go:\n    case go(): pass\n    case _: pass\ns = f'{go!r:>{go}}'\n"
    got = [(word, kind) for _, _, word, kind, _ in parse_code("t.py", text)["idents"]]
    assert [kind for word, kind in got if word == "go"] == ["definition", "call", "call", "reference", "reference", "reference", "reference", "reference"]
    assert all(word not in ("match", "case", "_", "r") for word, _ in got)


def test_literals():
    text = ('# licence\n"""not first"""\nimport re\ndef f():\n    # note\n    """doc"""\n    re.sub("a+", r"b")\n'
            '    x = r"c." "tail"\n    return f"{x}: {x!r} {{}}", 1.5, -2\n')
    got = [(line, kind, skeleton, doc) for _, line, kind, _, skeleton, doc, _ in parse_code("t.py", text)["literals"]]
    assert got == [(2, "string", "not first", False), (6, "string", "doc", True), (7, "regex", "a+", False), (7, "regex", "b", False),
                   (8, "string", "c.", False), (8, "string", "tail", False), (9, "string", "<>: <> {{}}", False),
                   (9, "number", "1.5", False), (9, "number", "2", False)]


def test_broken_text_keeps_its_definitions():
    got = parse_code("t.py", "class A:\n    def f(self):\n        x = (\n\ndef g():\n    pass\n")
    assert got["error"] and [row[4] for row in got["symbols"]] == ["A", "A.f", "g"]


@pytest.mark.parametrize("text, lines", [("", 1), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("a\r\nb", 2)])
def test_lines(text, lines):
    assert parse_code("t.py", text)["lines"] == lines


def nodes(kind, text):
    return [(r[5], r[6], r[10], r[11], r[12], r[14], r[15]) for r in parse_doc(kind, text)[1]]


def test_json():
    text = '{ // note\n "a": {"b": [1, {"é": null}]},\n "c": "x"}\n'
    assert nodes("json", text) == [
        ("a", "mapping", 2, 2, "{1 key}", 4, '{"b": [1, {"é": null}]}'), ("a.b", "sequence", 2, 2, "[2 items]", 3, '[1, {"é": null}]'),
        ("a.b[0]", "scalar", 2, 2, "1", 0, "1"), ("a.b[1]", "mapping", 2, 2, "{1 key}", 1, '{"é": null}'),
        ("a.b[1].é", "scalar", 2, 2, "null", 0, "null"), ("c", "scalar", 3, 3, '"x"', 0, '"x"')]
    assert nodes("json", "3") == [] and [n[0] for n in nodes("json", "[1, [2]]")] == ["[0]", "[1]", "[1][0]"]
    assert len(nodes("json", "[" * 3000 + "]" * 3000)) == 2999
    with pytest.raises(DocError):
        parse_doc("json", '{"a" 1}')


def test_yaml():
    text = "a: one # note\nb:\n  - x\n  - k: v\n\n# gap\nc:\nd: &n 5\ne: *n\nf: {}\n---\nz: 1\n"
    got = nodes("yaml", text)
    assert [(n[0], n[1], n[4]) for n in got] == [
        ("a", "scalar", "one"), ("b", "sequence", "[2 items]"), ("b[0]", "scalar", "x"), ("b[1]", "mapping", "{1 key}"),
        ("b[1].k", "scalar", "v"), ("c", "scalar", "~"), ("d", "scalar", "&n 5"), ("e", "scalar", "*n"), ("f", "mapping", "{0 keys}")]
    assert got[1][6] == "- x\n  - k: v" and (got[1][2], got[1][3]) == (3, 4)


def test_markdown():
    text = "# A\ntext\n### C\n```\n# no\n```\n## B ##\n   # D\n####### no\n#no\n"
    assert [(n[0], n[2], n[3]) for n in nodes("markdown", text)] == [("A", 1, 7), ("A/C", 3, 6), ("A/B", 7, 7), ("D", 8, 10)]


def test_addresses():
    assert parse_address("a.py#").kind == "outline" and str(parse_address("a.py#L3-L9")) == "a.py#L3-L9"
    assert parse_address("a.py#Loader.x").parts == ("Loader", "x") and parse_address("a.py#L4").last == 4
    for bad in ("a.py", "#x", "a.py#a..b", "a.py#L0", "a.py#L9-L3", "a.py#L3x"):
        with pytest.raises(AddressError):
            parse_address(bad)
    assert parse_doc_address('a.json#b.c[0]["k"][\'7\']').steps == (("key", "b"), ("key", "c"), ("index", 0), ("key", "k"), ("index", 7))
    assert parse_doc_address("a.MD#A/ B /").steps == (("key", "A"), ("key", "B"))
    assert doc_format("x.YML") == "yaml" and doc_format("x.txt") is None and doc_format(".json") is None
    assert (slash_path("./a\\b"), slash_path("./"), line_span(2, 2), line_span(2, 5)) == ("a/b", ".", "L2", "L2-L5")


def test_budget():
    assert estimate_tokens("a_b c, d") == 4 and estimate_tokens("abcdefghi") == 3 and estimate_tokens("") == 0
    parts = [Part(level[0], ["word " * n]) for level, n in (("full", 30), ("summary", 10), ("counts", 5))]
    assert [within(n, parts)[1] for n in (100, 20, 8, 1)] == ["full", "summary", "counts", "counts"]
    assert (commas(1234), plural(1, "match", "matches"), plural(2, "match", "matches"), pad("abc", 2)) == ("1,234", "1 match", "2 matches", "abc")
    parts = [Part("f", []), Part("fs", ["a"]), Part("s", ["x"]), Part("f", ["b", ""], near=True), Part("f", ["c", ""])]
    assert lay_out(parts, "full") == "a\nb\n\nc\n" and lay_out(parts, "summary") == "a\n\nx\n" and lay_out(parts, "counts") == ""
    assert shown(2, 2, "m") == []


def test_texts_that_do_not_parse():
    """What stands around a refused line is read as if the line were not there."""
    from strata.functions.parse_code import parse_code

    def rows(text):
        found = parse_code("p.py", text)
        assert found["error"] == "syntax error"
        return ([(s[4], s[7], s[8]) for s in found["symbols"]], [(c[2], c[3], c[4], c[6]) for c in found["calls"]], found["imports"])

    old = "from x import y\ndef g():\n    used(1, 2)\n    print 'x', self.a.b(3)\n    return 1\nclass A:\n    def f(self): return g()\n"
    assert rows(old) == ([("g", 2, 5), ("A", 6, 7), ("A.f", 7, 7)], [
        ("used", 2, 3, "g"), ("self.a.b", 1, 4, "g"), ("g", 0, 7, "A.f")], [("x", "y", None)])
    assert rows("def a(:\n    b(1)\n\ndef c():\n    d(2)\n")[:2] == (
        [("a", 1, 2), ("c", 4, 5)], [("b", 1, 2, "a"), ("d", 1, 5, "c")])
    assert rows("def e():\n\nf()\n")[0][0][0] == "e" and rows("def e():\n\nf()\n")[1] == [("f", 0, 3, None)]
    assert rows("s = \'\'\'abc\ndef z():\n    y()\n")[:2] == ([("z", 2, 3)], [("y", 0, 3, "z")])
    assert rows("if x\n    q()\nelse:\n    r()\n")[1] == [("q", 0, 2, None), ("r", 0, 4, None)]
    assert parse_code("p.py", "\0 def")["error"] == "syntax error"


def test_dead_sees_calls_of_broken_files(spark):
    from strata.operators import graph
    from strata.plans.relations import Code, parse_code

    files = spark.createDataFrame([("a.py", "def used():\n    return 1\n\ndef lost():\n    return 2\n"),
                                   ("b.py", "print 'x'\nused()\n")], "path string, content string")
    assert [r.address for r in graph.dead(Code(parse_code(files))).collect()] == ["a.py#lost"]


def test_refresh_opens_what_changed(spark):
    import datetime

    from pyspark.sql import functions as F

    from strata.plans.relations import refresh_plan

    day = datetime.datetime(2024, 1, 1)
    listing = spark.createDataFrame([("same", 3, day), ("touched", 3, day), ("edited", 4, day), ("new", 1, day)],
                                    "path string, size long, modified timestamp")
    old = datetime.datetime(2023, 1, 1)
    sha = lambda t: __import__("hashlib").sha256(t).hexdigest()
    before = spark.createDataFrame([("same", 3, day, "not looked at"), ("touched", 3, old, sha(b"touched")),
                                    ("edited", 4, old, sha(b"old")), ("gone", 1, day, "x")],
                                   "path string, size long, modified timestamp, hash string")
    seen = []

    def read(files):
        seen.append(sorted(r.path for r in files.collect()))
        return files.withColumn("content", F.col("path").cast("binary"))

    todo, kept = refresh_plan(listing, before, read)
    assert seen == [["edited", "new", "touched"]]
    assert sorted(r.path for r in todo.collect()) == ["edited", "new"]
    assert sorted((r.path, r.modified) for r in kept.collect()) == [("same", day), ("touched", day)]


def test_patterns(spark):
    from strata.operators.search import PatternError, matches

    words = spark.createDataFrame([("Ab",), ("ab",), ("É1",)], "w string")
    found = lambda pattern: sorted(r.w for r in words.where(matches(words["w"], pattern)).collect())
    assert found(r"^\p{Lu}\w+\z") == ["Ab", "É1"] and found(r"\P{L}$") == ["É1"] and found(r"(?P<x>a)b") == ["ab"]
    for bad in ("(", "a(?=b)", r"(a)\1"):
        with pytest.raises(PatternError):
            matches(words["w"], bad)
