"""Long files are parsed in stretches, with the rows that the whole text has."""

import ast
import os
import random

import pytest

from strata.functions.parse_code import RELATIONS, parse_code
from strata.functions.stretches import Exports, stretches

PARTS = [
    "import os.path\n", "from a import b as c, d\n", "LIMIT = 3\n", '"""loose\ndef not_here(): pass\n"""\n', "# é comment\n\n",
    "@app.get('/x')\n@other\ndef f{n}(a: K{n}, *r, b=1):\n    '''doc'''\n    return g(a, 'é', b=2)\n", "if __name__ == '__main__':\n    main()\nelse:\n    x = 1\n",
    "class K{n}:\n    '''doc'''\n    SIZE = {n}\n\n    def m(self):\n        return self.m(1), re.compile('a+')\n", "try:\n    a()\nexcept E:\n    b()\nfinally:\n    c()\n",
    "x = [\n1,\n2]\n", "y = 1 + \\\n2\n", "z = f'''{n}\ndef in_string(): pass\n{{x!r}}'''\n", "__all__ = ['b',\n  \"a\", 'é']\n", "async def h{n}(): pass\n", "\n\n"]


def _rows(text, least, cuts):
    """What the stretches of a text give together."""
    out, imports, size, lines, symbols, blank, many = {n: [] for n in RELATIONS}, set(), 0, 0, 0, True, 0
    for part, tree, last in stretches([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)], least):
        found = parse_code("p.py", part, tree, (size, lines, symbols), blank)
        for name in RELATIONS:
            out[name] += found[name]
        size, lines, symbols, blank, many = size + len(part.encode()), lines + part.count("\n"), symbols + len(found["symbols"]), blank and not part.strip(), many + 1
    out["imports"] = sorted(set(out["imports"]), key=str)
    return out, many


def test_equal_to_the_whole():
    draw, most = random.Random(5), 0
    for _ in range(150):
        text = "".join(draw.choice(PARTS).replace("{n}", str(draw.randrange(9))) for _ in range(draw.randrange(30)))
        ast.parse(text)
        whole = parse_code("p.py", text)
        got, many = _rows(text, draw.choice([8, 60, 300]), sorted(draw.sample(range(len(text) + 1), min(3, len(text)))))
        most = max(most, many)
        for name in RELATIONS:
            assert got[name] == (sorted(whole[name], key=str) if name == "imports" else whole[name]), (name, text)
    assert most > 5


def test_a_stretch_is_short():
    text = "".join(f"def f_{n}():\n    return g(1)\n\n" for n in range(4000))
    assert max(len(part) for part, _, _ in stretches([text], 1000)) < 2000


def test_broken_from_there():
    text = "def a():\n    b()\n" * 20 + "print 'x'\n" + "def c():\n    d()\n" * 20
    parts = list(stretches([text], 40))
    assert "".join(p for p, _, _ in parts) == text and "print" in parts[-1][0] and parts[-1][1] is None
    got, _ = _rows(text, 40, [])
    assert got["calls"] == parse_code("p.py", text)["calls"] and got["symbols"] == parse_code("p.py", text)["symbols"]


def test_exports(spark):
    from pyspark.sql import functions as F

    from strata.functions import exprs

    texts = ["__all__ = ['b', \"a\",\u00a0'é' , '']", "x\n__all__", "__all__ = [1", "__all__ += []", "y ] __all__ = [\n'q',\n\t'q'] + ['r']", ""]
    want = [list(r[0]) for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(exprs.exports(F.col("t"))).collect()]
    for text, names in zip(texts, want, strict=True):
        for step in (1, 3, 100):
            held = Exports()
            for low in range(0, len(text), step):
                held.add(text[low:low + step])
            assert held.names() == names


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_no_row_grows_with_the_file(spark):
    """A file's rows are those of its symbols, not one that holds them all; structure makes no tokens."""
    from strata.sources.corpus import built

    code = built(spark, "/root/testdata/sf0.001")
    rows = code._of("symbols")
    assert "idents" not in rows.columns and dict(rows.dtypes)["symbols"].startswith("struct")
    assert rows.where("path = 'defs/p0.py'").count() > 20 and code.files.where("path = 'defs/p0.py'").count() == 1


def test_documents_give_a_row_a_node(spark):
    from strata.plans.relations import Docs, parse_docs

    text = "".join(f"k{n}: {n}\n" for n in range(5000))
    docs = Docs(parse_docs(spark.createDataFrame([("a.yaml", "yaml", text), ("b.json", "json", "{")], "path string, format string, content string")))
    assert docs.wide.where("path = 'a.yaml'").count() == docs.nodes.count() == 5000
    assert sorted((r.path, r.entries, r.lines) for r in docs.files.collect())[0] == ("a.yaml", 5000, 5000) and docs.files.count() == 2
