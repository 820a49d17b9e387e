"""Commands over a small tree of our own: text, JSON, exit codes, caches, streams."""

import json

import pytest

from strata.cli import run

FILES = {
    "shop/cart.py": '"""Carts."""\nimport re\nfrom .money import Price\n\nLIMIT = 40\n\n\nclass Cart:\n    """Holds items."""\n\n'
                    '    def add(self, item: Price, n: int = 1):\n        self._check(n)\n        return total(item, n)\n\n'
                    '    def _check(self, n):\n        if n > LIMIT:\n            raise ValueError(f"too many: {n}")\n\n\n'
                    'def total(item, n):\n    return item * n\n\n\ndef unused(a):\n    # total is not called\n    return re.match("^a+$", a)\n',
    "shop/money.py": "class Price:\n    pass\n\n\ndef total(x):\n    return x\n",
    "shop/__init__.py": '__all__ = ["unused_too"]\n\n\ndef unused_too():\n    pass\n',
    "web.py": 'from shop.cart import Cart\n\n\n@app.get("/cart")\ndef show():\n    return Cart().add(1)\n\n\ndef main():\n    show()\n\n\nif __name__ == "__main__":\n    main()\n',
    "tests/test_cart.py": "from shop.cart import Cart\n\n\ndef test_add():\n    Cart().add(1, 2)\n",
    "build/skip.py": "def add(): pass\n",
    "pyproject.toml": '[project.scripts]\nshop = "web:main"\nlost = "nowhere:main"\n',
    "conf.yaml": "a:\n  b: 1\n  c: [x, y]\n",
    "notes.md": "# One\ntext\n## Two\nmore\n",
    "bad.json": "{",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "latin.py").write_bytes(b"x = '\xe9'\n")
    return root


@pytest.fixture()
def call(spark, tree, monkeypatch):
    monkeypatch.chdir(tree)
    return lambda *arguments: run(list(arguments), spark)


def test_slice(call):
    code, out, _ = call("code", "slice", "shop/cart.py#Cart._check")
    assert code == 0 and out == (
        'shop/cart.py#Cart._check  L15-L17  3 lines\n    def _check(self, n):\n        if n > LIMIT:\n'
        '            raise ValueError(f"too many: {n}")\n\n1 match, 3 lines\n')
    assert call("code", "slice", "web.py#show", "--signature-only", "--quiet")[1] == (
        'web.py#show  L4-L5  2 lines\n@app.get("/cart")\ndef show():\n')
    assert call("code", "slice", "web.py#show", "--no-decorators")[1].startswith("web.py#show  L5-L6  2 lines\ndef show():")
    assert call("code", "slice", "web.py#L1-L1", "--quiet")[1] == "web.py#L1  L1  1 line\nfrom shop.cart import Cart\n"
    code, out, _ = call("code", "slice", "web.py#nope")
    assert code == 1 and out == "no symbol `nope` in web.py\navailable:\n  web.py#show\n  web.py#main\n"
    assert "budget reached" in call("code", "slice", "shop/cart.py#Cart", "--budget", "40")[1]


@pytest.mark.parametrize("arguments, message", [
    (["code", "slice", "web.py"], "has no `#`"), (["code", "slice", "gone.py#x"], "not found"), (["code", "slice", "latin.py#x"], "not valid utf-8"),
    (["code", "map", "gone"], "not found"), (["code", "find", "("], "pattern"), (["code", "find", "(?=x)"], "look-around"),
    (["code", "find", "x", "--kind", "k"], "unknown kind"), (["doc", "slice", "bad.json#a"], "cannot parse"),
    (["doc", "slice", "web.py#a"], "unsupported format"), (["doc", "find", "x", "--keys", "--values"], "mutually exclusive")])
def test_errors(call, arguments, message):
    code, out, err = call(*arguments)
    assert code == 2 and not out and message in err


def test_map(call):
    code, out, _ = call("code", "map", ".", "--depth", "1")
    assert code == 0 and out.startswith(".  6 source files  56 lines") and "  shop/  3 files  37 lines" in out and "python    5 files  56 lines" in out
    for line in ('web.py#L13   __main__ guard', 'web.py#main  console script `shop`', 'nowhere:main (unresolved)', 'web.py#show  @app.get("/cart")'):
        assert " ".join(line.split()) in " ".join(out.split())
    got = json.loads(call("code", "map", "shop/cart.py", "--depth", "1", "--json")[1])
    assert [(s["name"], s["hidden_children"]) for s in got["symbols"]] == [("LIMIT", 0), ("Cart", 2), ("total", 0), ("unused", 0)]
    assert [s["name"] for s in json.loads(call("code", "map", "shop/cart.py", "--kind", "fn", "--json")[1])["symbols"]] == [
        "add", "_check", "total", "unused"]


def test_find(call):
    got = json.loads(call("code", "find", "^total$", "--json")[1])
    assert [(h["path"], h["line"], h["occurrence"], h["enclosing"]) for f in got["files"] for h in f["hits"]] == [
        ("shop/cart.py", 13, "call", "Cart.add"), ("shop/cart.py", 20, "definition", "total"), ("shop/money.py", 5, "definition", "total")]
    assert call("code", "find", "total", "shop/money.py", "--kind", "call")[0] == 1
    assert "comment" in call("code", "find", "not called", "--include-comments")[1]
    assert call("code", "find", "x", "missing")[0] == 1


def test_literals(call):
    got = json.loads(call("code", "literals", "shop", "--json")[1])
    assert [(g["kind"], g["value"], g["count"]) for g in got["groups"]] == [
        ("number", "1", 1), ("number", "40", 1), ("regex", "^a+$", 1), ("string", "too many: <>", 1), ("string", "unused_too", 1)]
    inside = json.loads(call("code", "literals", "--in", "shop/cart.py#Cart", "--no-group", "--include-docstrings", "--json")[1])
    assert [x["value"] for x in inside["literals"]] == ["Holds items.", "1", "too many: <>"]
    assert call("code", "literals", "shop", "--match", "^zz")[0] == 1


def test_callers(call):
    got = json.loads(call("code", "callers", "shop/cart.py#Cart.add", "--no-cache", "--json")[1])
    assert [(c["address"], c["confidence"], c["is_test"]) for c in got["callers"]] == [
        ("tests/test_cart.py#test_add", "likely", True), ("web.py#show", "likely", False)]
    assert len(json.loads(call("code", "callers", "shop/cart.py#Cart.add", "--no-cache", "--no-tests", "--json")[1])["callers"]) == 1
    got = json.loads(call("code", "callers", "shop/cart.py#total", "--no-cache", "--json")[1])
    assert [(c["confidence"], c["reason"]) for c in got["callers"]] == [("likely", "bare call in the same file, 2 definitions share the name")]
    got = json.loads(call("code", "callers", "shop/cart.py#Cart._check", "--no-cache", "--json")[1])
    assert [c["reason"] for c in got["callers"]] == ["self call inside the class"]
    assert call("code", "callers", "shop/cart.py#unused", "--no-cache")[0] == 1
    assert call("code", "callers", "shop/cart.py#", "--no-cache")[0] == 1


def test_packet_and_dead(call):
    got = json.loads(call("code", "packet", "shop/cart.py#Cart.add", "--no-cache", "--json")[1])
    assert [c["note"] for c in got["callers"]] == ["likely L5", "likely L6"]
    assert [(c["address"], c["note"]) for c in got["callees"]] == [
        ("shop/cart.py#Cart._check", "certain"), ("shop/cart.py#total", "2 definitions share this name"),
        ("shop/money.py#total", "2 definitions share this name")]
    assert [t["address"] for t in got["types"]] == ["shop/money.py#Price"]
    got = json.loads(call("code", "dead", "--no-cache", "--json")[1])
    assert [c["address"] for c in got["candidates"]] == ["shop/cart.py#unused"]


def test_cache(call, tree):
    first = call("code", "dead")
    assert (tree / ".strata-cache/.gitignore").read_text() == "*\n"
    assert call("code", "dead") == first
    (tree / "extra.py").write_text("def lonely(): pass\n")
    assert "extra.py#lonely" in call("code", "dead")[1]
    (tree / "extra.py").unlink()
    assert call("code", "dead") == first
    for part in (tree / ".strata-cache").glob("v*/*.parquet"):
        part.write_bytes(b"broken")
    assert call("code", "dead") == first


def test_documents(call):
    assert call("doc", "slice", "conf.yaml#a.c[1]", "--quiet")[1] == "conf.yaml#a.c[1]  L3  1 line  scalar\ny\n"
    assert call("doc", "slice", "conf.yaml#a", "--with-key", "--quiet")[1] == "conf.yaml#a  L1-L3  2 lines  mapping\na:\n  b: 1\n  c: [x, y]\n"
    assert call("doc", "slice", "notes.md#One/Two")[0] == 0 and call("doc", "slice", "notes.md#Two")[0] == 1
    got = json.loads(call("doc", "map", "conf.yaml", "--json")[1])
    assert [(e["address"], e["hidden_children"]) for e in got["entries"]] == [("conf.yaml#a", 0), ("conf.yaml#a.b", 0), ("conf.yaml#a.c", 2)]
    got = json.loads(call("doc", "map", ".", "--json")[1])
    assert [(d["path"], d["entries"]) for d in got["documents"]] == [("conf.yaml", 5), ("notes.md", 2)]
    got = json.loads(call("doc", "find", "^[bx]$", "--json")[1])
    assert [(m["address"], m["where_"], m["text"]) for m in got["matches"]] == [("conf.yaml#a.b", "key", "b"), ("conf.yaml#a.c[0]", "value", "x")]


def test_runs_are_equal(call):
    for arguments in (["code", "map", "."], ["code", "find", "a"], ["doc", "map", "."]):
        assert call(*arguments) == call(*arguments)
