"""The file stream and the SQL table functions."""


def test_follow(spark, tmp_path):
    from strata.streaming.follow import follow, latest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.py").write_text("def one(): pass\n")
    where = str(folder), str(tmp_path / "out"), str(tmp_path / "mark")
    follow(spark, *where).awaitTermination(120)
    (folder / "b.py").write_text("class Two:\n    def go(self): one()\n")
    follow(spark, *where).awaitTermination(120)
    code = latest(spark, where[1])
    assert sorted(r.dotted for r in code.symbols.collect()) == ["Two", "Two.go", "one"]
    assert [r.name for r in code.calls.collect()] == ["one"]


def test_table_functions(spark):
    from strata.functions.udtf import register

    register(spark)
    spark.createDataFrame([("def f(a):\n    g(a, 1)\n", '{"k": [1]}')], "code string, doc string").createOrReplaceTempView("files")
    assert [tuple(r) for r in spark.sql("SELECT s.dotted, s.kind, s.signature FROM files, LATERAL extract_symbols(code) s").collect()] == [
        ("f", "function", "def f(a):")]
    assert [tuple(r) for r in spark.sql("SELECT c.name, c.arity, c.enclosing FROM files, LATERAL extract_calls(code) c").collect()] == [("g", 2, "f")]
    assert [r.node_path for r in spark.sql("SELECT d.node_path FROM files, LATERAL doc_nodes('json', doc) d").collect()] == ["k", "k[0]"]


def test_expressions(spark):
    from pyspark.sql import functions as F

    from strata.functions import exprs

    text = "x = 1\n__all__ = ['b', \"a\",\n 'b', ]\n"
    row = spark.createDataFrame([(text, "./a\\b", "", "tests/x.py", 1234567, '"k"', 'Rb"x"')], "t string, p string, e string, q string, n long, k string, s string").select(
        exprs.exports(F.col("t")).alias("exports"), exprs.exports(F.col("p")).alias("none"), exprs.slash_path(F.col("p")).alias("slash"),
        exprs.slash_path(F.col("e")).alias("dot"), exprs.is_test_path(F.col("q")).alias("test"), exprs.plural(F.col("n"), "row", "rows").alias("rows"),
        exprs.unquote(F.col("k")).alias("key"), exprs.string_prefix(F.col("s")).alias("prefix"), exprs.collapse_ws(F.lit(" a \n\t b ")).alias("flat"),
        exprs.truncate_text(F.lit("y" * 70 + "\nz")).alias("cut"), exprs.pad(F.lit("abc"), 2).alias("pad"),
        exprs.arity_label(F.lit(1), F.lit(None).cast("int")).alias("arity")).first()
    assert row.asDict() == {
        "exports": ["a", "b"], "none": [], "slash": "a/b", "dot": ".", "test": True, "rows": "1,234,567 rows", "key": "k", "prefix": "rb",
        "flat": "a b", "cut": "y" * 57 + "...", "pad": "abc", "arity": "1+"}


def test_patterns(spark):
    from pyspark.sql import functions as F

    from strata.operators.search import matches, matches_whole

    word = F.lit("naïve_go")
    got = spark.range(1).select(matches(word, "go"), matches(word, "go", True), matches(word, r"^\w+$"), matches_whole(word, r"na\w+"),
                                matches_whole(word, "go"), matches(word, "(?P<a>g)o")).first()
    assert tuple(got) == (True, False, True, True, False, True)


def test_listing_by_executors(spark, tmp_path, monkeypatch):
    from strata.sources import scan

    for k in range(12):
        for name in ("a.py", "b.txt", "sub/__init__.py", "sub/deep/c.pyi", "build/d.py", ".hidden/e.py"):
            file = tmp_path / f"m{k}" / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(f"x = {k}\n")
    (tmp_path / "setup.py").write_text("")
    (tmp_path / "m1" / "tox.ini").write_text("")
    (tmp_path / "m1" / "sub" / "setup.cfg").write_text("")
    (tmp_path / "link").symlink_to(tmp_path / "m1")

    def rows():
        return sorted(map(tuple, scan.source_listing(spark, str(tmp_path)).collect()))

    whole = rows()
    assert [r[0] for r in whole] == sorted([f"m{k}/{n}" for k in range(12) for n in ("a.py", "sub/__init__.py", "sub/deep/c.pyi")] + ["setup.py"])
    for driver, task, share in ((1, 1, 1), (1, 2, 5), (3, 1000, 20)):
        monkeypatch.setattr(scan, "DRIVER_FOLDERS", driver)
        monkeypatch.setattr(scan, "TASK_FOLDERS", task)
        monkeypatch.setattr(scan, "TASK_SHARE", share)
        assert rows() == whole
        assert sorted(r.path for r in scan.manifests(spark, str(tmp_path)).collect()) == ["m1/tox.ini", "setup.py"]
    assert scan.source_listing(spark, str(tmp_path / "none")).count() == 0
