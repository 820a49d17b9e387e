"""Queries over the second generated tree: what the first one has no case of.

Orders are part of the result here: ``place`` is a row's number in the order
that the operator gives, so these results are collected in one partition; they
hold a row for a few names of each nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import exprs
from strata.functions.address import AddressError, parse_address, parse_doc_address
from strata.operators import documents, graph, search, symbols, tree
from strata.plans.catalog import _nodes, query
from strata.sources import scan
from strata.sources.corpus import kit, kit_files

_N = "n AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r, 'kit/n' || n_nationkey || '.py' AS path FROM nation)"

#: The definitions of a module, as the template in sources/corpus.py writes them:
#: dotted, kind, signature, lines, depth, hidden at depth two, descendants,
#: required, most, parameters, types, decorators.
_ROWS = [
    ("LIMIT", "variable", "LIMIT = @K", 6, 6, 1, 0, 0, 0, 0, "", "", ""),
    ("Kit_@K", "class", "class Kit_@K(Base):", 9, 25, 1, 0, 6, 0, 0, "", "", ""),
    ("Kit_@K.SIZE", "variable", "SIZE = @K", 11, 11, 2, 0, 0, 0, 0, "", "", ""),
    ("Kit_@K.pick", "function", "def pick(self, a: int) -> Kit_@K:", 13, 14, 2, 0, 0, 1, 1, "self a", "Kit_@K int", "@overload"),
    ("Kit_@K.pick", "function", "def pick(self, a: str, b: str) -> str:", 16, 17, 2, 0, 0, 2, 2, "self a b", "str", "@overload"),
    ("Kit_@K.pick", "function", "def pick(self, a, b=None): # chooses @N", 19, 21, 2, 0, 0, 1, 2, "self a b", "", ""),
    ("Kit_@K.Inner", "class", "class Inner:", 23, 25, 2, 1, 1, 0, 0, "", "", ""),
    ("Kit_@K.Inner.deep", "function", "async def deep(self, *args: Kit_@K, **kw):", 24, 25, 3, 0, 0, 1, 1, "self *args **kw", "Kit_@K", ""),
    ("shown_@K", "function", "def shown_@K(x, *rest):", 27, 30, 1, 0, 0, 1, -1, "x *rest", "", ""),
    ("lost_@K", "function", "def lost_@K():", 32, 33, 1, 0, 0, 0, 0, "", "", ""),
    ("nested_@K", "function", "def nested_@K():", 36, 36, 1, 0, 0, 0, 0, "", "", "")]
_FIELDS = "ord, dotted, kind, signature, first, last, depth, hidden, descendants, required, most, params, types, decorators"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def _filled(column: str) -> str:
    return f"replace(replace({column}, '@K', CAST(k AS VARCHAR)), '@N', name)"


_D = f"""{_N}, d AS (SELECT path, k, name, ord, {_filled('dotted')} AS dotted, kind, {_filled('signature')} AS signature, first, last, depth, hidden,
  descendants, required, most, params, {_filled('types')} AS types, decorators
  FROM n, (VALUES {_values([(k, *row) for k, row in enumerate(_ROWS)])}) AS t({_FIELDS}))"""


def _kit(spark, sf_dir):
    return kit(spark, sf_dir)


def _modules(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("path").rlike("^kit/n[0-9]"))


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with their number in the order that they come in."""
    one = rows.coalesce(1).withColumn("_at", F.monotonically_increasing_id())
    return one.withColumn("place", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


@query("kit_outline", f"""WITH {_D} SELECT row_number() OVER (ORDER BY path, ord) AS place, path || '#' || dotted AS address, kind, signature,
CAST(first AS BIGINT) AS start_line, CAST(last AS BIGINT) AS end_line, CAST(depth AS BIGINT) AS depth, CAST(hidden AS BIGINT) AS hidden_children FROM d WHERE depth <= 2""")
def kit_outline(spark, sf_dir):
    rows = symbols.outline(_modules(_kit(spark, sf_dir).symbols), 2)
    return _placed(rows).select("place", "address", "kind", "signature", *_long("start_line", "end_line", "depth", "hidden_children"))


@query("outline_kind_counts", f"""WITH {_D} SELECT kind, count(*) AS n FROM d GROUP BY kind
UNION ALL SELECT 'only ' || kind, count(*) FROM d WHERE kind = 'class' GROUP BY kind""")
def outline_kind_counts(spark, sf_dir):
    rows = _modules(_kit(spark, sf_dir).symbols)
    return symbols.kind_counts(symbols.outline(rows, 3)).unionByName(
        symbols.kind_counts(symbols.outline(rows, 3, "class")).withColumn("kind", F.concat(F.lit("only "), "kind")))


@query("parameters", f"""WITH {_D} SELECT path || '#' || dotted AS address, CAST(ord AS BIGINT) AS ord, CAST(required AS BIGINT) AS required, CAST(most AS BIGINT) AS most,
params, types, decorators, CAST(descendants AS BIGINT) AS descendants FROM d""")
def parameters(spark, sf_dir):
    text = lambda c: F.array_join(c, " ").alias(c)
    return _modules(_kit(spark, sf_dir).symbols).select(
        F.concat("path", F.lit("#"), "dotted").alias("address"), *_long("ord", "required"), F.coalesce("max_args", F.lit(-1)).cast("long").alias("most"),
        text("params"), F.array_join("type_names", " ").alias("types"), text("decorators"), F.col("descendants").cast("long").alias("descendants"))


@query("exports", f"WITH {_N} SELECT path, 'Kit_' || k AS name FROM n UNION ALL SELECT path, 'shown_' || k FROM n")
def exports(spark, sf_dir):
    return _kit(spark, sf_dir).files.select("path", F.explode("exports").alias("name"))


@query("file_flags", f"""WITH {_N} SELECT path, false AS is_test, false AS is_package_init, false AS broken, CAST(36 AS BIGINT) AS lines FROM n
UNION ALL SELECT 'kit/tests/test_n' || k || '.py', true, false, false, 6 FROM n UNION ALL SELECT 'kit/base.py', false, false, false, count(DISTINCT r) FROM n
UNION ALL SELECT 'kit/__init__.py', false, true, false, 1 UNION ALL SELECT 'kit/broken.py', false, false, true, 11""")
def file_flags(spark, sf_dir):
    return _kit(spark, sf_dir).files.select("path", "is_test", "is_package_init", F.col("error").isNotNull().alias("broken"), *_long("lines"))


@query("import_aliases", f"""WITH {_N} SELECT path, '.base' AS module, 'help_' || r AS name, 'h' || k AS alias FROM n
UNION ALL SELECT path, 'os.path', 'os.path', '' FROM n UNION ALL SELECT 'kit/tests/test_n' || k || '.py', 'kit.n' || k, 'shown_' || k, '' FROM n""")
def import_aliases(spark, sf_dir):
    return _kit(spark, sf_dir).imports.select("path", "module", "name", F.coalesce("alias", F.lit("")).alias("alias"))


@query("slice_overloads", f"""WITH {_D} SELECT path || '#' || dotted AS address, row_number() OVER (PARTITION BY path ORDER BY ord) AS number, CAST(3 AS BIGINT) AS of,
CAST(first AS BIGINT) AS start_line, CAST(last AS BIGINT) AS end_line, trim(decorators || ' ' || signature) AS signature FROM d WHERE dotted LIKE '%.pick'""")
def slice_overloads(spark, sf_dir):
    rows = _kit(spark, sf_dir).symbols
    wanted = [parse_address(f"kit/n{r.k}.py#Kit_{r.k}.pick") for r in
              spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k")).collect()]
    found = symbols.slices(rows, spark.createDataFrame([(a.path, a.dotted) for a in wanted], "path string, dotted string"))
    return found.select("address", *_long("number", "of", "start_line", "end_line"), "signature")


@query("available_names", """SELECT name, CAST(n AS BIGINT) AS n, CAST(place AS BIGINT) AS place
FROM (VALUES ('LIMIT', 1, 1), ('Kit_3', 1, 2), ('Kit_3.SIZE', 1, 3), ('Kit_3.pick', 3, 4), ('Kit_3.Inner', 1, 5)) AS t(name, n, place)""")
def available_names(spark, sf_dir):
    return _placed(symbols.available(_kit(spark, sf_dir).symbols, "kit/n3.py", 5)).select(F.col("dotted").alias("name"), "n", "place")


# ---- literals ---------------------------------------------------------------

_KIT_LITERALS = f"""{_N}, found AS (
SELECT path, k, line, kind, {_filled('value')} AS value, doc FROM n, (VALUES {_values([
    (1, "string", "Nation @N.", 1), (5, "string", "shown_@K", 0), (5, "string", "Kit_@K", 0), (6, "number", "@K", 0), (7, "number", "1", 0),
    (10, "string", "Kit of @N.", 1), (11, "number", "@K", 0), (21, "string", "@N-<>-<>", 0), (25, "number", "1", 0), (25, "regex", "^@N$", 0),
    (28, "number", "@K", 0), (29, "number", "1", 0), (33, "string", "same text", 0), (36, "string", "same text", 0)])}) AS t(line, kind, value, doc))"""


@query("literals_docstrings", f"""WITH {_KIT_LITERALS} SELECT 'with' AS docstrings, path, kind, value, count(*) AS n FROM found GROUP BY ALL
UNION ALL SELECT 'without', path, kind, value, count(*) FROM found WHERE doc = 0 GROUP BY ALL""")
def literals_docstrings(spark, sf_dir):
    rows = _modules(_kit(spark, sf_dir).literals)
    return search.literals(rows, docstrings=True).withColumn("docstrings", F.lit("with")).unionByName(
        search.literals(rows).withColumn("docstrings", F.lit("without"))).groupBy("docstrings", "path", "kind", "value").agg(F.count("*").alias("n"))


@query("literals_matching", f"""WITH {_KIT_LITERALS} SELECT 'skeleton' AS form, path, CAST(line AS BIGINT) AS line, value FROM found WHERE contains(value, '<>')
UNION ALL SELECT 'raw', path, 21, 'f"' || name || '-{{a}}-{{b!r}}"' FROM n
UNION ALL SELECT 'long', path, line, value FROM found WHERE kind = 'string' AND doc = 0 AND length(value) >= 9 AND NOT contains(value, '<>')""")
def literals_matching(spark, sf_dir):
    rows = _modules(_kit(spark, sf_dir).literals)
    parts = [("skeleton", search.literals(rows, match="<>")), ("raw", search.literals(rows, match=r"\{b!r", skeleton=False)),
             ("long", search.literals(rows, kind="string", min_len=9).where("NOT contains(value, '<>')"))]
    return _union([part.select(F.lit(form).alias("form"), "path", *_long("line"), "value") for form, part in parts])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_SCOPES = ["kit/n3.py#Kit_3", "kit/n3.py#L20-L33", "kit/n3.py#"]


@query("literals_scope", f"""WITH {_KIT_LITERALS} SELECT scope, CAST(line AS BIGINT) AS line, kind, value, count(*) AS n
FROM found, (VALUES ('{_SCOPES[0]}', 9, 25), ('{_SCOPES[1]}', 20, 33), ('{_SCOPES[2]}', 1, 99)) AS s(scope, low, high)
WHERE k = 3 AND doc = 0 AND line BETWEEN low AND high GROUP BY ALL""")
def literals_scope(spark, sf_dir):
    code = _kit(spark, sf_dir)
    return _union([search.literals(search.scope(code.literals, code.symbols, code.files, parse_address(raw))).groupBy(
        F.lit(raw).alias("scope"), *_long("line"), "kind", "value").agg(F.count("*").alias("n")) for raw in _SCOPES])


@query("literals_ranked", f"""WITH {_KIT_LITERALS}, g AS (SELECT kind, value, count(*) AS count, string_agg(line, ' ' ORDER BY path, line) AS lines
FROM found WHERE doc = 0 GROUP BY ALL) SELECT row_number() OVER (ORDER BY count DESC, kind, value) AS place, * FROM g""")
def literals_ranked(spark, sf_dir):
    rows = search.literal_groups(search.literals(_modules(_kit(spark, sf_dir).literals)))
    return _placed(rows).select("place", "kind", "value", "count", F.array_join(F.transform("sites", lambda s: s["line"].cast("string")), " ").alias("lines"))


# ---- search -----------------------------------------------------------------

_HITS = f"""{_N}, hits AS (SELECT path, 27 AS line, 'definition' AS occurrence, 'shown_' || k AS text, 'shown_' || k AS enclosing FROM n
UNION ALL SELECT path, 29, 'call', 'shown_' || k, 'shown_' || k FROM n
UNION ALL SELECT 'kit/tests/test_n' || k || '.py', 1, 'reference', 'shown_' || k, NULL FROM n
UNION ALL SELECT 'kit/tests/test_n' || k || '.py', 4, 'call', 'shown_' || k, 'test_shown_' || k FROM n)"""


@query("find_ranked", f"""WITH {_HITS}, p AS (SELECT row_number() OVER (ORDER BY string_split(path, '/'), line) AS place, * FROM hits)
SELECT place, path, CAST(line AS BIGINT) AS line, occurrence, text, place > 40 AS over_cap FROM p WHERE place <= 41""")
def find_ranked(spark, sf_dir):
    code = _kit(spark, sf_dir)
    rows = search.capped(search.find(code.idents, code.texts, "^shown_"), 40).orderBy(F.split("path", "/"), "byte")
    return _placed(rows).select("place", "path", *_long("line"), "occurrence", "text", "over_cap")


@query("find_summary", f"""WITH {_HITS} SELECT path, count(*) AS matches, coalesce(string_agg(DISTINCT enclosing, ' ' ORDER BY enclosing), '') AS symbols FROM hits GROUP BY path""")
def find_summary(spark, sf_dir):
    code = _kit(spark, sf_dir)
    return search.find_summary(search.find(code.idents, code.texts, "^shown_")).select("path", "matches", F.array_join("symbols", " ").alias("symbols"))


@query("find_kinds", f"""WITH {_HITS} SELECT occurrence, count(*) AS n FROM hits GROUP BY occurrence
UNION ALL SELECT 'whole', count(*) FROM hits WHERE text = 'shown_1' UNION ALL SELECT 'in tests', count(*) FROM hits WHERE path LIKE 'kit/tests/%'""")
def find_kinds(spark, sf_dir):
    code = _kit(spark, sf_dir)
    every = search.find(code.idents, code.texts, "^shown_").groupBy("occurrence").agg(F.count("*").alias("n"))
    whole = code.idents.where(search.matches_whole(F.col("text"), "shown_1|sho")).agg(F.count("*").alias("n")).select(F.lit("whole").alias("occurrence"), "n")
    tests = search.find(code.idents, code.texts, "^shown_", paths=["kit/tests", "./kit/tests/"]).agg(F.count("*").alias("n")).select(
        F.lit("in tests").alias("occurrence"), "n")
    return _union([every, whole, tests])


# ---- code graph -------------------------------------------------------------

_MET = f"""{_N}, c AS (SELECT count(*) AS h FROM n), met AS (
SELECT a.path || '#Kit_' || a.k || '.Inner.deep' AS target, b.path || '#Kit_' || b.k || '.Inner.deep' AS address, 25 AS line,
  CASE WHEN a.k = b.k THEN 0 ELSE 2 END AS rank, CASE WHEN a.k = b.k THEN 'self call inside the class' ELSE 'self call in another class' END AS reason, false AS is_test, b.path AS path
FROM n a, n b
UNION ALL SELECT a.path || '#Kit_' || a.k || '.Inner.deep', b.path || '#shown_' || b.k, 30, 2, 'arity 2 does not fit the signature', false, b.path FROM n a, n b
UNION ALL SELECT path || '#shown_' || k, 'kit/tests/test_n' || k || '.py#test_shown_' || k, 4, 0, 'imported by name', true, 'kit/tests/test_n' || k || '.py' FROM n
UNION ALL SELECT 'kit/base.py#help_' || r, path || '#shown_' || k, 30, 0, 'imported by name', false, path FROM n
UNION ALL SELECT 'kit/tests/test_n' || a.k || '.py#lost_in_tests', 'kit/tests/test_n' || b.k || '.py#test_shown_' || b.k, 4, CASE WHEN a.k = b.k THEN 1 ELSE 2 END,
  CASE WHEN a.k = b.k THEN 'bare call in the same file, ' || h || ' definitions share the name' ELSE 'bare call, ' || h || ' definitions share the name' END, true,
  'kit/tests/test_n' || b.k || '.py' FROM n a, n b, c
UNION ALL SELECT 'kit/broken.py#kept_by_broken', 'kit/broken.py#before', 2, 0, 'bare call in the same file', false, 'kit/broken.py'
UNION ALL SELECT 'kit/broken.py#before', 'kit/broken.py#kept_by_broken', 7, 0, 'bare call in the same file', false, 'kit/broken.py')"""


@query("callers_ranked", f"""WITH {_MET} SELECT row_number() OVER (ORDER BY target, rank, path, line) AS place, target, address, CAST(line AS BIGINT) AS line,
CASE rank WHEN 0 THEN 'certain' WHEN 1 THEN 'likely' ELSE 'possible' END AS confidence, reason, is_test FROM met""")
def callers_ranked(spark, sf_dir):
    """A call of a function in itself is no caller of it; the line after a refused one still counts."""
    rows = graph.ordered_callers(graph.callers(_kit(spark, sf_dir)))
    return _placed(rows).select("place", "target", "address", *_long("line"), "confidence", "reason", "is_test")


@query("callers_no_tests", f"WITH {_MET} SELECT target, count(*) AS callers, CAST(0 AS BIGINT) AS tests FROM met WHERE NOT is_test GROUP BY target")
def callers_no_tests(spark, sf_dir):
    return graph.caller_counts(graph.callers(_kit(spark, sf_dir), tests=False)).select("target", "callers", "tests")


@query("dead_ranked", f"""WITH {_D}, x AS (SELECT path, dotted, kind, first, last FROM d WHERE (dotted LIKE '%.pick' AND signature LIKE '%None%') OR dotted LIKE '%.Inner'
  OR dotted LIKE 'lost%' OR dotted LIKE 'nested%' UNION ALL SELECT 'kit/broken.py', 'never_called', 'function', 11, 11)
SELECT row_number() OVER (ORDER BY path, first, path || '#' || dotted) AS place, path || '#' || dotted AS address, kind, CAST(last - first + 1 AS BIGINT) AS lines,
  CAST(sum(last - first + 1) OVER () AS BIGINT) AS total FROM x""")
def dead_ranked(spark, sf_dir):
    rows = _placed(graph.dead(_kit(spark, sf_dir)))
    return rows.select("place", "address", "kind", *_long("lines"), F.sum("lines").over(Window.partitionBy()).cast("long").alias("total"))


@query("callees_first_three", f"""WITH {_N}, c AS (SELECT count(*) AS h FROM n), f AS (SELECT path || '#Kit_' || k || '.Inner.deep' AS address, k FROM n ORDER BY path LIMIT 3), x AS (
SELECT path || '#Kit_' || n.k || '.Inner.deep' AS target, address, f.k, h || ' definitions share this name' AS note FROM n, f, c
UNION ALL SELECT path || '#shown_' || n.k, address, f.k, h || ' definitions share this name' FROM n, f, c
UNION ALL SELECT path || '#shown_' || k, path || '#shown_' || k, k, 'certain' FROM n
UNION ALL SELECT path || '#shown_' || k, 'kit/base.py#help_' || r, r, 'certain' FROM n)
SELECT row_number() OVER (ORDER BY target, address) AS place, target, address, note FROM x""")
def callees_first_three(spark, sf_dir):
    code = _kit(spark, sf_dir)
    targets = _modules(code.symbols).where("name = 'deep' OR name LIKE 'shown_%'").select("path", "dotted")
    return _placed(graph.packet_callees(code, targets)).select("place", "target", "address", "note")


@query("entry_scripts", f"""WITH {_N}, x AS (SELECT path || '#shown_' || k AS address, 'console script `run' || k || '`' AS reason FROM n
UNION ALL SELECT 'nowhere:main (unresolved)', 'console script `lost`') SELECT row_number() OVER (ORDER BY address, reason) AS place, address, reason FROM x""")
def entry_scripts(spark, sf_dir):
    manifest = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(
        F.lit("run"), F.col("n_nationkey").cast("string"), F.lit(' = "kit.n'), F.col("n_nationkey").cast("string"), F.lit(":shown_"),
        F.col("n_nationkey").cast("string"), F.lit('"')).alias("line")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    text = F.concat(F.lit("[project]\nname = 'kit'\n\n[project.scripts]\n# one a module\nlost = 'nowhere:main'\n"), "lines", F.lit("\n[tool.other]\nx = 'y:z'\n"))
    code = _kit(spark, sf_dir)
    scripts = scan.console_scripts(manifest.select(F.lit("pyproject.toml").alias("path"), text.alias("text")), code.files.select("path"))
    return _placed(tree.entry_points(code, scripts)).select("place", "address", "reason")


# ---- trees on disk ----------------------------------------------------------

@query("tree_scan", f"""WITH {_N}, f AS (SELECT path FROM n UNION ALL SELECT 'kit/tests/test_n' || k || '.py' FROM n
UNION ALL SELECT unnest(['kit/base.py', 'kit/__init__.py', 'kit/broken.py', 'setup.py', 'late.py']))
SELECT 'source' AS what, path FROM f UNION ALL SELECT 'snapshot', path FROM f
UNION ALL SELECT 'manifest', unnest(['pyproject.toml', 'setup.py', 'docs/requirements-dev.txt']) UNION ALL SELECT 'json', 'docs/a.JSON' UNION ALL SELECT 'markdown', 'docs/b.md'
UNION ALL SELECT 'yaml', unnest(['docs/c.yml', 'docs/d.yaml'])""")
def tree_scan(spark, sf_dir):
    """The second tree as files: what is listed, what is pruned, and a snapshot
    that is refreshed after a file came."""
    import uuid

    from pyarrow import fs

    from strata.plans.relations import build
    from strata.plans.scratch import shared_dir

    root = f"{shared_dir(spark)}/strata-tree-{uuid.uuid4().hex[:12]}"
    store, top = fs.FileSystem.from_uri(root)

    def put(path: str, text: str) -> None:
        store.create_dir(f"{top}/{path}".rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(f"{top}/{path}") as out:
            out.write(text.encode())

    for row in kit_files(spark, sf_dir).collect():  # two files a nation
        put(row.path, row.content)
    for path in ("pyproject.toml", "setup.py", "docs/requirements-dev.txt", "docs/deep/er/setup.cfg", "docs/a.JSON", "docs/b.md", "docs/c.yml",
                 "docs/d.yaml", "docs/e.txt", ".git/x.py", "venv/y.py", "kit/__pycache__/z.py", ".hidden/h.json", "node_modules/m/package.json"):
        put(path, "{}" if path.lower().endswith("json") else "")
    folder = f"{root}-snapshots"
    build(scan.source_listing(spark, root), folder, 0, scan.opened)
    put("late.py", "def late():\n    return 1\n")
    code = build(scan.source_listing(spark, root), folder, 1, scan.opened)
    return _union([
        scan.source_files(spark, root).select(F.lit("source").alias("what"), "path"), code.files.select(F.lit("snapshot").alias("what"), "path"),
        scan.manifests(spark, root).select(F.lit("manifest").alias("what"), "path"),
        scan.doc_files(spark, root).where("path LIKE 'docs/%'").select(F.col("format").alias("what"), "path")])


# ---- documents and text -----------------------------------------------------

@query("doc_resolve", """WITH k AS (SELECT 'regions/' || r_name || '.json' AS path, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS i
FROM region JOIN nation ON n_regionkey = r_regionkey), t AS (SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 1)
SELECT DISTINCT path || '#nations[1].name' AS address, 'scalar' AS kind FROM k WHERE i = 1
UNION ALL SELECT DISTINCT 'customers/n1.yaml#nation', 'scalar' FROM customer WHERE c_nationkey = 1
UNION ALL SELECT 'talks/t' || conv_id || '.md#Talk ' || conv_id || '/Turn ' || turn, 'section' FROM t""")
def doc_resolve(spark, sf_dir):
    names = [r.r_name for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect()]
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").first()
    every = [parse_doc_address(f"regions/{name}.json#nations[1].name") for name in names] + [
        parse_doc_address("customers/n1.yaml#nation"), parse_doc_address(f"talks/t{talk.conv_id}.md#Talk {talk.conv_id}/Turn {talk.turn}")]
    rows = _union([documents.resolve(_nodes(spark, sf_dir, target.format), target) for target in every])
    return rows.select(documents.doc_address(F.col("path"), F.col("node_path")).alias("address"), "kind").distinct()


@query("doc_find_values", """WITH k AS (SELECT 'regions/' || r_name || '.json' AS path, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS i
FROM region JOIN nation ON n_regionkey = r_regionkey WHERE true)
SELECT row_number() OVER (ORDER BY path, i) AS place, path || '#nations[' || i || '].name' AS address, 'value' AS where_, '"' || n_name || '"' AS text
FROM k WHERE regexp_matches(n_name, '^NATION_1')""")
def doc_find_values(spark, sf_dir):
    rows = documents.find(_nodes(spark, sf_dir, "json"), '^"NATION_1', keys=False)
    return _placed(rows).select("place", "address", "where_", "text")


_ADDRESSES = [
    ("a.py#", "outline", "a.py", "", 0, 0), ("a.py#L3", "lines", "a.py", "", 3, 3), ("a.py#L3-L9", "lines", "a.py", "", 3, 9),
    ("a.py#L3-9", "lines", "a.py", "", 3, 9), ("a.py#Kit.run", "symbol", "a.py", "Kit.run", 0, 0), ("a.py#Load", "symbol", "a.py", "Load", 0, 0),
    ("a.py", "error", "", "", 0, 0), ("a.py#L9-L3", "error", "", "", 0, 0), ("a.py#L0", "error", "", "", 0, 0), ("#x", "error", "", "", 0, 0)]


@query("address_grammar", f"""SELECT raw, kind, path, dotted, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last
FROM (VALUES {_values(_ADDRESSES)}) AS t(raw, kind, path, dotted, first, last)""")
def address_grammar(spark, sf_dir):
    def read(raw: str) -> tuple:
        try:
            a = parse_address(raw)
        except AddressError:
            return raw, "error", "", "", 0, 0
        return raw, a.kind, a.path, a.dotted, a.first, a.last

    return spark.createDataFrame([read(raw) for raw, *_ in _ADDRESSES], "raw string, kind string, path string, dotted string, first long, last long")


@query("number_texts", """SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS commas, format('{:,}', o_custkey % 3) || CASE WHEN o_custkey % 3 = 1 THEN ' match' ELSE ' matches' END AS plural,
'order_' || (o_orderkey % 10) AS bare FROM orders""")
def number_texts(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    quoted = F.concat(F.lit('"order_'), (F.col("o_orderkey") % 10).cast("string"), F.lit('"'))
    return orders.select("o_orderkey", exprs.commas(F.col("o_orderkey") * 1000).alias("commas"),
                         exprs.plural(F.col("o_custkey") % 3, "match", "matches").alias("plural"), exprs.unquote(quoted).alias("bare"))
