"""A source tree and documents generated from the driver's tables, by Spark SQL.

The parser reads real files' worth of text, while an oracle can recompute every
result from the tables.  Files: ``defs`` has one function an order, ``uses`` one
function a line item that calls it, ``parts`` one class a part, ``routes`` one
decorated function a nation; JSON, YAML and Markdown come from regions,
customers and conversations.

A second, smaller tree (``kit``) has one module a nation and its test, with what
the first one lacks: docstrings, overloads, nested classes, recursion, exports,
aliases, interpolated strings, a test folder, a package file and a file with a
line that does not parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.plans.relations import Code, Docs, Parts, parse_code, parse_docs, parse_pieces

#: Bodies are numbered in this order; equal rows are interchangeable.
LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate"

_PIECES = """
WITH lines AS (
  SELECT l.*, l_suppkey % 64 AS f, row_number() OVER (PARTITION BY l_suppkey % 64 ORDER BY LINE_ORDER) AS n FROM {lineitem} l
), pieces AS (
  SELECT concat('defs/p', o_custkey % 16, '.py') AS path, 1 AS part, o_orderkey AS k, concat(
    '# status ', o_orderstatus, '\\ndef order_', o_orderkey, '(a, b):\\n    return "', o_orderpriority, '", ', o_custkey, '\\n\\n') AS t
  FROM {orders}
  UNION ALL
  SELECT DISTINCT concat('uses/p', f, '.py'), 0, l_orderkey, concat('from defs import order_', l_orderkey, '\\n')
  FROM lines WHERE l_returnflag = 'R'
  UNION ALL
  SELECT concat('uses/p', f, '.py'), 1, n, concat('def line_', n, '():\\n    return order_', l_orderkey, '(1, 2',
    CASE WHEN l_linestatus = 'O' THEN ', 3' ELSE '' END, ')\\n\\n') FROM lines
  UNION ALL
  SELECT concat('parts/', replace(p_brand, '#', '_'), '.py'), 1, p_partkey, concat(
    'class Part_', p_partkey, ':\\n    SIZE = ', p_size, '\\n    def ', replace(p_name, ' ', '_'),
    '(self, x: Part_', p_partkey, '):\\n        return self.', replace(p_name, ' ', '_'), '(x), other.', replace(p_name, ' ', '_'),
    '(x), re.compile("', p_type, '")\\n\\n') FROM {part}
  UNION ALL
  SELECT concat('routes/r', n_regionkey, '.py'), 1, n_nationkey, concat(
    '@app.get("/', n_name, '")\\ndef nation_', n_nationkey, '():\\n    return ', n_regionkey, '\\n\\n') FROM {nation}
  UNION ALL
  SELECT 'main.py', 1, 0, 'def main():\\n    return 0\\n\\nif __name__ == "__main__":\\n    main()\\n'
)
"""
_FILES = _PIECES + """SELECT path, array_join(transform(array_sort(collect_list(struct(part, k, t))), p -> p.t), '') AS content
FROM pieces GROUP BY path
"""

_DOCS = """
SELECT concat('regions/', r_name, '.json') AS path, 'json' AS format, concat('{{"key": ', r_regionkey, ', "nations": [',
  array_join(transform(array_sort(collect_list(struct(n_nationkey, n_name))), n -> concat(
    '{{"id": ', n.n_nationkey, ', "name": "', n.n_name, '"}}')), ', '), ']}}\\n') AS content
FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name
UNION ALL
SELECT concat('customers/n', c_nationkey, '.yaml'), 'yaml', concat('nation: ', c_nationkey, '\\ncustomers:\\n',
  array_join(transform(array_sort(collect_list(struct(c_custkey, c_name, c_mktsegment))), c -> concat(
    '  c', c.c_custkey, ':\\n    name: ', c.c_name, '\\n    segment: ', c.c_mktsegment, '\\n')), ''))
FROM {customer} GROUP BY c_nationkey
UNION ALL
SELECT concat('talks/t', conv_id, '.md'), 'markdown', concat('# Talk ', conv_id, '\\n\\n',
  array_join(transform(array_sort(collect_list(struct(turn, role))), c -> concat(
    '## Turn ', c.turn, '\\n\\n```\\n# not a heading\\n```\\n', c.role, '\\n\\n')), ''))
FROM (SELECT DISTINCT conv_id, turn, role FROM {conversations}) GROUP BY conv_id
"""

#: Line for line, so that the SQL of the queries can name its places.
KIT_MODULE = """\"\"\"Nation {name}.\"\"\"
from .base import help_{region} as h{k}
import os.path

__all__ = ["shown_{k}", 'Kit_{k}']
LIMIT = {k}
_hidden = 1

class Kit_{k}(Base):
    \"\"\"Kit of {name}.\"\"\"
    SIZE = {k}

    @overload
    def pick(self, a: int) -> Kit_{k}: ...

    @overload
    def pick(self, a: str, b: str) -> str: ...

    def pick(self, a, b=None):
        # chooses {name}
        return f"{name}-{{a}}-{{b!r}}"

    class Inner:
        async def deep(self, *args: Kit_{k}, **kw):
            return self.deep(1), r"^{name}$"

def shown_{k}(x, *rest):
    if x > {k}:
        return shown_{k}(x - 1)
    return help_{region}(x) + h{k}(x, x), other.deep(x, x)

def lost_{k}():
    return "same text"

if LIMIT:
    def nested_{k}(): return "same text"
"""
KIT_TEST = """from kit.n{k} import shown_{k}

def test_shown_{k}():
    assert shown_{k}({k}) and lost_in_tests()

def lost_in_tests(): pass
"""
KIT_BASE = """def help_{region}(x): return x
"""
KIT_BROKEN = """def before():
    kept_by_broken()

print 'old'

def kept_by_broken():
    before()
    exec 'x' in {{}}
    alone()

def never_called(): pass
"""
KIT_PACKAGE = "def only_here(): pass\n"


def _concat(text: str, fields: dict[str, str]) -> str:
    """A template as an SQL expression."""
    import re

    parts = []
    for literal, name in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{(\w+)\}", text):
        if name:
            parts.append(f"CAST({fields[name]} AS STRING)")
        else:
            literal = literal.replace("{{", "{").replace("}}", "}").replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
            parts.append(f"'{literal}'")
    return f"concat({', '.join(parts)})"


def kit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"k": "n_nationkey", "name": "n_name", "region": "n_regionkey"}
    once = " UNION ALL ".join(f"SELECT '{path}', {_concat(text, {})}" for path, text in (
        ("kit/broken.py", KIT_BROKEN), ("kit/__init__.py", KIT_PACKAGE)))
    text = f"""SELECT concat('kit/n', n_nationkey, '.py') AS path, {_concat(KIT_MODULE, fields)} AS content FROM __nation
        UNION ALL SELECT concat('kit/tests/test_n', n_nationkey, '.py'), {_concat(KIT_TEST, fields)} FROM __nation
        UNION ALL SELECT 'kit/base.py', array_join(transform(array_sort(collect_list(n_regionkey)), k -> {_concat(KIT_BASE, {"region": "k"})}), '')
          FROM (SELECT DISTINCT n_regionkey FROM __nation) UNION ALL {once}"""
    # Braces of the texts are not placeholders.
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("__nation", "{nation}"), nation=nation)


#: Relations that are parsed together.
STRUCTURE, TOKENS = ("symbols", "calls", "imports"), ("idents", "texts", "literals")
_BUILT: dict[tuple, Code] = {}
_DOCS_BUILT: dict[tuple, Docs] = {}
_KITS: dict[tuple, Code] = {}


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = "region nation customer part orders lineitem conversations".split()
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names if "{" + n + "}" in text})


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _FILES.replace("LINE_ORDER", LINE_ORDER))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _DOCS)


def kit(spark: SparkSession, sf_dir: str) -> Code:
    """The parsed second tree of a folder, written once a session."""
    from strata.plans.scratch import keep

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KITS:
        _KITS[key] = Code(keep(parse_code(kit_files(spark, sf_dir)), "kit"))
    return _KITS[key]


def code_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code files in pieces: each file's in order and in one partition."""
    rows = _sql(spark, sf_dir, _PIECES.replace("LINE_ORDER", LINE_ORDER) + "SELECT path, part, k, t AS text FROM pieces")
    dealt = rows.repartition(16 * spark.sparkContext.defaultParallelism, "path")
    return dealt.sortWithinPartitions("path", "part", "k", "text").select("path", "text")


def built(spark: SparkSession, sf_dir: str) -> Code:
    """The code of the corpus of a folder.  A query that asks for structure makes
    no tokens; each part is parsed and written once a session."""
    from strata.plans.scratch import keep

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = Parts({
            (*part, *also): lambda part=part: keep(parse_pieces(code_pieces(spark, sf_dir), part), "code")
            for part, also in ((STRUCTURE, ("files",)), (TOKENS, ()))})
    return _BUILT[key]


def built_docs(spark: SparkSession, sf_dir: str) -> Docs:
    """The documents of the corpus of a folder, written once a session."""
    from strata.plans.scratch import keep

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DOCS_BUILT:
        _DOCS_BUILT[key] = Docs(keep(parse_docs(doc_files(spark, sf_dir)), "docs"))
    return _DOCS_BUILT[key]
