"""Graded callers counted without a row for each pair."""

import os

import pytest
from pyspark.sql import functions as F

from strata.operators import graph
from strata.plans.relations import Code, parse_code

SHARED = """class {c}:
    def run(self, a, *rest):
        self.run(1); cls.run(); other.run(1, 2); run(3)
        return self.stop()
    class Inner:
        def run(self):
            def deep(): return self.run() or run()
            return self.run(1)
def run(a, b=1):
    if a: return run(a)
    return run(a, 2), run(), self.run(1)
def run(): run(1); stop()
run(1)
"""


def _counted(rows):
    return sorted(map(tuple, rows.groupBy("confidence", "reason").agg(F.count("*")).collect()))


def test_equal_to_the_rows_of_callers(spark):
    files = [(f"p{k}.py", "from p0 import run as go, stop\n" * (k % 2) + SHARED.format(c="ABC"[k % 3])) for k in range(4)]
    files += [("tests/test_p.py", "from p0 import run\nrun(1)\ngo()\n"), ("q.py", "def stop(): stop()\ndef go(): pass\n")]
    code = Code(parse_code(spark.createDataFrame(files, "path string, content string")).cache())
    for targets in (None, code.symbols.where("path <> 'p1.py'").select("path", "dotted")):
        for tests in (True, False):
            want = _counted(graph.callers(code, targets, tests))
            assert sorted(map(tuple, graph.tier_counts(code, targets, tests).collect())) == want and len(want) > 8


def test_no_pair_of_a_frequent_name_is_a_row(spark):
    """3,000 methods of a name, each called twice: 18 million pairs, more than are joined here."""
    text = "".join(f"class C{k}:\n    def run(self): return self.run(), other.run()\n" for k in range(3000))
    code = Code(parse_code(spark.createDataFrame([("p.py", text)], "path string, content string")).cache())
    got = {r.reason: r.n for r in graph.tier_counts(code, code.symbols.where("kind = 'function'").select("path", "dotted")).collect()}
    assert got == {"self call inside the class": 3000, "self call in another class": 3000 * 2999,
                   "attribute call on `other`, 3000 definitions share the name": 3000 * 3000}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_second_tree(spark):
    from strata.sources.corpus import kit

    code = kit(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, graph.tier_counts(code).collect())) == _counted(graph.callers(code))
