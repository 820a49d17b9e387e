"""Sources are parsed in a process that is replaced, so no worker keeps their names."""

import os

import pytest

from strata.functions.apart import Apart
from strata.plans.relations import _arrow, _parsed, wide


def _process(text):
    return os.getpid()


def _fails(text):
    raise ValueError(text)


def test_replaced_after_some_text():
    with Apart(10) as apart:
        seen = [apart(_process, "x" * 4) for _ in range(6)]
        assert seen[0] == seen[1] == seen[2] != seen[3] == seen[5] and os.getpid() not in seen
        with pytest.raises(ValueError, match="why"):
            apart(_fails, "why")
    with pytest.raises(ProcessLookupError):
        os.kill(seen[5], 0)


def test_names_are_not_kept(spark):
    """The names of a source are interned for good by the process that parses it."""
    import sys

    name, schema = "kept_by_" + os.urandom(6).hex(), _arrow(wide(("symbols",)))
    with Apart() as apart:
        rows = [r for b in _parsed({"path": "p.py"}, [f"def {name}(): pass\n"], {}, ("symbols",), schema, apart) for r in b.to_pylist()]
    assert [r["symbols"]["name"] for r in rows] == [name]
    assert sys.getrefcount(sys.intern(name[:5] + name[5:])) < 1000
