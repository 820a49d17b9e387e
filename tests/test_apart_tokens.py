"""The parse of the tokens keeps no names of the sources in its worker, and loses no row by it."""

import os
import sys

from strata.functions.apart import Apart
from strata.functions.parse_code import parse_code
from strata.functions.stretches import STRETCH
from strata.plans.relations import _arrow, _parsed, wide
from strata.sources.corpus import TOKENS


def _kept(name):
    """Whether this process holds the name for good."""
    return sys.getrefcount(sys.intern(name[:5] + name[5:])) > 1000


def _rows(text, apart):
    batches = _parsed({"path": "p.py"}, [text], {}, TOKENS, _arrow(wide(TOKENS)), apart)
    return [row for batch in batches for row in batch.to_pylist()]


def _names(k):
    return [f"kept_by_{os.urandom(6).hex()}" for _ in range(k)]


def test_definitions_of_all_stretches(spark):
    """names of the stretches before the last, and of the last."""
    names = _names(3 * STRETCH // 40)
    with Apart() as apart:
        rows = _rows("".join(f"def {name}(): pass\n\n" for name in names), apart)
    assert [r["idents"]["text"] for r in rows if r["idents"] and r["idents"]["occurrence"] == "definition"] == names
    assert not any(map(_kept, (names[0], names[-1])))


def test_comments_of_replaced_processes(spark):
    """comments keep their places when the process is replaced after each stretch."""
    names = _names(4 * STRETCH // 64)
    text = "".join(f"# état {k % 3}\ndef {name}(a):\n    return {k}\n\n" for k, name in enumerate(names))
    processes = []

    class Seen(Apart):
        def close(self):
            processes.extend([] if self._process is None else [self._process.pid])
            super().close()

    with Seen(1) as apart:
        rows = _rows(text, apart)
    assert len(set(processes)) >= 4
    assert not any(map(_kept, (names[0], names[-1])))  # before this process parses the text as a whole
    assert [tuple(r["texts"].values()) for r in rows if r["texts"]] == parse_code("p.py", text, wanted=("texts",))["texts"]


def test_exact_names_of_a_broken_file(spark):
    """a text that is refused is read again without some lines, in the process as well."""
    names = _names(50)
    text = "".join(f"def {name}(): pass\n\n" for name in names) + f"print 'old'\n\n{names[7]}({names[7]})\n"
    with Apart() as apart:
        rows = _rows(text, apart)
    assert [r["error"] for r in rows if r["error"]] == ["syntax error"]
    assert [r["idents"]["occurrence"] for r in rows if r["idents"] and r["idents"]["text"] == names[7]] == ["definition", "call", "reference"]
    assert not any(map(_kept, names))
