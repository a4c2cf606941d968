"""The driver's contract: names, stable schemas, independence of the optional subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names_match():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["rowId", "sessionId", "turn", "fc", "fd", "flat", "stalled"] and df.count() > 0


def test_core_does_not_need_the_optional_subpackage():
    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('cardlake.llm') else f(n, *a)\nimport __spark_entry__ as e\nassert not any(k.startswith('cardlake.llm') for k in sys.modules); q = e.queries(); assert 'p4_found' in q and 'p6_found' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0]).returncode == 0
