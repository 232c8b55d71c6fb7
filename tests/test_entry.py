import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_each_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_flagship_query_runs(spark):
    assert entry.entry(spark).count() > 0
