from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("blocked", ["plumbline.llm", "corpus_pipeline"])
def test_entry_imports_where_the_corpus_operators_cannot_be(blocked):
    code = f"""
import sys
sys.modules[{blocked!r}] = None
import __spark_entry__ as e
from plumbline.plans import catalog
assert set(e.queries()) == set(catalog.QUERIES), set(e.queries()) ^ set(catalog.QUERIES)
assert set(e.oracle_sql()) == set(catalog.ORACLE_SQL)
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert "corpus operators are left out" in run.stderr


def test_repeated_prices_are_named(spark):
    from plumbline.sources.panel import complete

    rows = spark.createDataFrame([("t1", "a", 1.0), ("t1", "a", 2.0), ("t2", "a", 1.0)], "ts string, asset string, price double")
    with pytest.raises(Exception, match="several prices at t1"):
        complete(rows).collect()
