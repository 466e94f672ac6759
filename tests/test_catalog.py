"""Registered queries of the engine against DuckDB.

The formulas for two and three assets in SQL need panels without gaps, which begin at this size.
"""

from __future__ import annotations

import pytest
from helpers import duck, rows

from plumbline.plans import catalog

SOME = "panel_long validation_stats ret_adj vola ewm_cor cor_tensor cash_position sw_cash_position condition_number effective_rank signal_utilisation rank_ic all_view tilt_timing net_cost_nav stats_summary lambda_sweep asset_correlation".split()


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert set(got.columns) == set(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 75


def test_entry_point_imports_without_corpus_operators():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
