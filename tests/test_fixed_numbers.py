"""Eight sectors over five years against fixed numbers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import wide

from plumbline.config import EngineConfig
from plumbline.operators import pnl
from plumbline.operators.engine import Engine

# The panel's parameters and what it must give.
SECTORS = "Technology Healthcare Financials Energy Consumer Industrials Materials Utilities".split()
DRIFT = np.array([0.14, 0.10, 0.09, 0.06, 0.08, 0.09, 0.07, 0.05]) / 252
VOLA = np.array([0.22, 0.18, 0.20, 0.28, 0.17, 0.19, 0.24, 0.14]) / np.sqrt(252)
BETA = np.array([1.3, 0.9, 1.1, 0.8, 0.95, 1.0, 1.1, 0.5])
IC_MEAN, ICIR, FINAL_NAV, VALID = 0.010676938245513712, 0.01920162208642282, 30557566.430894211, 1200


def recursive(r: np.ndarray, alpha: float) -> np.ndarray:
    out = np.empty_like(r)
    out[0] = r[0]
    for t in range(1, len(r)):
        out[t] = alpha * r[t] + (1 - alpha) * out[t - 1]
    return out


@pytest.fixture(scope="module")
def sectors(spark):
    rng = np.random.default_rng(2024)
    market = rng.normal(0, 0.012, 1260)
    idio = rng.normal(0, 1, (1260, 8))
    own = np.sqrt(np.maximum(VOLA**2 - (BETA * 0.012) ** 2, 1e-6))
    r = DRIFT + np.outer(market, BETA) + idio * own
    price = 100 * np.exp(np.cumsum(r, axis=0))
    mu = np.tanh(100 * (recursive(r, 2 / 6) - recursive(r, 2 / 61)))
    as_table = lambda x: wide(spark, {n: x[:, k] for k, n in enumerate(SECTORS)})
    cfg = EngineConfig(vola=16, corr=60, clip=4.0, shrink=0.6, aum=1e7)
    panel = Engine.from_wide(as_table(price), as_table(mu), cfg).panel
    return Engine(panel, cfg, settled=True)


def test_statuses_and_signal(sectors):
    status = sectors.position_status.toPandas().set_index("row_idx").status
    assert (status == "valid").sum() == VALID
    assert status[0] == "zero_signal"
    s = sectors.ic_summary().first()
    assert s.ic_mean == pytest.approx(IC_MEAN, abs=1e-10)
    assert s.icir == pytest.approx(ICIR, abs=1e-10)
    ic = sectors.ic().toPandas().set_index("row_idx").ic
    assert np.isnan(ic[0])


def test_final_value(sectors):
    nav = pnl.nav_accumulated(sectors.daily, 1e7).orderBy(F.desc("row_idx")).first()
    assert nav.NAV_accumulated == pytest.approx(FINAL_NAV, rel=1e-9)


def test_settled_and_lazy_engines_agree(sectors):
    lazy = Engine(sectors.panel, sectors.cfg, validate=False)
    one, two = (e.cash_position.toPandas().sort_values(["row_idx", "asset_ord"]).cash.to_numpy(float) for e in (lazy, sectors))
    np.testing.assert_allclose(one, two, rtol=1e-7, atol=1e-9)
