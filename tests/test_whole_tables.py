"""Queries over whole tables, without SQL, against brute force in NumPy."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest

from plumbline.plans import catalog

CFG = catalog.CFG


def test_factor_cov_uses_every_vector(spark, sf):
    got = catalog.QUERIES["factor_cov_dims"](spark, sf).toPandas().pivot(index="i", columns="j", values="cov").to_numpy()
    v = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float)
    e, q = np.linalg.eigh(v.T @ v / len(v))
    common = (q[:, -3:] * e[-3:]) @ q[:, -3:].T
    want = common + np.diag(np.maximum(1 - np.diag(common), np.finfo(float).eps))
    assert len(v) > 12
    assert got.shape == want.shape == (64, 64)
    np.testing.assert_allclose(got, want, atol=2e-6)


@pytest.fixture(scope="module")
def brands(spark, tmp_path_factory):
    """25 brands on 90 days, every return flag, as the driver's two tables."""
    at = tmp_path_factory.mktemp("brands")
    rng = np.random.default_rng(3)
    shocks = rng.normal(0, 0.02, (90, 25)) + rng.normal(0, 0.02, (90, 1))
    prices = 100 * np.exp(np.cumsum(shocks, axis=0))
    days = [datetime.datetime(2020, 1, 1) + datetime.timedelta(k) for k in range(90)]
    rows = [(days[t], k, float(prices[t, k]), 1.0, "ANR"[(t + k) % 3]) for t in range(90) for k in range(25)]
    spark.createDataFrame(rows, "l_shipdate timestamp_ntz, l_partkey long, l_extendedprice double, l_quantity double, l_returnflag string").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k, f"Brand#{k:02}") for k in range(25)], "p_partkey long, p_brand string").write.parquet(f"{at}/part.parquet")
    return str(at)


@pytest.fixture(scope="module")
def inputs(spark, brands):
    """Adjusted returns, volatility, signal and plain returns of the panel, as days by assets."""
    e = catalog.engine(spark, brands, "p25").enriched.select("row_idx", "asset_ord", "price", "mu", "ret_adj", "vola").toPandas()
    wide = {c: e.pivot(index="row_idx", columns="asset_ord", values=c).to_numpy(float) for c in ("price", "mu", "ret_adj", "vola")}
    assert wide["price"].shape == (90, 25)
    wide["ret"] = np.vstack([np.full((1, 25), np.nan), wide["price"][1:] / wide["price"][:-1] - 1])
    return wide


def correlations(x):
    """EWM correlation of each day by direct sums over all earlier days; NaN until ``corr`` observations."""
    out = np.full((len(x), x.shape[1], x.shape[1]), np.nan)
    for t in range(len(x)):
        own = np.arange(t + 1)[np.isfinite(x[: t + 1]).all(axis=1)]
        if len(own) >= CFG.corr and np.isfinite(x[t]).all():
            w = CFG.beta_corr ** (t - own)
            m = (w @ x[own]) / w.sum()
            c = (x[own] * w[:, None]).T @ x[own] / w.sum() - np.outer(m, m)
            out[t] = c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
            np.fill_diagonal(out[t], 1)
    return out


def positions(mats, mu, vola):
    cash, status = np.zeros_like(mu), []
    for t, m in enumerate(mats):
        x = np.linalg.solve(m, mu[t]) if np.isfinite(m).all() else np.full(len(mu[t]), np.nan)
        ok = mu[t] @ x > 0 and np.sqrt(mu[t] @ x) > CFG.denom_tol
        status.append("zero_signal" if (np.abs(mu[t]) <= 1e-8).all() else "valid" if ok else "degenerate")
        if status[-1] == "valid":
            cash[t] = x / np.sqrt(mu[t] @ x)
    with np.errstate(invalid="ignore", divide="ignore"):
        return cash / vola, status


def sharpe(mats, mu, inputs):
    cash, _ = positions(mats, mu, inputs["vola"])
    profit = np.nansum(np.vstack([np.zeros((1, 25)), cash[:-1] * inputs["ret"][1:]]), axis=1) * CFG.position_scale / CFG.aum
    return np.sqrt(252) * profit.mean() / profit.std(ddof=1)


def shrunk(c, lam):
    return lam * c + (1 - lam) * np.eye(25)


def day_by_asset(df: pd.DataFrame, value: str):
    return df.pivot(index="row_idx", columns="asset_ord", values=value).to_numpy(float)


def test_diagnostics_of_all_brands(spark, brands, inputs):
    mats = [shrunk(c, CFG.shrink) for c in correlations(inputs["ret_adj"])]
    known = [t for t, m in enumerate(mats) if np.isfinite(m).all()]
    assert len(known) > 50
    run = lambda name: catalog.QUERIES[name](spark, brands).toPandas().sort_values("row_idx")
    cond, rank = run("condition_number_p25").condition_number.to_numpy(float), run("effective_rank_p25").effective_rank.to_numpy(float)
    np.testing.assert_allclose(cond[known], [np.linalg.cond(mats[t]) for t in known], atol=1e-5)
    spectra = [np.linalg.eigvalsh(mats[t]) / 25 for t in known]
    np.testing.assert_allclose(rank[known], [np.exp(-(p * np.log(p)).sum()) for p in spectra], atol=1e-5)
    util = day_by_asset(run("signal_utilisation_p25"), "utilisation")
    np.testing.assert_allclose(util[known], [np.linalg.solve(mats[t], inputs["mu"][t]) / inputs["mu"][t] for t in known], rtol=1e-4, atol=1e-5)
    residual = run("solver_residual").set_index("row_idx").iloc[:, -1].to_numpy(float)
    assert residual.shape == (90,)
    assert (residual[known] < 1e-9).all()
    assert np.isnan(residual[[t for t in range(90) if t not in known and np.abs(inputs["mu"][t]).max() > 1e-8]]).all()


def test_sweeps_of_all_brands(spark, brands, inputs):
    c = correlations(inputs["ret_adj"])
    want = lambda lam, mu: sharpe([shrunk(m, lam) for m in c], mu, inputs)
    run = lambda name: catalog.QUERIES[name](spark, brands).toPandas()
    assert run("sharpe_at_shrink_p25").sharpe.item() == pytest.approx(want(0.3, inputs["mu"]), abs=1e-5)
    assert run("naive_sharpe_p25").sharpe.item() == pytest.approx(want(CFG.shrink, np.ones((90, 25))), abs=1e-5)
    grid = run("lambda_sweep_p25").set_index("shrink").sharpe
    assert len(grid) == 21
    for lam in (0.0, 0.25, 0.5, 0.95):
        assert grid[lam] == pytest.approx(want(lam, inputs["mu"]), abs=1e-5)


def test_sliding_factor_model_of_all_brands(spark, brands, inputs):
    x, mats = np.nan_to_num(inputs["ret_adj"]), np.full((90, 25, 25), np.nan)
    for t in range(59, 90):
        e, v = np.linalg.eigh(x[t - 59 : t + 1].T @ x[t - 59 : t + 1] / 60)
        common = e[-1] * np.outer(v[:, -1], v[:, -1])
        mats[t] = common + np.diag(np.maximum(1 - np.diag(common), np.finfo(float).eps))
    run = lambda name: catalog.QUERIES[name](spark, brands).toPandas()
    cov = run("sw_cov_p25")
    assert len(cov) == 31 * 325
    np.testing.assert_allclose(cov["cov"], mats[cov.row_idx, cov.i, cov.j], atol=2e-6)
    cash, status = positions(mats, inputs["mu"], inputs["vola"])
    want = ["warmup"] * 59 + status[59:]
    assert list(run("sw_position_status_p25").sort_values("row_idx").status) == want
    got = run("sw_cash_position_p25")
    assert set(got[got.row_idx < 59].status) == {"warmup"}
    np.testing.assert_allclose(day_by_asset(got, "cash")[59:], cash[59:], rtol=1e-5, atol=1e-4)
