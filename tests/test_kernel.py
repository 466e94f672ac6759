from __future__ import annotations

import warnings

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.config import EngineConfig, SlidingWindow
from plumbline.errors import ConditionWarning, DimensionMismatchError, FactorModelError, NonSquareMatrixError, SingularMatrixError
from plumbline.functions import kernel as K


def test_direction_with_identity():
    risk, nu, ok, _ = K.risk_positions(np.eye(2)[None], np.array([[3.0, 4.0]]), 1e-12)
    np.testing.assert_allclose(risk[0], [0.6, 0.8], rtol=1e-15)
    assert ok[0] and nu[0] == 5


def test_one_singular_matrix_does_not_spoil_the_others():
    mats = np.array([np.ones((2, 2)), np.eye(2)])
    risk, _, ok, _ = K.risk_positions(mats, np.ones((2, 2)), 1e-12)
    assert list(ok) == [False, True]
    assert (risk[0] == 0).all()


def test_solve_drops_unknown_assets_and_checks_shapes():
    m = np.array([[1.0, 0.2, np.nan], [0.2, 1.0, np.nan], [np.nan] * 3])
    x = K.solve(m, np.array([1.0, 2.0, 3.0]))
    np.testing.assert_allclose(m[:2, :2] @ x[:2], [1, 2])
    assert np.isnan(x[2])
    with pytest.raises(NonSquareMatrixError):
        K.solve(np.ones((2, 3)), np.ones(2))
    with pytest.raises(DimensionMismatchError):
        K.solve(np.eye(2), np.ones(3))
    with pytest.warns(ConditionWarning), pytest.raises(SingularMatrixError):
        K.solve(np.ones((2, 2)), np.ones(2))


def test_diagnostics_in_closed_form():
    c = 0.4
    m = np.array([[1, c], [c, 1]])
    assert K.condition_number(m) == pytest.approx((1 + c) / (1 - c))
    p = np.array([(1 + c) / 2, (1 - c) / 2])
    assert K.effective_rank(m) == pytest.approx(np.exp(-(p * np.log(p)).sum()))
    assert K.residual(m, np.array([1.0, 2.0])) < 1e-12
    assert K.residual(m, np.zeros(2)) == 0
    assert np.isnan(K.condition_number(np.full((2, 2), np.nan)))


def test_factor_model_equals_svd_and_explicit_inverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 6))
    m = K.FactorModel.from_returns(x, 2)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    low = (vt[:2].T * s[:2] ** 2 / 50) @ vt[:2]
    np.testing.assert_allclose(m.covariance, low + np.diag(np.maximum(1 - np.diag(low), np.finfo(float).eps)), atol=1e-12)
    b = rng.normal(size=6)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", ConditionWarning)
        np.testing.assert_allclose(m.solve(b), np.linalg.solve(m.covariance, b), rtol=1e-8)
    assert m.woodbury_condition_number >= 1
    for bad in (lambda: K.FactorModel.from_returns(x[0], 1), lambda: K.FactorModel.from_returns(x, 7), lambda: K.FactorModel(m.loadings, m.factor_cov, -m.idio)):
        with pytest.raises(FactorModelError):
            bad()
    with pytest.raises(DimensionMismatchError):
        m.solve(np.ones(5))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=5), st.floats(0.1, 50))
def test_cap_never_exceeds_the_limit(cash, most):
    cash = np.array(cash)
    previous = np.zeros(len(cash))
    out = K.cap_turnover(cash, previous, most)
    assert np.abs(out - previous).sum() <= most * (1 + 1e-9)


def test_config_bounds():
    good = dict(vola=8, corr=16, clip=3.0, shrink=0.5, aum=1.0)
    for bad in (dict(vola=0), dict(corr=4), dict(clip=0), dict(shrink=1.5), dict(aum=-1), dict(denom_tol=0), dict(max_nan_fraction=1), dict(cost_per_unit=-1), dict(max_turnover=0)):
        with pytest.raises(ValueError):
            EngineConfig(**good | bad)
    with pytest.raises(TypeError, match="SlidingWindow"):
        EngineConfig.make(**good, window=5)
    with pytest.raises(ValueError):
        SlidingWindow(10, 2, max_components=3)
    cfg = EngineConfig(**good, max_turnover=3.0, covariance=SlidingWindow(30, 2))
    assert cfg.replace(shrink=0.1).max_turnover == 3.0
    assert cfg.replace(max_turnover=None).max_turnover is None
    assert EngineConfig.from_json(cfg.to_json()) == cfg
    assert (cfg.covariance_mode, cfg.window, cfg.n_factors) == ("sliding_window", 30, 2)
