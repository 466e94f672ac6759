"""Dense linear algebra on single timestamps, NumPy only: the one part that Spark cannot express."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np

from ..errors import ConditionWarning, DimensionMismatchError, FactorModelError, NonSquareMatrixError, SingularMatrixError

CONDITION_LIMIT = 1e12
WARMUP, ZERO, DEGENERATE, VALID = "warmup", "zero_signal", "degenerate", "valid"
#: Signals up to this size count as zero.
ZERO_SIGNAL = 1e-8
#: Signals up to this size have no utilisation.
TINY_SIGNAL = 1e-14


def solve_many(mats: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems; NaN rows where a matrix is singular or not finite."""
    try:
        return np.linalg.solve(mats, rhs[..., None])[..., 0]
    except np.linalg.LinAlgError:  # one singular matrix spoils the whole stack
        out = np.full_like(rhs, np.nan)
        for k in range(len(mats)):
            try:
                out[k] = np.linalg.solve(mats[k], rhs[k])
            except np.linalg.LinAlgError:
                continue
        return out


def risk_positions(mats: np.ndarray, mu: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(risk, nu, valid, x)``: ``x = C^-1 mu`` over ``nu = sqrt(mu x)``; zeros where ``nu`` is no number or too small."""
    x = solve_many(mats, mu)
    with np.errstate(invalid="ignore"):
        square = np.einsum("ti,ti->t", mu, x)
        nu = np.where(square > 0, np.sqrt(np.where(square > 0, square, 0)), np.nan)
        valid = np.isfinite(nu) & (nu > tol)
    risk = np.where(valid[:, None], x / np.where(valid, nu, 1)[:, None], 0.0)
    return risk, nu, valid, x


def solve(a: np.ndarray, b: np.ndarray, limit: float = CONDITION_LIMIT) -> np.ndarray:
    """Solves for the assets with a finite diagonal and leaves NaN for the others; warns above ``limit``."""
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise NonSquareMatrixError(a.shape)
    if len(b) != len(a):
        raise DimensionMismatchError(len(b), len(a))
    ok = np.isfinite(np.diag(a))
    out = np.full(len(b), np.nan)
    if ok.any():
        m = a[np.ix_(ok, ok)]
        check_condition(m, limit)
        out[ok] = _solve_positive(m, b[ok])
    return out


def _solve_positive(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By Cholesky factors where the matrix is positive definite, by the general factorisation where it is not."""
    try:
        low = np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        try:
            return np.linalg.solve(m, b)
        except np.linalg.LinAlgError as e:
            raise SingularMatrixError from e
    return np.linalg.solve(low.T, np.linalg.solve(low, b))


def check_condition(m: np.ndarray, limit: float = CONDITION_LIMIT) -> float:
    c = float(np.linalg.cond(m)) if np.isfinite(m).all() else np.nan
    if c > limit:
        warnings.warn(f"condition number {c:.3g} is above {limit:.3g}", ConditionWarning, stacklevel=3)
    return c


def valid_part(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which assets have a finite diagonal, and their part of the matrix."""
    ok = np.isfinite(np.diag(m))
    return ok, m[np.ix_(ok, ok)]


def condition_number(m: np.ndarray) -> float:
    ok, part = valid_part(m)
    return float(np.linalg.cond(part)) if ok.any() and np.isfinite(part).all() else np.nan


def effective_rank(m: np.ndarray) -> float:
    ok, part = valid_part(m)
    if not ok.any() or not np.isfinite(part).all():
        return np.nan
    e = np.clip(np.linalg.eigvalsh(part), 0, None)
    if e.sum() <= 0:
        return np.nan
    p = e[e > 0] / e.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def residual(m: np.ndarray, mu: np.ndarray) -> float:
    """Length of ``C x - mu`` over the assets solved for; 0 for a zero signal, NaN if nothing can be solved."""
    if (np.abs(mu) <= ZERO_SIGNAL).all():
        return 0.0
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", ConditionWarning)
            x = solve(m, mu)
    except SingularMatrixError:
        return np.nan
    ok = np.isfinite(x)
    return float(np.linalg.norm(m[np.ix_(ok, ok)] @ x[ok] - mu[ok])) if ok.any() else np.nan


def utilisation(m: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """``x_i / mu_i`` where the signal is not tiny; zeros for a zero signal."""
    if (np.abs(mu) <= ZERO_SIGNAL).all():
        return np.zeros(len(mu))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", ConditionWarning)
            x = solve(m, mu)
    except SingularMatrixError:
        return np.full(len(mu), np.nan)
    return np.where(np.abs(mu) > TINY_SIGNAL, x / np.where(np.abs(mu) > TINY_SIGNAL, mu, 1), np.nan)


@dataclass(frozen=True)
class FactorModel:
    """``loadings @ factor_cov @ loadings.T + diag(idio)``."""

    loadings: np.ndarray
    factor_cov: np.ndarray
    idio: np.ndarray

    def __post_init__(self) -> None:
        b, f, d = self.loadings, self.factor_cov, self.idio
        if b.ndim != 2 or f.shape != (b.shape[1], b.shape[1]) or d.shape != (b.shape[0],):
            raise FactorModelError(f"loadings {b.shape}, factor covariance {f.shape} and variances {d.shape} do not fit")
        if not (d > 0).all():
            raise FactorModelError("idiosyncratic variances must be positive")

    @classmethod
    def from_returns(cls, returns: np.ndarray, k: int) -> FactorModel:
        if returns.ndim != 2:
            raise FactorModelError("returns must be a matrix")
        if not 1 <= k <= min(returns.shape):
            raise FactorModelError(f"k must be between 1 and {min(returns.shape)}")
        return cls.from_gram(returns.T @ returns / len(returns), k)

    @classmethod
    def from_gram(cls, gram: np.ndarray, k: int) -> FactorModel:
        """From second moments: the leading eigenpairs, with unit total variance for each asset."""
        e, v = np.linalg.eigh(gram)
        e, v = np.clip(e[::-1][:k], 0, None), v[:, ::-1][:, :k]
        d = np.maximum(1 - np.einsum("ik,k,ik->i", v, e, v), np.finfo(float).eps)
        return cls(v, np.diag(e), d)

    @property
    def n_assets(self) -> int:
        return self.loadings.shape[0]

    @property
    def n_factors(self) -> int:
        return self.loadings.shape[1]

    @property
    def covariance(self) -> np.ndarray:
        return self.loadings @ self.factor_cov @ self.loadings.T + np.diag(self.idio)

    def _middle(self) -> np.ndarray:
        inv = np.linalg.inv(self.factor_cov)
        return inv + self.loadings.T @ (self.loadings / self.idio[:, None])

    @property
    def woodbury_condition_number(self) -> float:
        try:
            np.linalg.cholesky(self.factor_cov)
            return float(np.linalg.cond(self._middle()))
        except np.linalg.LinAlgError:
            return np.inf

    def solve(self, rhs: np.ndarray, limit: float = CONDITION_LIMIT) -> np.ndarray:
        """Woodbury: only systems of the size of the factors are solved."""
        if rhs.shape != (self.n_assets,):
            raise DimensionMismatchError(len(rhs), self.n_assets)
        check_condition(self.factor_cov, limit)
        try:
            middle = self._middle()
            check_condition(middle, limit)
            y = rhs / self.idio
            return y - (self.loadings @ np.linalg.solve(middle, self.loadings.T @ y)) / self.idio
        except np.linalg.LinAlgError as e:
            raise SingularMatrixError("factor covariance") from e


def cap_turnover(cash: np.ndarray, previous: np.ndarray, most: float | None) -> np.ndarray:
    """Scales the step from ``previous`` so that its absolute sum is at most ``most``; missing counts as no step."""
    if most is None:
        return cash
    step = np.nan_to_num(cash) - np.nan_to_num(previous)
    total = np.abs(step).sum()
    if total <= most:
        return cash
    return np.where(np.isfinite(cash), np.nan_to_num(previous) + step * most / total, np.nan)
