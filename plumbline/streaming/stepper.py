"""The engine one timestamp at a time, with a state of fixed size.

Correlations keep decayed sums per pair of assets instead of a history, so a step costs the same on
the first row and on the millionth. Rules are those of the batch engine; only rows before ``corr``
(or ``window``) timestamps have the status ``warmup``.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as arrow_fs

from ..config import EngineConfig, SlidingWindow
from ..errors import DimensionMismatchError, SingularMatrixError, StateFormatError
from ..functions import kernel as K

FORMAT = 1


def _filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if ":/" in path else (arrow_fs.LocalFileSystem(), path)


@dataclass
class State:
    """Sums per asset (log and percentage returns share weights), sums per pair or the last rows."""

    n: int
    prev_price: np.ndarray
    prev_cash: np.ndarray
    sums: np.ndarray  # 7 x N: log x, x2; pct x, x2; w, w2, count
    pairs: np.ndarray  # 4 x N x N: x_i given both, x_i x_j, w, count (empty in sliding mode)
    rows: np.ndarray  # window x N (empty in EWM mode)

    @classmethod
    def empty(cls, n_assets: int, cfg: EngineConfig) -> State:
        sliding = isinstance(cfg.covariance, SlidingWindow)
        return cls(
            0, np.full(n_assets, np.nan), np.zeros(n_assets), np.zeros((7, n_assets)), np.zeros((4, 0 if sliding else n_assets, n_assets)),
            np.full((cfg.covariance.window if sliding else 0, n_assets), np.nan),
        )

    def save(self, path: str, cfg: EngineConfig, names: Sequence[str] = ()) -> None:
        """Writes the state, its settings and the asset names as one file; ``path`` may be a URI that Arrow reads."""
        fs, at = _filesystem(path)
        with fs.open_output_stream(at) as f:
            f.write(self.to_json(cfg, names).encode())

    @classmethod
    def load(cls, path: str) -> tuple[State, EngineConfig, list[str]]:
        """What :meth:`save` wrote; another version or a missing part is an error that says which."""
        fs, at = _filesystem(path)
        with fs.open_input_file(at) as f:
            text = f.read().decode()
        state, cfg = cls.from_json(text)
        return state, cfg, json.loads(text).get("assets", [])

    def to_json(self, cfg: EngineConfig, names: Sequence[str] = ()) -> str:
        body = {f.name: np.asarray(getattr(self, f.name), float).tolist() for f in dataclasses.fields(self)}
        return json.dumps({"format": FORMAT, "config": cfg.to_json(), "n_assets": len(self.prev_price), "assets": list(names), **body})

    @classmethod
    def from_json(cls, text: str) -> tuple[State, EngineConfig]:
        try:
            d = json.loads(text)
        except ValueError as e:
            raise StateFormatError("this is not a saved state") from e
        if not isinstance(d, dict) or "format" not in d:
            raise StateFormatError("the state has no format version")
        if d["format"] != FORMAT:
            raise StateFormatError(f"state format {d.get('format')}, this version reads {FORMAT}")
        missing = {f.name for f in dataclasses.fields(cls)} | {"config", "n_assets"}
        if missing := missing - set(d):
            raise StateFormatError(f"the state lacks {sorted(missing)}")
        n, cfg = d["n_assets"], EngineConfig.from_json(d["config"])
        shape = {"sums": (7, n), "pairs": (4, -1, n), "rows": (-1, n)}
        arrays = {k: np.array(d[k], float).reshape(*shape.get(k, (n,))) if k != "pairs" or np.size(d[k]) else np.zeros((4, 0, n)) for k in ("prev_price", "prev_cash", "sums", "pairs", "rows")}
        return cls(int(d["n"]), **arrays), cfg


@dataclass(frozen=True)
class Step:
    cash: np.ndarray
    status: str
    vola: np.ndarray


def _std(s: np.ndarray, ss: np.ndarray, w: np.ndarray, ww: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        var = np.maximum(ss / w - (s / w) ** 2, 0) * w * w / (w * w - ww)
        return np.where(n <= 1, np.where(n == 1, 0.0, np.nan), np.sqrt(var))


def as_vector(values: np.ndarray | Mapping[str, float], names: Sequence[str] | None) -> np.ndarray:
    """Values in the order of ``names``, given as an array or by asset name; a name that lacks a value is an error, others are left out."""
    if not isinstance(values, Mapping):
        return np.asarray(values, float)
    if names is None:
        raise StateFormatError("values by asset name need the names of the assets")
    if missing := [n for n in names if n not in values]:
        raise StateFormatError(f"no value for {missing}")
    return np.array([np.nan if values[n] is None else float(values[n]) for n in names])


def step(state: State, price: np.ndarray | Mapping[str, float], mu: np.ndarray | Mapping[str, float], cfg: EngineConfig, names: Sequence[str] | None = None) -> Step:
    """Advances ``state`` by one timestamp; NaN marks what is missing.

    ``price`` and ``mu`` are arrays in the order of the assets, or mappings by the names in ``names``.
    A price of zero or less has no logarithm, so neither it nor the step after it has a return.
    """
    price, mu = as_vector(price, names), as_vector(mu, names)
    n_assets = len(state.prev_price)
    for v in (price, mu):
        if v.shape != (n_assets,):
            raise DimensionMismatchError(len(v), n_assets)
    price = np.where(np.isfinite(price), price, np.nan)
    mu = np.where(np.isfinite(mu), mu, 0.0)
    with np.errstate(all="ignore"):
        r = np.where((price > 0) & (state.prev_price > 0), price / state.prev_price, np.nan)
        seen = np.isfinite(np.log(r))
        lr, pr = np.where(seen, np.log(r), 0), np.where(seen, r - 1, 0)
    b = cfg.beta_vola
    decay = np.array([b, b, b, b, b, b * b, 1])[:, None]
    state.sums = decay * state.sums + np.array([lr, lr * lr, pr, pr * pr, seen, seen, seen], float)
    s, ss, p, pp, w, ww, n = state.sums
    std = np.where(seen, _std(s, ss, w, ww, n), np.nan)
    vola = np.where(seen & (n >= cfg.vola), _std(p, pp, w, ww, n), np.nan)
    with np.errstate(all="ignore"):
        x = np.where(std == 0, np.where(lr == 0, np.nan, np.sign(lr) * cfg.clip), np.clip(lr / std, -cfg.clip, cfg.clip))
    known = np.isfinite(x)
    x0 = np.where(known, x, 0.0)
    sliding = isinstance(cfg.covariance, SlidingWindow)
    if sliding:
        state.rows = np.vstack([state.rows[1:], x])
    else:
        both = np.outer(known, known).astype(float)
        c = cfg.beta_corr
        state.pairs = np.array([c, c, c, 1])[:, None, None] * state.pairs + np.array([both * x0[:, None], np.outer(x0, x0), both, both])
    state.n += 1
    state.prev_price = price
    active = np.isfinite(price)
    if state.n < (cfg.covariance.window if sliding else cfg.corr) and active.any():
        return Step(np.full(n_assets, np.nan), K.WARMUP, vola)
    risk, status = np.where(active, 0.0, np.nan), K.DEGENERATE
    if active.any():
        if (np.abs(mu[active]) <= K.ZERO_SIGNAL).all():
            status = K.ZERO
        else:
            found = _sliding(state, active, mu, cfg) if sliding else _ewm(state, active, mu, known, cfg)
            if found is not None:
                risk[active], status = found, K.VALID
    with np.errstate(all="ignore"):
        cash = np.where(vola == 0, np.nan, risk / vola)
    cash = K.cap_turnover(cash, state.prev_cash, cfg.max_turnover)
    state.prev_cash = cash
    return Step(cash, status, vola)


def _guarded(x: np.ndarray, mu: np.ndarray, cfg: EngineConfig) -> np.ndarray | None:
    nu = np.sqrt(v) if (v := float(mu @ x)) > 0 else np.nan
    return x / nu if np.isfinite(nu) and nu > cfg.denom_tol else None


def _ewm(state: State, active: np.ndarray, mu: np.ndarray, known: np.ndarray, cfg: EngineConfig) -> np.ndarray | None:
    a, c, w, k = state.pairs
    with np.errstate(all="ignore"):
        cov = np.where(np.outer(known, known) & (k >= cfg.corr), c / w - (a / w) * (a.T / w), np.nan)
        v = np.diag(cov)
        den = np.sqrt(np.outer(v, v))
        rho = np.where(den > cfg.min_corr_denom, np.clip(cov / den, -1, 1), np.nan)
    np.fill_diagonal(rho, np.where(np.isfinite(v), 1.0, np.nan))
    m = cfg.shrink * rho + (1 - cfg.shrink) * np.eye(len(mu))
    risk, _, valid, _ = K.risk_positions(m[np.ix_(active, active)][None], mu[active][None], cfg.denom_tol)
    return risk[0] if valid[0] else None


def _sliding(state: State, active: np.ndarray, mu: np.ndarray, cfg: EngineConfig) -> np.ndarray | None:
    x = np.nan_to_num(state.rows[:, active])
    k = min(cfg.covariance.n_factors, cfg.covariance.max_components or cfg.covariance.n_factors, *x.shape)
    model = K.FactorModel.from_returns(x, k)
    rhs = mu[active]
    try:
        # dividing by a clamped variance would leave Woodbury no digits
        found = model.solve(rhs, limit=np.inf) if model.idio.min() > 1e-6 else np.linalg.solve(model.covariance, rhs)
    except (SingularMatrixError, np.linalg.LinAlgError):
        return None
    return _guarded(found, rhs, cfg)
