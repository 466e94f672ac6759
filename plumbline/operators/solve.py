"""Positions: one Arrow kernel for both covariance modes, everything around it native."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig, SlidingWindow
from ..functions import kernel as K
from .covariance import ROW, correlation_rows, ewm_cov, shrink2id, window_gram


#: Why a row is degenerate.
NO_PRICE, UNKNOWN_MATRIX, SINGULAR, DENOMINATOR = "no_price", "unknown_matrix", "singular_matrix", "denominator"


def cells(enriched: DataFrame) -> DataFrame:
    """One row per timestamp: what the solver needs of each asset, in asset order."""
    mu = F.coalesce("mu", F.lit(0.0))
    cell = F.struct("asset_ord", F.col("price").isNotNull().alias("active"), mu.alias("mu"), "vola")
    rows = enriched.groupBy(*ROW).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    on = F.filter("c", lambda x: x["active"])
    return rows.select(
        *ROW, F.col("c.asset_ord").alias("ords"), F.col("c.active").alias("active"), F.col("c.mu").alias("mu"), F.col("c.vola").alias("vola"),
        F.when(F.size(on) == 0, K.DEGENERATE).when(F.forall(on, lambda x: F.abs(x["mu"]) <= K.ZERO_SIGNAL), K.ZERO).alias("early"),
    )


def matrices(enriched: DataFrame, cfg: EngineConfig, *, lamb: float | None = None, rows: int | None = None) -> DataFrame:
    """One row per timestamp with ``pi, pj, pv``: the pairs of its matrix (shrunk, or second moments)."""
    if isinstance(cfg.covariance, SlidingWindow):
        gram = window_gram(enriched, cfg.covariance.window)
        out = gram.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("i", "j", F.col("gram").alias("v")))).alias("p"))
    else:
        lamb = cfg.shrink if lamb is None else lamb
        out = correlation_rows(ewm_cov(enriched, cfg, rows=rows), cfg)
        out = out.select(*ROW, F.transform("pairs", lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), shrink2id(x["rho"], x["i"] == x["j"], lamb).alias("v"))).alias("p"))
    return out.select(*ROW, F.col("p.i").alias("pi"), F.col("p.j").alias("pj"), F.col("p.v").alias("pv"))


def _full(row, n: int) -> np.ndarray:
    m = np.full((n, n), np.nan)
    i, j, v = (np.asarray(x) for x in (row.pi, row.pj, np.asarray(row.pv, float)))
    m[i.astype(int), j.astype(int)] = v
    m[j.astype(int), i.astype(int)] = v
    return m


def active_matrix(row, mask: np.ndarray, cfg: EngineConfig) -> np.ndarray | None:
    """The matrix of the active assets; None before a sliding window is full or where no fit exists."""
    part = _full(row, len(mask))[np.ix_(mask, mask)]
    if not isinstance(cfg.covariance, SlidingWindow):
        return part
    w = cfg.covariance.window
    if row.row_idx + 1 < w or not mask.any() or not np.isfinite(part).all():
        return None
    return K.FactorModel.from_gram(part / w, min(cfg.covariance.n_factors, w, len(part))).covariance


def _solver(cfg: EngineConfig, diagnostics: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {k: [] for k in ("status", "reason", "risk", "cond", "erank", "residual", "util")}
            masks = [np.asarray(a, bool) for a in pdf.active]
            mus = [np.asarray(m, float) for m in pdf.mu]
            rows = list(pdf.itertuples(index=False))
            mats = [active_matrix(r, m, cfg) if m.any() else None for r, m in zip(rows, masks, strict=True)]
            sliding = isinstance(cfg.covariance, SlidingWindow)
            status: list[str] = [""] * len(rows)
            reason: list[str | None] = [None] * len(rows)
            risk = [np.where(m, 0.0, np.nan) for m in masks]
            groups: dict[bytes, list[int]] = {}
            for k, r in enumerate(rows):
                if masks[k].any() and sliding and r.row_idx + 1 < cfg.covariance.window:
                    status[k] = K.WARMUP
                    risk[k] = np.full(len(masks[k]), np.nan)
                elif isinstance(r.early, str):
                    status[k], reason[k] = r.early, NO_PRICE if r.early == K.DEGENERATE else None
                elif mats[k] is None or not np.isfinite(mats[k]).all():
                    status[k], reason[k] = K.DEGENERATE, UNKNOWN_MATRIX
                else:
                    groups.setdefault(masks[k].tobytes(), []).append(k)
            for members in groups.values():
                mask = masks[members[0]]
                x, _, valid, raw = K.risk_positions(np.array([mats[k] for k in members]), np.array([mus[k][mask] for k in members]), cfg.denom_tol)
                for k, pos, ok, found in zip(members, x, valid, raw, strict=True):
                    risk[k][mask] = pos
                    status[k] = K.VALID if ok else K.DEGENERATE
                    reason[k] = None if ok else DENOMINATOR if np.isfinite(found).all() else SINGULAR
            for k, r in enumerate(rows):
                out["status"].append(status[k])
                out["reason"].append(reason[k])
                out["risk"].append(risk[k])
                m, mu = mats[k], mus[k][masks[k]]
                known = diagnostics and m is not None
                out["cond"].append(K.condition_number(m) if known else np.nan)
                out["erank"].append(K.effective_rank(m) if known else np.nan)
                out["residual"].append(K.residual(m, mu) if known else np.nan)
                util = np.full(len(masks[k]), np.nan)
                if known:
                    util[masks[k]] = K.utilisation(m, mu)
                out["util"].append(util)
            yield pdf[["universe", "ts", "row_idx", "ords", "vola"]].assign(**out)

    return run


def run_solver(rows: DataFrame, cfg: EngineConfig, *, diagnostics: bool = False) -> DataFrame:
    """Solves joined rows of :func:`cells` and :func:`matrices`."""
    types = dict(rows.dtypes)
    schema = f"universe string, ts {types['ts']}, row_idx int, ords array<int>, vola array<double>, status string, reason string, risk array<double>, cond double, erank double, residual double, util array<double>"
    out = rows.withColumn("row_idx", F.col("row_idx").cast("int")).mapInPandas(_solver(cfg, diagnostics), schema)
    return out if diagnostics else out.drop("cond", "erank", "residual", "util")


def solved(enriched: DataFrame, cfg: EngineConfig, *, diagnostics: bool = False, lamb: float | None = None, rows: int | None = None) -> DataFrame:
    """One row per timestamp: ``status, reason, ords, risk, vola`` (why a row is degenerate) and, with ``diagnostics``, ``cond, erank, residual, util``."""
    return run_solver(cells(enriched).join(matrices(enriched, cfg, lamb=lamb, rows=rows), ROW), cfg, diagnostics=diagnostics)


def positions(solution: DataFrame) -> DataFrame:
    """Long: ``universe, ts, row_idx, asset_ord, status, risk, cash``; cash is risk over volatility, null where that is unknown."""
    flat = solution.select(*ROW, "status", F.explode(F.arrays_zip("ords", "risk", "vola")).alias("z"))
    risk = F.nanvl(F.col("z.risk"), F.lit(None).cast("double"))
    return flat.select(*ROW, F.col("z.ords").alias("asset_ord"), "status", risk.alias("risk"), F.try_divide(risk, F.nanvl(F.col("z.vola"), F.lit(None).cast("double"))).alias("cash"))


def _fold(most: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        previous, out = None, []
        for r in pdf.itertuples(index=False):
            cash = np.asarray(r.cash, float)
            if r.status != K.WARMUP:
                cash = K.cap_turnover(cash, np.zeros(len(cash)) if previous is None else previous, most)
            previous = cash
            out.append(cash)
        return pdf.assign(cash=out)

    return run


def capped(long_positions: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Cash after the turnover cap: a recurrence over rows, so one ordered pass per universe."""
    if cfg.max_turnover is None:
        return long_positions
    rows = long_positions.groupBy(*ROW, "status").agg(F.array_sort(F.collect_list(F.struct("asset_ord", "cash"))).alias("c")).select(*ROW, "status", F.col("c.asset_ord").alias("ords"), F.col("c.cash").alias("cash"))
    out = rows.groupBy("universe").applyInPandas(_fold(cfg.max_turnover), rows.schema)
    flat = out.select(*ROW, "status", F.explode(F.arrays_zip("ords", "cash")).alias("z"))
    return flat.select(*ROW, F.col("z.ords").alias("asset_ord"), "status", F.nanvl(F.col("z.cash"), F.lit(None).cast("double")).alias("cash"))
