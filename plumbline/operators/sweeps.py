"""Sharpe ratios over grids of settings; what does not depend on the grid is computed once."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig, SlidingWindow
from ..sources.settle import settle
from . import pnl, solve, stats
from .returns import enriched


def _sharpes(base: DataFrame, solutions: list[tuple[dict, DataFrame]], cfg: EngineConfig, periods: int) -> DataFrame:
    parts = None
    for labels, solution in solutions:
        days = pnl.daily(pnl.book(base, solve.capped(solve.positions(solution), cfg), cfg.position_scale), cfg.aum)
        one = stats.sharpe(days, periods)
        for k, v in labels.items():
            one = one.withColumn(k, F.lit(v))
        parts = one if parts is None else parts.union(one)
    return parts


def sharpe_at_shrink(panel: DataFrame, cfg: EngineConfig, grid: list[float], periods: int = 252) -> DataFrame:
    """``universe, sharpe, shrink`` for each weight, in one plan: correlations are scanned once and meet the grid after."""
    base = enriched(panel, cfg)
    points = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(lam)).alias("lam")) for k, lam in enumerate(grid)]))
    named = F.concat_ws("\x1f", "universe", F.col("g.k").cast("string"))
    rows = solve.cells(base).join(solve.matrices(base, cfg, lamb=1.0), solve.ROW).withColumn("g", points).withColumn("universe", named)
    lam = F.col("g.lam")
    rows = rows.withColumn("pv", F.transform(F.arrays_zip("pi", "pj", "pv"), lambda z: lam * z["pv"] + F.when(z["pi"] == z["pj"], F.lit(1.0) - lam).otherwise(0.0)))
    book = panel.withColumn("g", points).withColumn("universe", named).drop("g")
    positions = solve.capped(solve.positions(solve.run_solver(rows.drop("g"), cfg)), cfg)
    out = stats.sharpe(pnl.daily(pnl.book(book, positions, cfg.position_scale), cfg.aum), periods)
    parts = F.split("universe", "\x1f")
    return out.select(F.element_at(parts, 1).alias("universe"), "sharpe", F.element_at(F.array(*[F.lit(float(x)) for x in grid]), F.element_at(parts, 2).cast("int") + 1).alias("shrink"))


def lambda_sweep(panel: DataFrame, cfg: EngineConfig, points: int = 21, periods: int = 252) -> DataFrame:
    """Evenly spaced weights from 0 to 1 and the current one."""
    return sharpe_at_shrink(panel, cfg, sorted({*(round(k / (points - 1), 10) for k in range(points)), float(cfg.shrink)}), periods)


def sharpe_at_window_factors(panel: DataFrame, cfg: EngineConfig, grid: list[tuple[int, int]], periods: int = 252) -> DataFrame:
    """``universe, sharpe, window, n_factors`` for each pair."""
    base = settle(enriched(panel, cfg))  # every point of the grid reads it
    out = []
    for w, k in grid:
        own = dataclasses.replace(cfg, covariance=SlidingWindow(w, k))
        out.append(({"window": w, "n_factors": k}, solve.solved(base, own)))
    return _sharpes(panel, out, cfg, periods)


def naive_sharpe(panel: DataFrame, cfg: EngineConfig, periods: int = 252) -> DataFrame:
    """The Sharpe ratio with every signal replaced by 1; shrinkage stays."""
    flat = panel.withColumn("mu", F.lit(1.0))
    return _sharpes(flat, [({}, solve.solved(enriched(flat, cfg), cfg))], cfg, periods)
