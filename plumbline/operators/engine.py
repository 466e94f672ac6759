"""The engine: prices, signal and settings in; lazily planned tables out."""

from __future__ import annotations

import logging
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig, SlidingWindow
from ..sources import panel as P
from ..sources.settle import settle
from . import covariance, diagnostics, pnl, returns, signal_eval, solve, stats, sweeps

log = logging.getLogger("plumbline")


class Engine:
    """Positions, diagnostics, signal evaluation and P&L of one long panel.

    Tables are plans: nothing runs until they are used. :meth:`cache` keeps the solver's rows, which
    most properties share. With ``settled`` the panel with its returns, a row per timestamp and asset,
    is written to the shared folder when it is first needed, and so are daily profits: what is built on
    them reads a small table, and the number of timestamps is known.
    """

    def __init__(self, panel: DataFrame, cfg: EngineConfig, *, validate: bool = True, settled: bool = False):
        self.panel, self.cfg, self.settled = panel, cfg, settled
        if validate:
            P.validate(panel, cfg)
            if isinstance(cfg.covariance, SlidingWindow):
                rows = panel.agg((F.max("row_idx") + 1).alias("n")).first()["n"] or 0
                if rows < 2 * cfg.covariance.window:
                    log.warning("short_window", extra={"rows": rows, "window": cfg.covariance.window})

    @classmethod
    def from_wide(cls, prices: DataFrame, mu: DataFrame, cfg: EngineConfig, *, date_col: str = "date", universe: str = "main") -> Engine:
        return cls(P.to_long(prices, mu, date_col=date_col, universe=universe), cfg)

    @cached_property
    def enriched(self) -> DataFrame:
        made = returns.enriched(self.panel, self.cfg, rows=self.rows)
        return settle(made) if self.settled else made

    @cached_property
    def rows(self) -> int | None:
        """Timestamps of the longest universe, counted for a settled engine only."""
        return (self.panel.agg((F.max("row_idx") + 1).alias("n")).first()["n"] or 0) if self.settled else None

    @property
    def prices(self) -> DataFrame:
        """The panel's rows, from the settled table if there is one."""
        return self.enriched if self.settled else self.panel

    @cached_property
    def solution(self) -> DataFrame:
        return solve.solved(self.enriched, self.cfg, rows=self.rows)

    @cached_property
    def diagnosed(self) -> DataFrame:
        return solve.solved(self.enriched, self.cfg, diagnostics=True, rows=self.rows)

    def cache(self) -> Engine:
        self.solution = self.solution.persist()
        return self

    @property
    def ret_adj(self) -> DataFrame:
        return self.enriched.select(*covariance.ROW, "asset", "ret_adj")

    @property
    def vola(self) -> DataFrame:
        return self.enriched.select(*covariance.ROW, "asset", "vola")

    @cached_property
    def cor_rows(self) -> DataFrame:
        return covariance.correlation_rows(covariance.ewm_cov(self.enriched, self.cfg, rows=self.rows), self.cfg)

    @property
    def cor(self) -> DataFrame:
        return covariance.unfold(self.cor_rows)

    @property
    def cor_tensor(self) -> DataFrame:
        return covariance.cor_tensor(self.cor_rows)

    @cached_property
    def positions(self) -> DataFrame:
        return solve.positions(self.solution)

    @property
    def cash_position(self) -> DataFrame:
        return solve.capped(self.positions, self.cfg)

    @property
    def position_status(self) -> DataFrame:
        return self.solution.select(*covariance.ROW, "status")

    @property
    def risk_position(self) -> DataFrame:
        v = self.enriched.select(*covariance.ROW, "asset_ord", "vola")
        return self.cash_position.join(v, [*covariance.ROW, "asset_ord"]).select(*covariance.ROW, "asset_ord", (F.col("cash") * F.col("vola")).alias("risk"))

    @property
    def position_leverage(self) -> DataFrame:
        return self.cash_position.groupBy(*covariance.ROW).agg(F.coalesce(F.sum(F.abs("cash")), F.lit(0.0)).alias("leverage"))

    @property
    def warmup_state(self) -> DataFrame:
        """The last row's cash of each asset."""
        return self.cash_position.groupBy("universe", "asset_ord").agg(F.max_by("cash", "row_idx").alias("cash"))

    def condition_number(self) -> DataFrame:
        return diagnostics.condition_number(self.diagnosed)

    def effective_rank(self) -> DataFrame:
        return diagnostics.effective_rank(self.diagnosed)

    def solver_residual(self) -> DataFrame:
        return diagnostics.solver_residual(self.diagnosed)

    def signal_utilisation(self) -> DataFrame:
        return diagnostics.signal_utilisation(self.diagnosed)

    def warnings(self, limit: float = 1e12) -> DataFrame:
        """Degenerate rows with their reason, and rows whose matrix has a condition number above ``limit``."""
        return diagnostics.warnings(self.diagnosed, limit)

    def save_cor_tensor(self, path: str) -> None:
        """Writes the correlation matrices as Parquet: a row per timestamp with the size and the row-major cells."""
        self.cor_tensor.write.parquet(path)

    def ic(self, h: int = 1) -> DataFrame:
        return signal_eval.ic(self.panel, h)

    def rank_ic(self, h: int = 1) -> DataFrame:
        return signal_eval.ic(self.panel, h, rank=True)

    def ic_summary(self, h: int = 1) -> DataFrame:
        return signal_eval.ic_summary(self.ic(h))

    def rank_ic_summary(self, h: int = 1) -> DataFrame:
        return signal_eval.ic_summary(self.rank_ic(h), "rank_ic")

    @cached_property
    def book(self) -> DataFrame:
        """Prices with cash positions times ``position_scale``: what the portfolio holds."""
        return pnl.book(self.prices, self.cash_position, self.cfg.position_scale)

    @cached_property
    def daily(self) -> DataFrame:
        days = pnl.daily(self.book, self.cfg.aum)
        return settle(days) if self.settled else days

    def all_view(self) -> DataFrame:
        return pnl.all_view(self.daily, self.cfg.aum)

    def summary(self) -> DataFrame:
        return stats.summary(pnl.drawdown(self.daily, self.cfg.aum))

    def sharpe_at_shrink(self, grid: list[float]) -> DataFrame:
        return sweeps.sharpe_at_shrink(self.panel, self.cfg, grid)

    def sharpe_at_window_factors(self, grid: list[tuple[int, int]]) -> DataFrame:
        return sweeps.sharpe_at_window_factors(self.panel, self.cfg, grid)

    def naive_sharpe(self) -> DataFrame:
        return sweeps.naive_sharpe(self.panel, self.cfg)
