"""Returns, volatility and volatility-adjusted returns of a long panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.ewm import ewm_std, ewm_sums

KEYS = ["universe", "asset"]


def _order():
    return Window.partitionBy(*KEYS).orderBy("row_idx")


def with_log_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("log_ret", F.ln("price") - F.ln(F.lag("price").over(_order())))


def with_pct_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("pct_ret", F.try_divide(F.col("price"), F.lag("price").over(_order())) - 1)


def clipped(ret: Column, std: Column, clip: float) -> Column:
    """``ret / std`` between ``-clip`` and ``clip``; over a zero deviation its sign times ``clip``, or null for no move."""
    ratio = F.greatest(F.least(F.try_divide(ret, std), F.lit(float(clip))), F.lit(-float(clip)))
    return F.when(ret.isNull() | std.isNull(), None).when((std == 0) & (ret != 0), F.signum(ret) * clip).when(std == 0, None).otherwise(ratio)


def with_vola(panel: DataFrame, cfg: EngineConfig) -> DataFrame:
    """``vola``: deviation of percentage returns once ``cfg.vola`` of them are known."""
    return ewm_std(with_pct_returns(panel), KEYS, F.col("pct_ret"), cfg.beta_vola, "vola", min_samples=cfg.vola)


def with_ret_adj(panel: DataFrame, cfg: EngineConfig) -> DataFrame:
    """``ret_adj``: log returns over their own deviation, clipped."""
    out = ewm_std(with_log_returns(panel), KEYS, F.col("log_ret"), cfg.beta_vola, "log_std")
    return out.withColumn("ret_adj", clipped(F.col("log_ret"), F.col("log_std"), cfg.clip))


def enriched(panel: DataFrame, cfg: EngineConfig, *, rows: int | None = None) -> DataFrame:
    """The panel with ``log_ret, pct_ret, log_std, vola, ret_adj``, all sums in one scan.

    Both kinds of returns are known on the same rows, so they share weights and counts. ``rows``: a
    bound on the timestamps of a universe, if known.
    """
    p = with_pct_returns(with_log_returns(panel))
    b = cfg.beta_vola
    seen = F.when(F.col("log_ret").isNotNull(), 1.0)
    lr = F.col("log_ret")
    pr = F.when(lr.isNotNull(), F.col("pct_ret"))  # a price of zero or less has no logarithm, and no part in either
    sums = {"_ls": (lr, b), "_lss": (lr * lr, b), "_ps": (pr, b), "_pss": (pr * pr, b), "_w": (seen, b), "_ww": (seen, b * b), "_n": (seen, 1.0)}
    p = ewm_sums(p, KEYS, sums, rows=rows)
    w, ww, n = F.col("_w"), F.col("_ww"), F.col("_n")

    def std(s: str, ss: str) -> Column:
        spread = F.greatest(F.try_divide(F.col(ss), w) - F.pow(F.try_divide(F.col(s), w), F.lit(2.0)), F.lit(0.0))
        return F.when(lr.isNull(), None).when(n <= 1, 0.0).otherwise(F.sqrt(F.try_divide(spread * w * w, w * w - ww)))

    p = p.withColumn("log_std", std("_ls", "_lss")).withColumn("vola", F.when(n >= cfg.vola, std("_ps", "_pss")))
    return p.withColumn("ret_adj", clipped(lr, F.col("log_std"), cfg.clip)).drop(*sums)


def active(price: Column) -> Column:
    return price.isNotNull()


def accumulators(panel: DataFrame, cfg: EngineConfig, value: str = "log_ret") -> DataFrame:
    """The last EWM sums of each asset: what a stream starts from."""
    b, x = cfg.beta_vola, F.col(value)
    seen = F.when(x.isNotNull(), 1.0)
    p = ewm_sums(with_pct_returns(with_log_returns(panel)), KEYS, {"s_x": (x, b), "s_x2": (x * x, b), "s_w": (seen, b), "s_w2": (seen, b * b), "count": (seen, 1.0)})
    return p.groupBy(*KEYS).agg(*[F.max_by(c, "row_idx").alias(c) for c in ("s_x", "s_x2", "s_w", "s_w2", "count")])
