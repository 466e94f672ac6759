"""Profit and loss of cash positions: profits, net asset values, drawdown, turnover, costs, attribution.

``book`` tables have ``universe, ts, row_idx, asset, asset_ord, price, cash``; ``daily`` tables have
``universe, ts, row_idx, profit, returns``. Missing cash counts as no position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW = ["universe", "ts", "row_idx"]


def _asset():
    return Window.partitionBy("universe", "asset_ord").orderBy("row_idx")


def _upto():
    return Window.partitionBy("universe").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)


def book(panel: DataFrame, long_positions: DataFrame, scale: float = 1.0) -> DataFrame:
    """Joins prices with (scaled) cash positions."""
    cash = long_positions.select(*ROW, "asset_ord", (F.col("cash") * scale).alias("cash"))
    return panel.select(*ROW, "asset", "asset_ord", "price").join(cash, [*ROW, "asset_ord"], "left")


def profits(positions: DataFrame, weight: str = "cash") -> DataFrame:
    """Per asset: the position before, times the return since."""
    ret = F.try_divide(F.col("price"), F.lag("price").over(_asset())) - 1
    return positions.withColumn("profit", F.coalesce(F.lag(weight).over(_asset()) * ret, F.lit(0.0)))


def daily(positions: DataFrame, aum: float, weight: str = "cash") -> DataFrame:
    total = profits(positions, weight).groupBy(*ROW).agg(F.sum("profit").alias("profit"))
    return total.withColumn("returns", F.col("profit") / F.lit(float(aum)))


def nav_accumulated(days: DataFrame, aum: float) -> DataFrame:
    return days.withColumn("NAV_accumulated", F.lit(float(aum)) + F.sum("profit").over(_upto()))


def nav_compounded(days: DataFrame, aum: float) -> DataFrame:
    """Product of ``1 + returns``: logarithms of sizes, signs and zeros apart, so losses beyond all are right too."""
    g = F.lit(1.0) + F.col("returns")
    size = F.exp(F.sum(F.when(g != 0, F.ln(F.abs(g))).otherwise(0.0)).over(_upto()))
    sign = F.when(F.sum(F.when(g < 0, 1).otherwise(0)).over(_upto()) % 2 == 1, -1.0).otherwise(1.0)
    gone = F.max(F.when(g == 0, 1).otherwise(0)).over(_upto()) == 1
    return days.withColumn("NAV_compounded", F.when(gone, 0.0).otherwise(F.lit(float(aum)) * sign * size))


def drawdown(days: DataFrame, aum: float) -> DataFrame:
    """High-water mark and the share lost since, never negative."""
    nav = nav_accumulated(days, aum).withColumn("highwater", F.max("NAV_accumulated").over(_upto()))
    return nav.withColumn("drawdown", F.try_divide(F.col("highwater") - F.col("NAV_accumulated"), F.col("highwater")))


def all_view(days: DataFrame, aum: float) -> DataFrame:
    return nav_compounded(drawdown(days, aum), aum)


def tilt_timing(positions: DataFrame, aum: float) -> DataFrame:
    """Profit of the mean position of each asset (tilt) and of the deviation from it (timing)."""
    mean = F.avg("cash").over(Window.partitionBy("universe", "asset_ord"))
    parts = positions.withColumn("flat", F.when(F.col("cash").isNotNull(), mean)).withColumn("moved", F.col("cash") - F.col("flat"))
    ret = F.try_divide(F.col("price"), F.lag("price").over(_asset())) - 1
    each = [F.coalesce(F.lag(c).over(_asset()) * ret, F.lit(0.0)).alias(n) for c, n in (("cash", "portfolio"), ("flat", "tilt"), ("moved", "timing"))]
    daily_parts = parts.select(*ROW, *each).groupBy(*ROW).agg(*[F.sum(n).alias(n) for n in ("portfolio", "tilt", "timing")])
    return daily_parts.select(*ROW, *[(F.lit(float(aum)) + F.sum(n).over(_upto())).alias(n) for n in ("portfolio", "tilt", "timing")])


def _moved(positions: DataFrame) -> DataFrame:
    step = F.abs(F.coalesce("cash", F.lit(0.0)) - F.coalesce(F.lag("cash").over(_asset()), F.lit(0.0)))
    return positions.withColumn("step", F.when(F.col("row_idx") == 0, 0.0).otherwise(step)).groupBy(*ROW).agg(F.sum("step").alias("traded"))


def turnover(positions: DataFrame, aum: float) -> DataFrame:
    """Cash traded on each row as a share of the assets under management."""
    return _moved(positions).select(*ROW, (F.col("traded") / F.lit(float(aum))).alias("turnover"))


def turnover_weekly(daily_turnover: DataFrame) -> DataFrame:
    return daily_turnover.groupBy("universe", F.date_trunc("week", "ts").alias("week")).agg(F.sum("turnover").alias("turnover"))


def turnover_summary(daily_turnover: DataFrame) -> DataFrame:
    """Three rows: mean of a row, mean of a week, deviation of a row."""
    d = daily_turnover.groupBy("universe").agg(F.avg("turnover").alias("mean_daily_turnover"), F.stddev_samp("turnover").alias("turnover_std"))
    w = turnover_weekly(daily_turnover).groupBy("universe").agg(F.avg("turnover").alias("mean_weekly_turnover"))
    names = ("mean_daily_turnover", "mean_weekly_turnover", "turnover_std")
    return d.join(w, "universe").select("universe", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("universe", "m.*")


def net_cost_nav(positions: DataFrame, aum: float, cost_per_unit: float) -> DataFrame:
    """Costs of each row and the net asset value after all of them."""
    days = nav_accumulated(daily(positions, aum), aum)
    out = days.join(_moved(positions).select(*ROW, (F.col("traded") * cost_per_unit).alias("cost")), ROW)
    return out.select(*ROW, "profit", "cost", (F.col("NAV_accumulated") - F.sum("cost").over(_upto())).alias("NAV_accumulated_net"))


def cost_adjusted_returns(positions: DataFrame, aum: float, cost_bps: float) -> DataFrame:
    days = daily(positions, aum).join(turnover(positions, aum), ROW)
    return days.select(*ROW, (F.col("returns") - F.col("turnover") * cost_bps / 1e4).alias("returns"))


def trading_cost_impact(positions: DataFrame, aum: float, max_bps: int, periods: int = 252) -> DataFrame:
    """Sharpe ratio at each cost from 0 to ``max_bps`` basis points: ``max_bps + 1`` rows per universe.

    Moments of returns and turnover give every cost at once, so the grid multiplies three numbers only.
    """
    r, t = F.col("returns"), F.col("turnover")
    m = daily(positions, aum).join(turnover(positions, aum), ROW).groupBy("universe").agg(
        F.avg(r).alias("mr"), F.avg(t).alias("mt"), F.var_samp(r).alias("vr"), F.var_samp(t).alias("vt"), F.covar_samp(r, t).alias("crt")
    )
    grid = m.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_bps).cast("long"))).alias("cost_bps")).withColumn("b", F.col("cost_bps") / 1e4)
    mean = F.col("mr") - F.col("b") * F.col("mt")
    var = F.col("vr") - 2 * F.col("b") * F.col("crt") + F.col("b") * F.col("b") * F.col("vt")
    return grid.select("universe", "cost_bps", F.when(var > 0, F.sqrt(F.lit(float(periods))) * mean / F.sqrt(var)).alias("sharpe"))


def monthly(days: DataFrame, aum: float) -> DataFrame:
    nav = nav_accumulated(days, aum)
    return nav.groupBy("universe", F.year("ts").alias("year"), F.month("ts").alias("month"), F.date_format("ts", "MMM").alias("month_name")).agg(
        F.sum("returns").alias("returns"), F.sum("profit").alias("profit"), F.max_by("NAV_accumulated", "row_idx").alias("NAV_accumulated")
    )


def truncate(frame: DataFrame, start=None, end=None) -> DataFrame:
    """Rows between two timestamps, both included."""
    if start is not None:
        frame = frame.where(F.col("ts") >= F.lit(start))
    return frame.where(F.col("ts") <= F.lit(end)) if end is not None else frame


def lagged(positions: DataFrame, k: int) -> DataFrame:
    """Positions held ``k`` rows later (earlier for a negative ``k``)."""
    return positions.withColumn("cash", F.lag("cash", k).over(_asset()) if k >= 0 else F.lead("cash", -k).over(_asset()))


def smoothed_holding(positions: DataFrame, n: int) -> DataFrame:
    return positions.withColumn("cash", F.avg("cash").over(_asset().rowsBetween(-(n - 1), 0)))


def lead_lag_sharpe(positions: DataFrame, aum: float, lags: range, periods: int = 252) -> DataFrame:
    """Sharpe ratio of the positions shifted by each lag; all lags in one pass over the book."""
    ret = F.try_divide(F.col("price"), F.lag("price").over(_asset())) - 1
    shift = lambda k: F.lag("cash", k + 1).over(_asset()) if k >= 0 else F.lead("cash", -k - 1).over(_asset())
    rows = positions.select(*ROW, *[F.coalesce((F.col("cash") if k == -1 else shift(k)) * ret, F.lit(0.0)).alias(f"p{k}") for k in lags])
    days = rows.groupBy(*ROW).agg(*[(F.sum(f"p{k}") / aum).alias(f"p{k}") for k in lags])
    stats = days.groupBy("universe").agg(*[F.struct(F.avg(f"p{k}").alias("m"), F.stddev_samp(f"p{k}").alias("s")).alias(f"p{k}") for k in lags])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col(f"p{k}.s") > 0, F.sqrt(F.lit(float(periods))) * F.col(f"p{k}.m") / F.col(f"p{k}.s")).alias("sharpe")) for k in lags]))
    return stats.select("universe", each.alias("e")).select("universe", "e.*")
