"""Statistics of a return series ``universe, ts, row_idx, returns``."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

R = F.col


def _annual(periods: int) -> Column:
    return F.sqrt(F.lit(float(periods)))


def sharpe_of(mean: Column, std: Column, periods: int) -> Column:
    """0 for a zero mean, null for a constant series."""
    return F.when(std > 0, _annual(periods) * mean / std)


def sharpe(days: DataFrame, periods: int = 252) -> DataFrame:
    return days.groupBy("universe").agg(sharpe_of(F.avg("returns"), F.stddev_samp("returns"), periods).alias("sharpe"))


def volatility(days: DataFrame, periods: int = 252) -> DataFrame:
    return days.groupBy("universe").agg((F.stddev_samp("returns") * _annual(periods)).alias("volatility"))


def value_at_risk(days: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Gaussian quantile of the returns."""
    z = NormalDist().inv_cdf(alpha)
    return days.groupBy("universe").agg((F.avg("returns") + F.lit(z) * F.stddev_samp("returns")).alias("value_at_risk"))


def _var(alpha: float) -> Column:
    whole = Window.partitionBy("universe")
    return F.avg("returns").over(whole) + F.lit(NormalDist().inv_cdf(alpha)) * F.stddev_samp("returns").over(whole)


def cvar(days: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean of the returns at or below the value at risk."""
    low = R("returns") <= R("_var")
    return days.withColumn("_var", _var(alpha)).groupBy("universe").agg(F.avg(F.when(low, R("returns"))).alias("cvar"), F.count_if(low).alias("n_tail"))


def _spells(with_drawdown: DataFrame) -> DataFrame:
    """Adds ``_under``, the rows below the high-water mark so far in the current spell."""
    under = R("drawdown") > 0
    so_far = lambda *keys: Window.partitionBy("universe", *keys).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    spell = F.sum(F.when(under, 0).otherwise(1)).over(so_far())
    return with_drawdown.withColumn("_spell", spell).withColumn("_under", F.sum(F.when(under, 1).otherwise(0)).over(so_far("_spell")))


def _drawdown_sums() -> list[Column]:
    return [F.max("drawdown").alias("max_drawdown"), F.avg("drawdown").alias("avg_drawdown"), F.max("_under").cast("long").alias("max_duration")]


def drawdown_stats(with_drawdown: DataFrame) -> DataFrame:
    """Largest and mean drawdown, and the longest run of rows below the high-water mark."""
    return _spells(with_drawdown).groupBy("universe").agg(*_drawdown_sums())


def _moment_sums() -> list[Column]:
    return [*[F.avg(F.pow("returns", F.lit(float(k)))).alias(f"m{k}") for k in (1, 2, 3, 4)], F.max("returns").alias("best"), F.min("returns").alias("worst")]


def _moment_values() -> list[Column]:
    v = R("m2") - R("m1") * R("m1")
    third = R("m3") - 3 * R("m1") * R("m2") + 2 * F.pow("m1", F.lit(3.0))
    fourth = R("m4") - 4 * R("m1") * R("m3") + 6 * R("m1") * R("m1") * R("m2") - 3 * F.pow("m1", F.lit(4.0))
    return [R("m1").alias("mean"), F.when(v > 0, third / F.pow(v, F.lit(1.5))).alias("skew"), F.when(v > 0, fourth / (v * v) - 3).alias("kurtosis"), R("best"), R("worst")]


def moments(days: DataFrame) -> DataFrame:
    """Mean, population skewness, excess kurtosis, best and worst."""
    return days.groupBy("universe").agg(*_moment_sums()).select("universe", *_moment_values())


def _months(days: DataFrame) -> DataFrame:
    """Adds ``_month``: the return of a month on its first row, null on the others."""
    own = Window.partitionBy("universe", F.date_trunc("month", "ts"))
    return days.withColumn("_month", F.when(F.row_number().over(own.orderBy("row_idx")) == 1, F.sum("returns").over(own)))


def _win_sums() -> list[Column]:
    up, down = R("returns") > 0, R("returns") < 0
    return [
        F.count_if(up).alias("wins"), F.count_if(down).alias("losses"), F.sum(F.when(up, R("returns"))).alias("gain"), F.sum(F.when(down, -R("returns"))).alias("loss"),
        F.avg(F.when(up, R("returns"))).alias("avg_win"), F.avg(F.when(down, R("returns"))).alias("avg_loss"),
        F.avg(F.when(R("_month") > 0, 1.0).when(R("_month") < 0, 0.0)).alias("monthly_win_rate"),
    ]


def _win_values() -> list[Column]:
    return [
        F.try_divide(R("wins"), R("wins") + R("losses")).alias("win_rate"), R("monthly_win_rate"), F.try_divide("gain", "loss").alias("profit_factor"),
        F.try_divide(R("avg_win"), -R("avg_loss")).alias("payoff_ratio"), R("avg_win"), R("avg_loss"),
    ]


def win_loss(days: DataFrame) -> DataFrame:
    """Win rate over the rows with a move, sums and means of both sides, and the share of winning months."""
    return _months(days).groupBy("universe").agg(*_win_sums()).select("universe", *_win_values())


def _calmar_values(mean: Column, total: Column, worst: Column, periods: int) -> list[Column]:
    return [F.try_divide(mean * periods, worst).alias("calmar"), F.try_divide(total, worst).alias("recovery_factor")]


def calmar(with_drawdown: DataFrame, periods: int = 252) -> DataFrame:
    """Annual mean return and total return, each over the largest drawdown."""
    a = with_drawdown.groupBy("universe").agg(F.avg("returns").alias("m"), F.sum("returns").alias("t"), F.max("drawdown").alias("d"))
    return a.select("universe", *_calmar_values(R("m"), R("t"), R("d"), periods))


def capture(days: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Mean return relative to a benchmark's (``universe, row_idx, bench``) on its up and on its down rows."""
    j = days.join(benchmark, ["universe", "row_idx"])
    side = lambda c: F.try_divide(F.avg(F.when(c, R("returns"))), F.avg(F.when(c, R("bench"))))
    return j.groupBy("universe").agg(side(R("bench") > 0).alias("up_capture"), side(R("bench") < 0).alias("down_capture"))


def worst_k(days: DataFrame, k: int) -> DataFrame:
    """The ``k`` worst rows of each universe, earliest first among equals."""
    w = Window.partitionBy("universe").orderBy("returns", "row_idx")
    return days.withColumn("place", F.row_number().over(w)).where(R("place") <= k).select("universe", "place", "ts", "returns")


def rolling(days: DataFrame, n: int, periods: int = 252) -> DataFrame:
    """Sharpe ratio and volatility over the last ``n`` rows, null before."""
    w = Window.partitionBy("universe").orderBy("row_idx").rowsBetween(-(n - 1), 0)
    mean, std = F.avg("returns").over(w), F.stddev_samp("returns").over(w)
    full = R("row_idx") >= n - 1
    # running variances leave rounding noise where a window is constant
    return days.select("universe", "ts", "row_idx", F.when(full & (std > 1e-12), _annual(periods) * mean / std).alias("rolling_sharpe"), F.when(full, std * _annual(periods)).alias("rolling_volatility"))


def annual_sharpe(days: DataFrame, periods: int = 252) -> DataFrame:
    return days.groupBy("universe", F.year("ts").alias("year")).agg(sharpe_of(F.avg("returns"), F.stddev_samp("returns"), periods).alias("sharpe"))


def asset_correlation(returns: DataFrame, value: str = "pct_ret") -> DataFrame:
    """Correlation of each pair of assets over the rows where both are known."""
    rows = returns.where(R(value).isNotNull()).groupBy("universe", "row_idx").agg(F.array_sort(F.collect_list(F.struct("asset", R(value).alias("v")))).alias("c"))
    left = rows.select("universe", "c", F.posexplode("c").alias("at", "l"))
    pairs = left.select("universe", "l", F.explode(F.slice("c", R("at") + 2, F.size("c"))).alias("r"))
    x, y = R("l.v"), R("r.v")
    corr = F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    return pairs.groupBy("universe", R("l.asset").alias("asset_i"), R("r.asset").alias("asset_j")).agg(corr.alias("corr"))


def summary(with_drawdown: DataFrame, periods: int = 252, alpha: float = 0.05) -> DataFrame:
    """One row per statistic, twenty-two for each universe, from one shuffle and one aggregate."""
    d = _months(_spells(with_drawdown)).withColumn("_var", _var(alpha))
    deviation = F.stddev_samp("returns")
    one = d.groupBy("universe").agg(
        F.sum("returns").alias("total_return"), F.count(F.lit(1)).alias("n_rows"), deviation.alias("deviation"), F.max("_var").alias("value_at_risk"),
        F.avg(F.when(R("returns") <= R("_var"), R("returns"))).alias("cvar"), *_drawdown_sums(), *_moment_sums(), *_win_sums(),
    )
    values = [
        R("total_return"), R("n_rows"), sharpe_of(R("m1"), R("deviation"), periods).alias("sharpe"), (R("deviation") * _annual(periods)).alias("volatility"), R("value_at_risk"), R("cvar"),
        R("max_drawdown"), R("avg_drawdown"), R("max_duration"), *_moment_values(), *_win_values(), *_calmar_values(R("m1"), R("total_return"), R("max_drawdown"), periods),
    ]
    named = one.select("universe", *values)
    names = named.columns[1:]
    return named.select("universe", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), R(n).cast("double").alias("value")) for n in names])).alias("m")).select("universe", "m.*")
