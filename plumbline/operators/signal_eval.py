"""Information coefficients: cross-sectional correlation of a signal with forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = ["universe", "ts", "row_idx"]


def forward_returns(panel: DataFrame, h: int = 1) -> DataFrame:
    """Adds ``fwd``, the return over the next ``h`` rows; the last ``h`` rows of a universe are left out."""
    if h < 1:
        raise ValueError("h must be at least 1")
    w = Window.partitionBy("universe", "asset").orderBy("row_idx")
    out = panel.withColumn("fwd", F.try_divide(F.lead("price", h).over(w), F.col("price")) - 1).withColumn("_ahead", F.lead("row_idx", h).over(w))
    return out.where(F.col("_ahead").isNotNull()).drop("_ahead")


def _corr(x: Column, y: Column) -> Column:
    n = F.count(x)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((n >= 2) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), spread))


def ic(panel: DataFrame, h: int = 1, *, rank: bool = False) -> DataFrame:
    """``ic`` per timestamp, null with fewer than two pairs or a constant side; Spearman with ``rank``."""
    rows = forward_returns(panel, h)
    ok = F.col("mu").isNotNull() & F.col("fwd").isNotNull()
    rows = rows.select(*ROW, F.when(ok, F.col("mu")).alias("x"), F.when(ok, F.col("fwd")).alias("y"))
    if rank:
        by = Window.partitionBy(*ROW, F.col("x").isNull())

        def mid(c: str) -> Column:
            ties = F.count(F.lit(1)).over(Window.partitionBy(*ROW, F.col("x").isNull(), c))
            return F.when(F.col(c).isNotNull(), F.rank().over(by.orderBy(c)).cast("double") + (ties - 1) / F.lit(2.0))

        rows = rows.select(*ROW, mid("x").alias("x"), mid("y").alias("y"))
    return rows.groupBy(*ROW).agg(_corr(F.col("x"), F.col("y")).alias("ic"))


def ic_summary(series: DataFrame, prefix: str = "ic") -> DataFrame:
    """Mean, deviation and their ratio over the known values of each universe."""
    mean, std = F.avg("ic"), F.stddev_samp("ic")
    return series.groupBy("universe").agg(mean.alias(f"{prefix}_mean"), std.alias(f"{prefix}_std"), F.when(std > 0, F.try_divide(mean, std)).alias(f"{prefix}ir"), F.count("ic").alias("n"))
