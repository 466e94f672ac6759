"""Price and signal panels: wide tables at the edge, one long table inside.

The long form is ``universe, ts, row_idx, asset, asset_ord, price, mu`` with a row for every timestamp
and asset of a universe; missing values are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig
from ..errors import ColumnMismatchError, DuplicateTimestampError, ExcessiveNullsError, MissingDateColumnError, MonotonicPricesError, NonPositivePricesError, ShapeMismatchError

KEYS = ("universe", "asset")


def finite(c: Column) -> Column:
    """The value as a double, null where it is NaN or infinite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def assets(frame: DataFrame, date_col: str = "date") -> list[str]:
    """The numeric columns besides the date, in their order."""
    return [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType) and f.name != date_col]


def to_long(prices: DataFrame, mu: DataFrame, *, date_col: str = "date", universe: str = "main", check: bool = True) -> DataFrame:
    """Joins wide ``prices`` and ``mu`` on the date and turns them into the long form.

    Both need the date column and the same set of columns. With ``check`` one job counts rows and
    rejects repeated dates; rows are ordered by date, which the position of a row cannot tell here.
    """
    for name, frame in (("prices", prices), ("mu", mu)):
        if date_col not in frame.columns:
            raise MissingDateColumnError(name, date_col)
    if set(prices.columns) != set(mu.columns):
        if len(prices.columns) != len(mu.columns):
            raise ShapeMismatchError((-1, len(prices.columns)), (-1, len(mu.columns)))
        raise ColumnMismatchError(set(prices.columns), set(mu.columns))
    names = assets(prices, date_col)
    if check:
        stats = [f.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(date_col).alias("d")) for f in (prices, mu)]
        (n, d), (m, _) = (tuple(s.first()) for s in stats)
        if n != m:
            raise ShapeMismatchError((n, len(prices.columns)), (m, len(mu.columns)))
        if n != d:
            raise DuplicateTimestampError(n - d)
    both = prices.select(F.col(date_col).alias("ts"), F.struct(*[F.col(a).cast("double").alias(a) for a in names]).alias("p")).join(
        mu.select(F.col(date_col).alias("ts"), F.struct(*[F.col(a).cast("double").alias(a) for a in names]).alias("m")), "ts"
    )
    cells = F.array(*[F.struct(F.lit(a).alias("asset"), F.lit(k).alias("asset_ord"), F.col("p")[a].alias("price"), F.col("m")[a].alias("mu")) for k, a in enumerate(names)])
    ranked = both.withColumn("universe", F.lit(universe)).withColumn("row_idx", F.row_number().over(Window.partitionBy("universe").orderBy("ts")) - 1)
    long = ranked.select("universe", "ts", "row_idx", F.explode(cells).alias("c")).select("universe", "ts", "row_idx", "c.*")
    return long.withColumn("price", finite(F.col("price"))).withColumn("mu", finite(F.col("mu")))


def complete(observed: DataFrame, *, universe: str = "main", names: list[str] | None = None) -> DataFrame:
    """The long form of sparse observations ``ts, asset, price``: every timestamp meets every asset.

    ``names`` fixes the assets and their order; otherwise the distinct ones are taken in order.
    A repeated timestamp and asset is an error that names the timestamp. Timestamps, not cells, are numbered, so the sequential step sees one row each. ``mu`` is null.
    """
    cells = observed.select("ts", F.struct("asset", "price").alias("c")).groupBy("ts").agg(F.collect_list("c").alias("cells"))
    twice = F.size(F.array_distinct(F.col("cells.asset"))) < F.size("cells")
    cells = cells.withColumn("cells", F.when(twice, F.raise_error(F.concat(F.lit("an asset has several prices at "), F.col("ts").cast("string")))).otherwise(F.col("cells")))
    spark = observed.sparkSession
    if names is None:
        found = observed.select("asset").distinct()
    else:
        found = spark.createDataFrame([(n,) for n in names], "asset string")
    order = F.broadcast(found.agg(F.array_sort(F.collect_list("asset")).alias("names")))  # one row: the asset names
    numbered = cells.withColumn("universe", F.lit(universe)).withColumn("row_idx", F.row_number().over(Window.partitionBy("universe").orderBy("ts")) - 1)
    spread = numbered.crossJoin(order).select("universe", "ts", "row_idx", F.map_from_entries("cells").alias("by"), F.posexplode("names").alias("asset_ord", "asset"))
    return spread.select("universe", "ts", "row_idx", "asset", "asset_ord", finite(F.try_element_at("by", F.col("asset"))).alias("price"), F.lit(None).cast("double").alias("mu"))


def with_momentum(panel: DataFrame, *, fast: int = 5, slow: int = 20, gain: float = 20.0) -> DataFrame:
    """A strictly causal signal: ``tanh(gain * (fast mean - slow mean) / price)``, 0 where unknown."""
    w = Window.partitionBy(*KEYS).orderBy("row_idx")
    mean = lambda n: F.avg("price").over(w.rowsBetween(-(n - 1), 0))
    return panel.withColumn("mu", F.coalesce(F.tanh(F.lit(gain) * (mean(fast) - mean(slow)) / F.col("price")), F.lit(0.0)))


def to_wide(long: DataFrame, value: str, names: list[str], date_col: str = "date") -> DataFrame:
    """One row per timestamp and a column per asset; the asset list is given, so no extra job runs."""
    return long.groupBy("ts").pivot("asset", names).agg(F.first(value)).withColumnRenamed("ts", date_col)


def validation_stats(panel: DataFrame) -> DataFrame:
    """Per asset: rows, missing share, least price, and whether prices ever change direction."""
    seen = panel.where("price IS NOT NULL")
    step = F.col("price") - F.lag("price").over(Window.partitionBy(*KEYS).orderBy("row_idx"))
    moves = seen.withColumn("step", step).groupBy(*KEYS).agg(
        F.min("price").alias("min_price"), ((F.count(F.lit(1)) > 2) & (F.bool_and(F.col("step") >= 0) | F.bool_and(F.col("step") <= 0))).alias("monotonic")
    )
    counts = panel.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("price").isNull()).alias("n_null"))
    out = counts.join(moves, list(KEYS), "left")
    return out.select(*KEYS, "n_rows", "n_null", (F.col("n_null") / F.col("n_rows")).alias("null_fraction"), "min_price", F.coalesce("monotonic", F.lit(False)).alias("monotonic"))


def validate(panel: DataFrame, cfg: EngineConfig) -> None:
    """Raises for the first asset that breaks a rule; one job, one row per asset back."""
    for r in validation_stats(panel).orderBy("universe", "asset").collect():
        if r.min_price is not None and r.min_price <= 0:
            raise NonPositivePricesError(r.asset)
        if r.n_rows and r.null_fraction > cfg.max_nan_fraction:
            raise ExcessiveNullsError(r.asset, r.null_fraction, cfg.max_nan_fraction)
        if r.monotonic:
            raise MonotonicPricesError(r.asset)
