"""Exponentially weighted sums as a rebased block scan: window expressions only.

``S_t = beta * S_{t-1} + x_t`` over rows numbered ``row_idx`` without gaps. A series is cut into
blocks short enough that ``beta**-block`` stays far from overflow. Inside a block a running sum of
``x * beta**-offset`` gives the local part; the ends of earlier blocks, one row each, are folded into
what a block inherits. So a single long series is worked on by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks keep ``beta**-offset`` below exp(100).
_RANGE = 100.0


def block_length(beta: float) -> int:
    return max(1, int(_RANGE / -math.log(beta))) if 0 < beta < 1 else 1


def ewm_sums(df: DataFrame, keys: list[str], sums: dict[str, tuple[Column, float]], order: str = "row_idx", *, rows: int | None = None) -> DataFrame:
    """Adds a column ``name`` for each ``name: (value, beta)``; a null value counts as 0 and still ages.

    ``beta`` 0 keeps the value itself and 1 is a running sum. Every key must have a row for every
    number between its first and last. Where all numbers are known to be below ``rows`` and fit one
    block, nothing is inherited and the scan is a single window.
    """
    real = [b for _, b in sums.values() if 0 < b < 1]
    size = min(map(block_length, real), default=1 << 20)
    if rows is not None and rows <= size:
        return _one_block(df, keys, sums, order)
    out = df.withColumn("_blk", F.floor(F.col(order) / size)).withColumn("_off", F.pmod(F.col(order), F.lit(size)).cast("double"))
    w = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for name, (value, beta) in sums.items():
        x = F.coalesce(value.cast("double"), F.lit(0.0))
        if beta == 0:
            local[name] = x
        elif beta == 1:
            local[name] = F.sum(x).over(w)
        else:
            local[name] = F.pow(F.lit(beta), F.col("_off")) * F.sum(x * F.pow(F.lit(beta), -F.col("_off"))).over(w)
    out = out.withColumns(local)
    ends = out.where(F.col("_off") == size - 1).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_blk", *sums))).alias("_ends"))
    carry = ends.select(*keys, F.explode(_carries(sums, size)).alias("_c")).select(*keys, F.col("_c.blk").alias("_blk"), *[F.col(f"_c.{n}").alias(f"_c_{n}") for n in sums])
    out = out.join(carry, [*keys, "_blk"], "left")
    full = {n: F.col(n) + F.pow(F.lit(b), F.col("_off") + 1) * F.coalesce(f"_c_{n}", F.lit(0.0)) for n, (_, b) in sums.items() if b}
    return out.withColumns(full).drop("_blk", "_off", *[f"_c_{n}" for n in sums])


def _one_block(df: DataFrame, keys: list[str], sums: dict[str, tuple[Column, float]], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.col(order).cast("double")
    full = {}
    for name, (value, beta) in sums.items():
        x = F.coalesce(value.cast("double"), F.lit(0.0))
        grown = x if beta in (0, 1) else x * F.pow(F.lit(beta), -at)
        full[name] = x if beta == 0 else F.sum(grown).over(w) * (F.lit(1.0) if beta == 1 else F.pow(F.lit(beta), at))
    return df.withColumns(full)


def _carries(sums: dict[str, tuple[Column, float]], size: int) -> Column:
    """From the ordered block ends: what each following block inherits."""
    start = F.struct(F.lit(-1).cast("long").alias("blk"), *[F.lit(0.0).alias(n) for n in sums])

    def step(acc: Column, end: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct((end["_blk"] + 1).alias("blk"), *[(end[n] + F.lit(b**size) * last[n]).alias(n) for n, (_, b) in sums.items()])))

    return F.slice(F.aggregate("_ends", F.array(start), step), 2, F.size("_ends"))


def ewm_std(df: DataFrame, keys: list[str], value: Column, beta: float, out: str, *, min_samples: int = 1) -> DataFrame:
    """Unbiased exponentially weighted standard deviation; missing values age and give null.

    A single observation gives 0.0; fewer than ``min_samples`` give null.
    """
    seen = F.when(value.isNotNull(), 1.0)
    sums = {"_s": (value, beta), "_ss": (value * value, beta), "_w": (seen, beta), "_ww": (seen, beta * beta), "_n": (seen, 1.0)}
    df = ewm_sums(df, keys, sums)
    return df.withColumn(out, F.when(value.isNotNull() & (F.col("_n") >= min_samples), _std("_s", "_ss", "_w", "_ww", "_n"))).drop(*sums)


def _std(s: str, ss: str, w: str, ww: str, n: str) -> Column:
    s, ss, w, ww, n = map(F.col, (s, ss, w, ww, n))
    mean = F.try_divide(s, w)
    spread = F.greatest(F.try_divide(ss, w) - mean * mean, F.lit(0.0))
    return F.when(n <= 1, 0.0).otherwise(F.sqrt(F.try_divide(spread * w * w, w * w - ww)))
