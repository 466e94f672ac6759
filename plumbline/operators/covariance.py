"""Pairwise exponentially weighted covariance, correlation, shrinkage and sliding second moments.

Everything is kept per pair ``i <= j`` of asset numbers. A timestamp's cells are gathered once and
unfolded into pairs, so there is no self-join; nothing ever holds a whole history of matrices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.ewm import ewm_sums

ROW = ["universe", "ts", "row_idx"]
PAIR = ["universe", "i", "j"]


def pairs(enriched: DataFrame) -> DataFrame:
    """``universe, ts, row_idx, i, j, x, y`` of adjusted returns; ``x`` and ``y`` may be null."""
    cell = F.struct("asset_ord", "ret_adj")
    rows = enriched.groupBy(*ROW).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    left = rows.select(*ROW, "c", F.posexplode("c").alias("at", "l"))
    both = left.select(*ROW, "l", F.explode(F.slice("c", F.col("at") + 1, F.size("c"))).alias("r"))
    return both.select(*ROW, F.col("l.asset_ord").alias("i"), F.col("r.asset_ord").alias("j"), F.col("l.ret_adj").alias("x"), F.col("r.ret_adj").alias("y"))


def ewm_cov(enriched: DataFrame, cfg: EngineConfig, *, rows: int | None = None) -> DataFrame:
    """Biased covariance of the joint observations, null until ``cfg.corr`` of them and where either is missing."""
    b = cfg.beta_corr
    p = pairs(enriched)
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    sums = {"a": (F.when(both, F.col("x")), b), "b": (F.when(both, F.col("y")), b), "c": (F.when(both, F.col("x") * F.col("y")), b), "w": (F.when(both, 1.0), b), "k": (F.when(both, 1.0), 1.0)}
    p = ewm_sums(p, PAIR, sums, rows=rows)
    cov = F.try_divide("c", "w") - F.try_divide("a", "w") * F.try_divide("b", "w")
    return p.select(*ROW, "i", "j", F.when(both & (F.col("k") >= cfg.corr), cov).alias("cov"))


def rho(cov: Column, vi: Column, vj: Column, same: Column, least: float) -> Column:
    den = F.sqrt(vi * vj)
    bounded = F.greatest(F.least(F.try_divide(cov, den), F.lit(1.0)), F.lit(-1.0))
    return F.when(same, F.when(vi.isNotNull(), 1.0)).when((den > least) & cov.isNotNull(), bounded)


def correlation_rows(cov: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row per timestamp with ``pairs``: array of ``i, j, cov, rho``, by marginal variances."""
    rows = cov.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))).alias("p"))
    rows = rows.withColumn("v", F.map_from_entries(F.transform(F.filter("p", lambda x: x["i"] == x["j"]), lambda x: F.struct(x["i"], x["cov"]))))
    v = F.col("v")
    each = F.transform("p", lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), x["cov"].alias("cov"), rho(x["cov"], v[x["i"]], v[x["j"]], x["i"] == x["j"], cfg.min_corr_denom).alias("rho")))
    return rows.select(*ROW, each.alias("pairs"))


def unfold(rows: DataFrame) -> DataFrame:
    return rows.select(*ROW, F.explode("pairs").alias("p")).select(*ROW, "p.*")


def shrink2id(value: Column, same: Column, lamb: float | Column) -> Column:
    """``lamb * value + (1 - lamb) * identity``; a missing value stays missing."""
    lamb = lamb if isinstance(lamb, Column) else F.lit(float(lamb))
    return lamb * value + (F.lit(1.0) - lamb) * F.when(same, 1.0).otherwise(0.0)


def cor_tensor(rows: DataFrame, lamb: float = 1.0) -> DataFrame:
    """The whole symmetric matrix of each timestamp as one row-major array."""
    n = F.array_max(F.transform("pairs", lambda x: x["j"])) + 1
    by = F.map_from_entries(F.transform("pairs", lambda x: F.struct(x["i"] * n + x["j"], shrink2id(x["rho"], x["i"] == x["j"], lamb))))
    full = F.transform(F.sequence(F.lit(0), n * n - 1), lambda k: F.col("by")[F.least(F.floor(k / n), k % n) * n + F.greatest(F.floor(k / n), k % n)])
    return rows.withColumn("n", n.cast("int")).withColumn("by", by).select(*ROW, "n", full.alias("m"))


def window_gram(enriched: DataFrame, window: int) -> DataFrame:
    """Sums of ``x * y`` over the last ``window`` rows, missing as 0; null before the window is full."""
    w = Window.partitionBy(*PAIR).orderBy("row_idx").rowsBetween(-(window - 1), 0)
    product = F.coalesce("x", F.lit(0.0)) * F.coalesce("y", F.lit(0.0))
    p = pairs(enriched).withColumn("gram", F.when(F.col("row_idx") >= window - 1, F.sum(product).over(w)))
    return p.select(*ROW, "i", "j", "gram")


def factor_cov(loadings: DataFrame, idio: DataFrame) -> DataFrame:
    """``i, j, cov`` of ``loadings`` (i, l, b, f: factor variance) and ``idio`` (i, d)."""
    left = loadings.select("i", "l", (F.col("b") * F.col("f")).alias("bf"))
    right = loadings.select(F.col("i").alias("j"), "l", "b")
    common = left.join(right, "l").groupBy("i", "j").agg(F.sum(F.col("bf") * F.col("b")).alias("s"))
    return common.join(idio, "i").select("i", "j", (F.col("s") + F.when(F.col("i") == F.col("j"), F.col("d")).otherwise(0.0)).alias("cov"))
