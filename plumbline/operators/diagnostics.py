"""Per-timestamp health of matrices and solutions, read from the solver's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernel import CONDITION_LIMIT
from .covariance import ROW


def _number(name: str):
    return F.nanvl(F.col(name), F.lit(None).cast("double"))


def condition_number(solution: DataFrame) -> DataFrame:
    return solution.select(*ROW, _number("cond").alias("condition_number"))


def effective_rank(solution: DataFrame) -> DataFrame:
    return solution.select(*ROW, _number("erank").alias("effective_rank"))


def solver_residual(solution: DataFrame) -> DataFrame:
    return solution.select(*ROW, _number("residual").alias("residual"))


def signal_utilisation(solution: DataFrame) -> DataFrame:
    flat = solution.select(*ROW, F.explode(F.arrays_zip("ords", "util")).alias("z"))
    return flat.select(*ROW, F.col("z.ords").alias("asset_ord"), F.nanvl(F.col("z.util"), F.lit(None).cast("double")).alias("utilisation"))


def warnings(solution: DataFrame, limit: float = CONDITION_LIMIT) -> DataFrame:
    """One row per finding: ``warning`` (why a row is degenerate, or ``ill_conditioned``) and the condition number, if known."""
    cond = _number("cond")
    each = F.array_compact(F.array(F.col("reason"), F.when(cond > limit, F.lit("ill_conditioned"))))
    return solution.select(*ROW, cond.alias("condition_number"), F.explode(each).alias("warning"))


def status_counts(solution: DataFrame) -> DataFrame:
    return solution.groupBy("universe", "status").agg(F.count(F.lit(1)).alias("n"))
