"""Registered queries of the panel engine and the SQL they are held against.

Values are rounded on both sides, since engines add in different orders; null stands for a missing
number. Panels are described in :mod:`plumbline.plans.panels`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig, SlidingWindow
from ..functions import ewm
from ..operators import covariance, pnl, returns, signal_eval, solve, stats, sweeps
from ..operators.engine import Engine
from ..sources import panel as P
from ..sources.settle import shared_root
from . import oracles as O
from .panels import SOURCES, panel

CFG = EngineConfig(vola=16, corr=32, clip=3.0, shrink=0.5, aum=1e8, cost_per_unit=0.0005)
WINDOW = EngineConfig(vola=16, corr=32, clip=3.0, shrink=0.5, aum=1e8, covariance=SlidingWindow(60, 1))
CAPPED = CFG.replace(max_turnover=20.0)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Rounds every double; ``own`` gives the digits of single columns."""
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c != "universe"])


def engine(spark: SparkSession, sf_dir: str, name: str, cfg: EngineConfig = CFG) -> Engine:
    return Engine(panel(spark, sf_dir, name), cfg, validate=False, settled=True)


def rnd(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]}, {digits}) AS {c.split(' AS ')[-1]}" for c in cols)


KEY = ("ts", "row_idx", "asset")
R6, V3, C3 = O.returns_sql(CFG), O.returns_sql(CFG), O.cov_sql(CFG)
SOL3 = (O.returns_sql(CFG), O.cov_sql(CFG), O.solve3_sql(CFG), O.positions_sql(3))
BOOK3 = (*SOL3, O.book_sql(CFG))
MAT2 = f"mat AS (SELECT row_idx, max(CASE WHEN i = 0 AND j = 0 THEN rho END) AS d0, max(CASE WHEN i = 1 AND j = 1 THEN rho END) AS d1, {CFG.shrink} * max(CASE WHEN i = 0 AND j = 1 THEN rho END) AS c FROM cor GROUP BY 1)"
SOL2 = (O.returns_sql(CFG), O.cov_sql(CFG), O.solve2_sql(CFG, MAT2))
# two assets, one factor: the leading eigenpair of the second moments in closed form
EIG2 = f"""g AS (SELECT row_idx, max(CASE WHEN i = 0 AND j = 0 THEN gram END) / 60 AS a, max(CASE WHEN i = 1 AND j = 1 THEN gram END) / 60 AS b, max(CASE WHEN i = 0 AND j = 1 THEN gram END) / 60 AS c FROM gram GROUP BY 1),
        e AS (SELECT *, (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS l FROM g),
        v AS (SELECT *, CASE WHEN c = 0 THEN CASE WHEN a >= b THEN 1.0 ELSE 0.0 END ELSE c * c / (c * c + (l - a) * (l - a)) END AS v00,
                     CASE WHEN c = 0 THEN 0.0 ELSE c * (l - a) / (c * c + (l - a) * (l - a)) END AS v01 FROM e),
        mat AS (SELECT row_idx, l * v00 + greatest(1 - l * v00, 2.220446049250313e-16) AS d0, l * (1 - v00) + greatest(1 - l * (1 - v00), 2.220446049250313e-16) AS d1, l * v01 AS c FROM v)"""
SW2 = (O.returns_sql(WINDOW), O.gram_sql(60), O.solve2_sql(WINDOW, EIG2))
SW2_STATUS = "solw AS (SELECT * REPLACE (CASE WHEN row_idx + 1 < 60 THEN 'warmup' ELSE status END AS status) FROM sol)"


# ---- sources, projections, predicates ----------------------------------------------------------


@query("panel_long", O.flow("p6", out=f"SELECT ts, row_idx, asset, asset_ord, price, {rnd('mu')} FROM panel"))
def panel_long(spark, sf):
    return rounded(panel(spark, sf, "p6").select(*KEY, "asset_ord", "price", "mu"), price=9)


@query("assets", O.flow("p6", out="SELECT DISTINCT asset, asset_ord FROM panel"))
def asset_list(spark, sf):
    return panel(spark, sf, "p6").select("asset", "asset_ord").distinct()


@query("wide_round_trip", O.flow("p3", out="SELECT ts, asset, price FROM panel"))
def wide_round_trip(spark, sf):
    long = panel(spark, sf, "p3")
    names = ["A", "N", "R"]
    wide, mu = (P.to_wide(long, c, names) for c in ("price", "mu"))
    return P.to_long(wide, mu, check=False).select("ts", "asset", "price")


@query("active_mask", O.flow("p6", out="SELECT ts, row_idx, asset, price IS NOT NULL AS active FROM panel"))
def active_mask(spark, sf):
    return panel(spark, sf, "p6").select(*KEY, returns.active(F.col("price")).alias("active"))


@query("signal_clean", O.flow("p6", out=f"SELECT ts, row_idx, asset, {rnd('coalesce(mu, 0.0) AS mu')} FROM panel WHERE price IS NOT NULL"))
def signal_clean(spark, sf):
    return rounded(panel(spark, sf, "p6").where("price IS NOT NULL").select(*KEY, F.coalesce(P.finite(F.col("mu")), F.lit(0.0)).alias("mu")))


@query("zero_signal", O.flow("p6", out="SELECT ts, row_idx, bool_and(abs(mu) <= 1e-8) AS zero FROM panel WHERE price IS NOT NULL GROUP BY 1, 2"))
def zero_signal(spark, sf):
    return panel(spark, sf, "p6").where("price IS NOT NULL").groupBy("ts", "row_idx").agg(F.bool_and(F.abs("mu") <= 1e-8).alias("zero"))


@query("validation_stats", O.flow("p6", out="""SELECT asset, count(*) AS n_rows, count(*) FILTER (price IS NULL) AS n_null, round(count(*) FILTER (price IS NULL) / count(*), 6) AS null_fraction, round(min(price), 6) AS min_price,
    coalesce(count(price) > 2 AND (bool_and(step >= 0) OR bool_and(step <= 0)), false) AS monotonic
    FROM (SELECT *, CASE WHEN price IS NOT NULL THEN price - lag(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY row_idx) END AS step FROM panel) GROUP BY asset"""))
def validation_stats(spark, sf):
    return rounded(P.validation_stats(panel(spark, sf, "p6")))


# ---- returns and volatility --------------------------------------------------------------------


@query("log_returns", O.flow("p6", R6, out=f"SELECT ts, row_idx, asset, {rnd('log_ret')} FROM ret"))
def log_returns(spark, sf):
    return rounded(returns.with_log_returns(panel(spark, sf, "p6")).select(*KEY, "log_ret"))


@query("pct_returns", O.flow("p6", R6, out=f"SELECT ts, row_idx, asset, {rnd('pct_ret')} FROM ret"))
def pct_returns(spark, sf):
    return rounded(returns.with_pct_returns(panel(spark, sf, "p6")).select(*KEY, "pct_ret"))


@query("ewm_std", O.flow("p3", V3, out=f"SELECT ts, row_idx, asset, {rnd('log_std')} FROM adj"))
def ewm_std(spark, sf):
    p = returns.with_log_returns(panel(spark, sf, "p3"))
    return rounded(ewm.ewm_std(p, returns.KEYS, F.col("log_ret"), CFG.beta_vola, "log_std").select(*KEY, "log_std"))


@query("ewm_accumulators", O.flow("p3", V3, out=f"""SELECT asset, {rnd('s_x', 's_x2', 's_w', 's_w2')}, CAST(n AS DOUBLE) AS "count" FROM (
    SELECT asset, sum(pow({CFG.beta_vola}, last - row_idx) * log_ret) AS s_x, sum(pow({CFG.beta_vola}, last - row_idx) * log_ret * log_ret) AS s_x2, sum(pow({CFG.beta_vola}, last - row_idx)) AS s_w,
           sum(pow({CFG.beta_vola}, 2 * (last - row_idx))) AS s_w2, count(log_ret) AS n FROM ret, (SELECT max(row_idx) AS last FROM panel) WHERE log_ret IS NOT NULL GROUP BY 1)"""))
def ewm_accumulators(spark, sf):
    return rounded(returns.accumulators(panel(spark, sf, "p3"), CFG).drop("universe"))


@query("vola", O.flow("p6", R6, out=f"SELECT ts, row_idx, asset, {rnd('vola')} FROM adj"))
def vola(spark, sf):
    return rounded(engine(spark, sf, "p6").vola.select(*KEY, "vola"))


@query("ret_adj", O.flow("p6", R6, out=f"SELECT ts, row_idx, asset, {rnd('ret_adj')} FROM adj"))
def ret_adj(spark, sf):
    return rounded(engine(spark, sf, "p6").ret_adj.select(*KEY, "ret_adj"))


# ---- covariance --------------------------------------------------------------------------------


@query("ewm_cov", O.flow("p3", V3, C3, out=f"SELECT ts, row_idx, i, j, {rnd('cov')} FROM cov"))
def ewm_cov(spark, sf):
    return rounded(covariance.ewm_cov(engine(spark, sf, "p3").enriched, CFG))


@query("ewm_cor", O.flow("p3", V3, C3, out=f"SELECT ts, row_idx, i, j, {rnd('rho')} FROM cor"))
def ewm_cor(spark, sf):
    return rounded(engine(spark, sf, "p3").cor.drop("cov"))


@query("shrunk_cor", O.flow("p3", V3, C3, out=f"SELECT ts, row_idx, i, j, {rnd(f'{CFG.shrink} * rho + (1 - {CFG.shrink}) * CASE WHEN i = j THEN 1 ELSE 0 END AS c')} FROM cor"))
def shrunk_cor(spark, sf):
    c = engine(spark, sf, "p3").cor
    return rounded(c.select("ts", "row_idx", "i", "j", covariance.shrink2id(F.col("rho"), F.col("i") == F.col("j"), CFG.shrink).alias("c")))


@query("shrink2id", O.flow("p3", V3, C3, out=f"SELECT ts, row_idx, i, j, lam, {rnd('lam * rho + (1 - lam) * CASE WHEN i = j THEN 1 ELSE 0 END AS c')} FROM cor, (SELECT unnest([0.0, 0.25, 1.0])::DOUBLE AS lam)"))
def shrink2id(spark, sf):
    c = engine(spark, sf, "p3").cor.withColumn("lam", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 1.0)])))
    return rounded(c.select("ts", "row_idx", "i", "j", "lam", covariance.shrink2id(F.col("rho"), F.col("i") == F.col("j"), F.col("lam")).alias("c")))


@query("cor_tensor", O.flow("p3", V3, C3, out="""SELECT ts, row_idx, 3 AS n, cell, round(rho, 6) AS c FROM (
    SELECT ts, row_idx, i * 3 + j AS cell, rho FROM cor UNION ALL SELECT ts, row_idx, j * 3 + i AS cell, rho FROM cor WHERE i < j)"""))
def cor_tensor(spark, sf):
    t = engine(spark, sf, "p3").cor_tensor
    return rounded(t.select("ts", "row_idx", "n", F.posexplode("m").alias("cell", "c")))


@query("window_gram", O.flow("p3", V3, O.gram_sql(60), out=f"SELECT ts, row_idx, i, j, {rnd('gram')} FROM gram"))
def window_gram(spark, sf):
    return rounded(covariance.window_gram(engine(spark, sf, "p3").enriched, 60))


def _sw_cov(batches):
    import pandas as pd

    from ..functions.kernel import FactorModel

    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            g = solve._full(r, 1 + int(max(r.pj)))
            c = FactorModel.from_gram(g / 60, 1).covariance
            out += [(r.row_idx, int(i), int(j), c[i, j]) for i, j in zip(r.pi, r.pj, strict=True)]
        yield pd.DataFrame(out, columns=["row_idx", "i", "j", "cov"])


def _sw_cov_cells(spark, sf, name: str) -> DataFrame:
    """``row_idx, i, j, cov`` of all assets of a panel, pairs ``i <= j``."""
    m = solve.matrices(engine(spark, sf, name, WINDOW).enriched, WINDOW).where("row_idx >= 59").withColumn("row_idx", F.col("row_idx").cast("int"))
    return m.mapInPandas(_sw_cov, "row_idx int, i int, j int, cov double")


@query("sw_cov", O.flow("p2", O.returns_sql(WINDOW), O.gram_sql(60), EIG2, out=f"SELECT row_idx, {rnd('d0 AS c00', 'c AS c01', 'd1 AS c11')} FROM mat WHERE row_idx >= 59"))
def sw_cov(spark, sf):
    cell = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("cov")))
    return rounded(_sw_cov_cells(spark, sf, "p2").groupBy("row_idx").agg(cell(0, 0).alias("c00"), cell(0, 1).alias("c01"), cell(1, 1).alias("c11")))


@query("sw_cov_p25")
def sw_cov_p25(spark, sf):
    return rounded(_sw_cov_cells(spark, sf, "p25"))


# each vector is a factor model of four assets: loadings, own variances and a right-hand side from its first twelve numbers
_SMALL = """e AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS b, 0.5 + abs(CAST(embedding[i + 5] AS DOUBLE)) AS d, CAST(embedding[i + 9] AS DOUBLE) AS y FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS i))"""


def _small_models(what):
    """Arrow batches of vectors; ``what`` gives rows of a model and its right-hand side."""
    import numpy as np
    import pandas as pd

    from ..functions.kernel import FactorModel

    def run(frames):
        for pdf in frames:
            out = []
            for vec_id, v in zip(pdf.vec_id, pdf.embedding, strict=True):
                v = np.asarray(v, float)
                out += [(vec_id, *r) for r in what(FactorModel(v[:4, None], np.array([[2.0]]), 0.5 + np.abs(v[4:8])), v[8:12])]
            yield pd.DataFrame(out, columns=["vec_id", *names])

    names = ["i", "j", "cov"] if what is _cells_of else ["i", "x"]
    return run


def _cells_of(model, rhs):
    c = model.covariance
    return [(i, j, c[i, j]) for i in range(4) for j in range(4)]


def _solution_of(model, rhs):
    return list(enumerate(model.solve(rhs)))


@query("factor_cov", f"WITH {_SMALL} SELECT x.vec_id, x.i, y.i AS j, {rnd('2.0 * x.b * y.b + CASE WHEN x.i = y.i THEN x.d ELSE 0 END AS cov')} FROM e x JOIN e y ON x.vec_id = y.vec_id")
def factor_cov(spark, sf):
    """The kernel's factor covariance, for every vector."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return rounded(e.mapInPandas(_small_models(_cells_of), "vec_id long, i int, j int, cov double"))


@query("factor_solve", f"WITH {_SMALL}, s AS (SELECT vec_id, sum(b * y / d) AS bz, sum(b * b / d) AS bb FROM e GROUP BY 1) SELECT vec_id, i, {rnd('y / d - b / d * bz / (1 / 2.0 + bb) AS x')} FROM e JOIN s USING (vec_id)")
def factor_solve(spark, sf):
    """The kernel's solution by Woodbury's formula, for every vector; with one factor it is Sherman and Morrison's."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return rounded(e.mapInPandas(_small_models(_solution_of), "vec_id long, i int, x double"))


_WB = "w AS (SELECT CAST(embedding[1] AS DOUBLE) AS b, CAST(embedding[2] AS DOUBLE) AS y, 0.5 + abs(CAST(embedding[3] AS DOUBLE)) AS d, vec_id FROM embeddings)"


@query("woodbury_k1", f"WITH {_WB}, s AS (SELECT sum(b * y / d) AS by, sum(b * b / d) AS bb FROM w) SELECT vec_id, {rnd('y / d - b / d * s.by / (1 / 2.0 + s.bb) AS x')} FROM w, s")
def woodbury_k1(spark, sf):
    """One factor of variance 2: Sherman and Morrison's formula, two sums and a projection."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    c = lambda k: F.col("embedding")[k].cast("double")
    w = e.select("vec_id", c(0).alias("b"), c(1).alias("y"), (0.5 + F.abs(c(2))).alias("d"))
    s = F.broadcast(w.agg(F.sum(F.col("b") * F.col("y") / F.col("d")).alias("by"), F.sum(F.col("b") * F.col("b") / F.col("d")).alias("bb")))
    return rounded(w.crossJoin(s).select("vec_id", (F.col("y") / F.col("d") - F.col("b") / F.col("d") * F.col("by") / (0.5 + F.col("bb"))).alias("x")))


def _dimension_model(spark, sf):
    """Second moments of the 64 embedding dimensions summed in the cluster, then a three-factor fit of one small matrix."""
    import numpy as np
    import pandas as pd

    from ..functions.kernel import FactorModel

    def moments(frames):
        total, rows = 0.0, 0
        for pdf in frames:
            if len(pdf):
                x = np.vstack(pdf.v.to_numpy())
                total, rows = total + x.T @ x, rows + len(x)
        if rows:
            yield pd.DataFrame({"rows": [rows], "g": [np.asarray(total).ravel()]})

    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("v"))
    sums = e.mapInPandas(moments, "rows long, g array<double>").select("rows", F.posexplode("g").alias("k", "g")).groupBy("k").agg(F.sum("g").alias("g"), F.sum("rows").alias("rows"))
    cells = sums.collect()  # the square of the number of dimensions, whatever the rows
    n = round(len(cells) ** 0.5)
    gram = np.zeros(n * n)
    for r in cells:
        gram[r.k] = r.g / r.rows
    gram = gram.reshape(n, n)
    return FactorModel.from_gram(gram, 3)


@query("factor_model_fit")
def factor_model_fit(spark, sf):
    m = _dimension_model(spark, sf)
    c = m.covariance
    return spark.createDataFrame([(i, float(m.idio[i]), float(c[i, i]), float(m.woodbury_condition_number)) for i in range(m.n_assets)], "dim int, idio double, variance double, woodbury_condition double")


@query("factor_cov_dims")
def factor_cov_dims(spark, sf):
    """Factor covariance over every row: the embedding dimensions are the assets, the loadings those of their fit."""
    m = _dimension_model(spark, sf)
    b = [(i, k, float(m.loadings[i, k]), float(m.factor_cov[k, k])) for i in range(m.n_assets) for k in range(m.n_factors)]
    d = [(i, float(x)) for i, x in enumerate(m.idio)]
    return rounded(covariance.factor_cov(spark.createDataFrame(b, "i int, l int, b double, f double"), spark.createDataFrame(d, "i int, d double")))


# ---- positions ---------------------------------------------------------------------------------


def _named(e: Engine, df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(e.panel.select("asset_ord", "asset").distinct()), "asset_ord").drop("asset_ord")


@query("cash_position", O.flow("p3", *SOL3, out=f"SELECT ts, row_idx, asset_ord, status, {rnd('cash', digits=5)} FROM cashq"))
def cash_position(spark, sf):
    return rounded(engine(spark, sf, "p3").cash_position.select("ts", "row_idx", "asset_ord", "status", "cash"), 5)


@query("position_status", O.flow("p3", *SOL3, out="SELECT ts, row_idx, status FROM sol"))
def position_status(spark, sf):
    return engine(spark, sf, "p3").position_status.select("ts", "row_idx", "status")


@query("risk_position", O.flow("p3", *SOL3, out=f"SELECT ts, row_idx, asset_ord, {rnd('cash * vola AS risk')} FROM cashq"))
def risk_position(spark, sf):
    return rounded(engine(spark, sf, "p3").risk_position)


@query("position_leverage", O.flow("p3", *SOL3, out=f"SELECT ts, row_idx, {rnd('coalesce(sum(abs(cash)), 0.0) AS leverage', digits=5)} FROM cashq GROUP BY 1, 2"))
def position_leverage(spark, sf):
    return rounded(engine(spark, sf, "p3").position_leverage, 5)


@query("warmup_state", O.flow("p3", *SOL3, out=f"SELECT asset_ord, {rnd('cash', digits=5)} FROM cashq WHERE row_idx = (SELECT max(row_idx) FROM panel)"))
def warmup_state(spark, sf):
    return rounded(engine(spark, sf, "p3").warmup_state, 5)


@query("sw_cash_position", O.flow("p2", *SW2, SW2_STATUS, O.positions_sql(2).replace("JOIN sol s", "JOIN solw s"), out=f"SELECT ts, row_idx, asset_ord, status, {rnd('cash', digits=5)} FROM cashq"))
def sw_cash_position(spark, sf):
    return rounded(engine(spark, sf, "p2", WINDOW).cash_position.select("ts", "row_idx", "asset_ord", "status", "cash"), 5)


@query("sw_position_status", O.flow("p2", *SW2, SW2_STATUS, out="SELECT ts, row_idx, status FROM solw"))
def sw_position_status(spark, sf):
    return engine(spark, sf, "p2", WINDOW).position_status.select("ts", "row_idx", "status")


@query("sw_cash_position_p25")
def sw_cash_position_p25(spark, sf):
    return rounded(engine(spark, sf, "p25", WINDOW).cash_position.select("ts", "row_idx", "asset_ord", "status", "cash"), 5)


@query("sw_position_status_p25")
def sw_position_status_p25(spark, sf):
    return engine(spark, sf, "p25", WINDOW).position_status.select("ts", "row_idx", "status")


# the recurrence itself, row by row
_CAPPED = f"""cw AS (SELECT row_idx, max(CASE WHEN asset_ord = 0 THEN cash END) AS c0, max(CASE WHEN asset_ord = 1 THEN cash END) AS c1, max(CASE WHEN asset_ord = 2 THEN cash END) AS c2 FROM cashq GROUP BY 1),
    cap AS (SELECT -1 AS row_idx, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2 UNION ALL
        SELECT row_idx, CASE WHEN c0 IS NULL THEN 0.0 ELSE p0 + s0 * k END, CASE WHEN c1 IS NULL THEN 0.0 ELSE p1 + s1 * k END, CASE WHEN c2 IS NULL THEN 0.0 ELSE p2 + s2 * k END
        FROM (SELECT *, CASE WHEN abs(s0) + abs(s1) + abs(s2) <= {CAPPED.max_turnover} THEN 1.0 ELSE {CAPPED.max_turnover} / (abs(s0) + abs(s1) + abs(s2)) END AS k
              FROM (SELECT w.*, p0, p1, p2, coalesce(c0, 0) - p0 AS s0, coalesce(c1, 0) - p1 AS s1, coalesce(c2, 0) - p2 AS s2 FROM cap JOIN cw w ON w.row_idx = cap.row_idx + 1)))"""


@query("turnover_capped", O.flow("p3", *SOL3, _CAPPED, out="SELECT q.ts, q.row_idx, q.asset_ord, q.status, round(CASE WHEN q.cash IS NOT NULL THEN CASE q.asset_ord WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END END, 5) AS cash FROM cashq q JOIN cap USING (row_idx)").replace("WITH ", "WITH RECURSIVE ", 1))
def turnover_capped(spark, sf):
    return rounded(engine(spark, sf, "p3", CAPPED).cash_position, 5)


# ---- diagnostics -------------------------------------------------------------------------------


@query("condition_number", O.flow("p2", *SOL2, out=f"SELECT ts, row_idx, {rnd('(1 + abs(c)) / (1 - abs(c)) AS condition_number')} FROM sol"))
def condition_number(spark, sf):
    return rounded(engine(spark, sf, "p2").condition_number())


@query("condition_number_p25")
def condition_number_p25(spark, sf):
    return rounded(engine(spark, sf, "p25").condition_number())


@query("effective_rank", O.flow("p2", *SOL2, out=f"SELECT ts, row_idx, {rnd('exp(-((1 + c) / 2 * ln((1 + c) / 2) + (1 - c) / 2 * ln((1 - c) / 2))) AS effective_rank')} FROM sol"))
def effective_rank(spark, sf):
    return rounded(engine(spark, sf, "p2").effective_rank())


@query("effective_rank_p25")
def effective_rank_p25(spark, sf):
    return rounded(engine(spark, sf, "p25").effective_rank())


@query("signal_utilisation", O.flow("p2", *SOL2, out="""SELECT ts, row_idx, k AS asset_ord, round(CASE WHEN c IS NULL AND NOT zero THEN NULL WHEN zero THEN 0.0 WHEN k = 0 THEN CASE WHEN abs(m0) > 1e-14 THEN x0 / m0 END ELSE CASE WHEN abs(m1) > 1e-14 THEN x1 / m1 END END, 6) AS utilisation
    FROM sol, (SELECT unnest([0, 1]) AS k)"""))
def signal_utilisation(spark, sf):
    return rounded(engine(spark, sf, "p2").signal_utilisation())


@query("signal_utilisation_p25")
def signal_utilisation_p25(spark, sf):
    return rounded(engine(spark, sf, "p25").signal_utilisation())


@query("solver_residual")
def solver_residual(spark, sf):
    return rounded(engine(spark, sf, "p25").solver_residual(), 9)


@query("solver_residual_p2", O.flow("p2", *SOL2, out="SELECT ts, row_idx, CASE WHEN zero OR x0 IS NOT NULL THEN 0.0 END AS residual FROM sol"))
def solver_residual_p2(spark, sf):
    """What remains of the signal is below the nine digits kept wherever a solution exists."""
    return rounded(engine(spark, sf, "p2").solver_residual(), 9)


# ---- signal evaluation -------------------------------------------------------------------------


def _fwd(h: int) -> str:
    return f"fwd AS (SELECT *, lead(price, {h}) OVER (PARTITION BY asset ORDER BY row_idx) / price - 1 AS fwd FROM panel QUALIFY lead(row_idx, {h}) OVER (PARTITION BY asset ORDER BY row_idx) IS NOT NULL)"


def _ic(h: int, rank: bool = False) -> tuple[str, str]:
    x = "CASE WHEN mu IS NOT NULL AND fwd IS NOT NULL THEN {} END"
    pairs = f"raw AS (SELECT ts, row_idx, {x.format('mu')} AS x, {x.format('fwd')} AS y FROM fwd)"
    if rank:
        mid = "CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY row_idx, x IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY row_idx, x IS NULL, {c}) - 1) / 2.0 END"
        pairs += f", prk AS (SELECT ts, row_idx, CAST({mid.format(c='x')} AS DOUBLE) AS x, CAST({mid.format(c='y')} AS DOUBLE) AS y FROM raw)"
    src = "prk" if rank else "raw"
    return _fwd(h), f"{pairs}, ic AS (SELECT ts, row_idx, CASE WHEN count(x) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS ic FROM {src} GROUP BY 1, 2)"


@query("fwd_return_h", O.flow("p5", _fwd(5), out=f"SELECT ts, row_idx, asset, {rnd('fwd')} FROM fwd"))
def fwd_return_h(spark, sf):
    return rounded(signal_eval.forward_returns(panel(spark, sf, "p5"), 5).select(*KEY, "fwd"))


def _summary_sql(p: str) -> str:
    return f"SELECT {rnd(f'avg(ic) AS {p}_mean', f'stddev_samp(ic) AS {p}_std', f'CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END AS {p}ir')}, count(ic) AS n FROM ic"


@query("ic", O.flow("p5", *_ic(1), out=f"SELECT ts, row_idx, {rnd('ic')} FROM ic"))
def ic(spark, sf):
    return rounded(engine(spark, sf, "p5").ic())


@query("ic_h5", O.flow("p5", *_ic(5), out=f"SELECT ts, row_idx, {rnd('ic')} FROM ic"))
def ic_h5(spark, sf):
    return rounded(engine(spark, sf, "p5").ic(5))


@query("rank_ic", O.flow("p5", *_ic(1, True), out=f"SELECT ts, row_idx, {rnd('ic')} FROM ic"))
def rank_ic(spark, sf):
    return rounded(engine(spark, sf, "p5").rank_ic())


@query("ic_summary", O.flow("p5", *_ic(1), out=_summary_sql("ic")))
def ic_summary(spark, sf):
    return rounded(engine(spark, sf, "p5").ic_summary())


@query("rank_ic_summary", O.flow("p5", *_ic(1, True), out=_summary_sql("rank_ic")))
def rank_ic_summary(spark, sf):
    return rounded(engine(spark, sf, "p5").rank_ic_summary())


# ---- profit and loss ---------------------------------------------------------------------------

A = CFG.aum


@query("portfolio", O.flow("p3", *BOOK3, out=f"SELECT ts, row_idx, asset, price, {rnd('cash', digits=0)} FROM book"))
def portfolio(spark, sf):
    return rounded(engine(spark, sf, "p3").book.select(*KEY, "price", "cash"), 9, cash=0)


@query("profits", O.flow("p3", *BOOK3, out=f"SELECT ts, row_idx, asset, {rnd('profit', digits=1)} FROM prof"))
def profits(spark, sf):
    return rounded(pnl.profits(engine(spark, sf, "p3").book).select(*KEY, "profit"), 1)


@query("profit", O.flow("p3", *BOOK3, out=f"SELECT ts, row_idx, {rnd('profit', digits=1)} FROM daily"))
def profit(spark, sf):
    return rounded(engine(spark, sf, "p3").daily.select("ts", "row_idx", "profit"), 1)


@query("returns", O.flow("p3", *BOOK3, out=f"SELECT ts, row_idx, {rnd('returns')} FROM daily"))
def returns_(spark, sf):
    return rounded(engine(spark, sf, "p3").daily.select("ts", "row_idx", "returns"))


@query("nav_accumulated", O.flow("p3", *BOOK3, out='SELECT ts, row_idx, round(nav, 1) AS "NAV_accumulated" FROM nav'))
def nav_accumulated(spark, sf):
    return rounded(pnl.nav_accumulated(engine(spark, sf, "p3").daily, A).select("ts", "row_idx", "NAV_accumulated"), 1)


# an exact recurrence in the oracle, where the engine multiplies signs, zeros and logarithms of sizes
_COMPOUND = f"comp AS (SELECT ts, row_idx, list_reduce(list_prepend({A!r}::DOUBLE, list(1 + returns) OVER (ORDER BY row_idx)), lambda a, b: a * b) AS compounded FROM daily)"


@query("nav_compounded", O.flow("p3", *BOOK3, _COMPOUND, out='SELECT ts, row_idx, round(compounded, 1) AS "NAV_compounded" FROM comp'))
def nav_compounded(spark, sf):
    return rounded(pnl.nav_compounded(engine(spark, sf, "p3").daily, A).select("ts", "row_idx", "NAV_compounded"), 1)


@query("drawdown", O.flow("p3", *BOOK3, out=f"SELECT ts, row_idx, {rnd('highwater', digits=1)}, {rnd('drawdown')} FROM nav"))
def drawdown(spark, sf):
    return rounded(pnl.drawdown(engine(spark, sf, "p3").daily, A).select("ts", "row_idx", "highwater", "drawdown"), highwater=1)


@query("all_view", O.flow("p3", *BOOK3, _COMPOUND, out=f'SELECT ts, row_idx, {rnd("profit", digits=1)}, {rnd("returns")}, round(nav, 1) AS "NAV_accumulated", {rnd("highwater", digits=1)}, {rnd("drawdown")}, round(compounded, 1) AS "NAV_compounded" FROM nav JOIN comp USING (ts, row_idx)'))
def all_view(spark, sf):
    return rounded(engine(spark, sf, "p3").all_view(), profit=1, NAV_accumulated=1, highwater=1, NAV_compounded=1)


_TILT = f"""tt AS (SELECT ts, row_idx, coalesce(lag(cash) OVER w * ret, 0.0) AS p, coalesce(lag(flat) OVER w * ret, 0.0) AS f, coalesce(lag(cash - flat) OVER w * ret, 0.0) AS m
    FROM (SELECT *, CASE WHEN cash IS NOT NULL THEN avg(cash) OVER (PARTITION BY asset) END AS flat FROM prof) WINDOW w AS (PARTITION BY asset ORDER BY row_idx)),
    td AS (SELECT ts, row_idx, sum(p) AS p, sum(f) AS f, sum(m) AS m FROM tt GROUP BY 1, 2)"""


@query("tilt_timing", O.flow("p3", *BOOK3, _TILT, out=f"SELECT ts, row_idx, round({A} + sum(p) OVER w, 1) AS portfolio, round({A} + sum(f) OVER w, 1) AS tilt, round({A} + sum(m) OVER w, 1) AS timing FROM td WINDOW w AS (ORDER BY row_idx)"))
def tilt_timing(spark, sf):
    return rounded(pnl.tilt_timing(engine(spark, sf, "p3").book, A), 1)


@query("turnover", O.flow("p3", *BOOK3, out=f"SELECT ts, row_idx, {rnd('turnover')} FROM turn"))
def turnover(spark, sf):
    return rounded(pnl.turnover(engine(spark, sf, "p3").book, A))


@query("turnover_weekly", O.flow("p3", *BOOK3, out=f"SELECT date_trunc('week', ts)::TIMESTAMP AS week, {rnd('sum(turnover) AS turnover')} FROM turn GROUP BY 1"))
def turnover_weekly(spark, sf):
    return rounded(pnl.turnover_weekly(pnl.turnover(engine(spark, sf, "p3").book, A)).withColumn("week", F.col("week").cast("timestamp_ntz")))


@query("turnover_summary", O.flow("p3", *BOOK3, out=f"""SELECT 'mean_daily_turnover' AS metric, {rnd('avg(turnover) AS value')} FROM turn UNION ALL SELECT 'turnover_std', {rnd('stddev_samp(turnover) AS value')} FROM turn
    UNION ALL SELECT 'mean_weekly_turnover', {rnd('avg(t) AS value')} FROM (SELECT sum(turnover) AS t FROM turn GROUP BY date_trunc('week', ts))"""))
def turnover_summary(spark, sf):
    return rounded(pnl.turnover_summary(pnl.turnover(engine(spark, sf, "p3").book, A)))


@query("net_cost_nav", O.flow("p3", *BOOK3, out=f"""SELECT ts, row_idx, {rnd('profit', 'cost', digits=1)}, round(nav - sum(cost) OVER (ORDER BY row_idx), 1) AS "NAV_accumulated_net" FROM (SELECT nav.*, traded * {CFG.cost_per_unit} AS cost FROM nav JOIN moved USING (ts, row_idx))"""))
def net_cost_nav(spark, sf):
    return rounded(pnl.net_cost_nav(engine(spark, sf, "p3").book, A, CFG.cost_per_unit), 1)


@query("cost_adjusted_returns", O.flow("p3", *BOOK3, out=f"SELECT ts, row_idx, {rnd('returns - turnover * 5 / 1e4 AS returns')} FROM daily JOIN turn USING (ts, row_idx)"))
def cost_adjusted_returns(spark, sf):
    return rounded(pnl.cost_adjusted_returns(engine(spark, sf, "p3").book, A, 5))


@query("trading_cost_impact", O.flow("p3", *BOOK3, out=f"SELECT cost_bps, {rnd('sqrt(252) * avg(returns - turnover * cost_bps / 1e4) / stddev_samp(returns - turnover * cost_bps / 1e4) AS sharpe')} FROM daily JOIN turn USING (ts, row_idx), (SELECT unnest(range(0, 21))::BIGINT AS cost_bps) GROUP BY 1"))
def trading_cost_impact(spark, sf):
    return rounded(pnl.trading_cost_impact(engine(spark, sf, "p3").book, A, 20))


@query("monthly", O.flow("p3", *BOOK3, out=f"""SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, strftime(min(ts), '%b') AS month_name, {rnd('sum(returns) AS returns')}, {rnd('sum(profit) AS profit', digits=1)}, round(arg_max(nav, row_idx), 1) AS "NAV_accumulated" FROM nav GROUP BY 1, 2"""))
def monthly(spark, sf):
    return rounded(pnl.monthly(engine(spark, sf, "p3").daily, A), profit=1, NAV_accumulated=1)


def _lead_lag_sql() -> str:
    parts = []
    for k in range(-3, 6):
        pos = f"lag(cash, {k + 1}) OVER w" if k >= 0 else ("cash" if k == -1 else f"lead(cash, {-k - 1}) OVER w")
        parts.append(f"SELECT {k} AS lag, {rnd('sqrt(252) * avg(r) / stddev_samp(r) AS sharpe')} FROM (SELECT row_idx, sum(p) / {A} AS r FROM (SELECT row_idx, coalesce({pos} * ret, 0.0) AS p FROM prof WINDOW w AS (PARTITION BY asset ORDER BY row_idx)) GROUP BY 1)")
    return " UNION ALL ".join(parts)


@query("lead_lag_sharpe", O.flow("p3", *BOOK3, out=_lead_lag_sql()))
def lead_lag_sharpe(spark, sf):
    return rounded(pnl.lead_lag_sharpe(engine(spark, sf, "p3").book, A, range(-3, 6)))


@query("truncate", O.flow("p3", *BOOK3, out=f"SELECT ts, row_idx, {rnd('returns')} FROM daily WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-01-01'"))
def truncate(spark, sf):
    days = engine(spark, sf, "p3").daily.select("universe", "ts", "row_idx", "returns")
    return rounded(pnl.truncate(days, F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))))


@query("smoothed_holding", O.flow("p3", *BOOK3, out=f"SELECT ts, row_idx, asset, round(avg(cash) OVER (PARTITION BY asset ORDER BY row_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS cash FROM book"))
def smoothed_holding(spark, sf):
    return rounded(pnl.smoothed_holding(engine(spark, sf, "p3").book, 5).select(*KEY, "cash"), 0)


# ---- statistics --------------------------------------------------------------------------------

SHARPE = "sqrt(252) * avg(returns) / nullif(stddev_samp(returns), 0)"
Z05 = repr(__import__("statistics").NormalDist().inv_cdf(0.05))
VAR = f"avg(returns) + {Z05} * stddev_samp(returns)"


@query("sharpe", O.flow("p3", *BOOK3, out=f"SELECT {rnd(f'{SHARPE} AS sharpe')} FROM daily"))
def sharpe(spark, sf):
    return rounded(stats.sharpe(engine(spark, sf, "p3").daily))


@query("volatility", O.flow("p3", *BOOK3, out=f"SELECT {rnd('sqrt(252) * stddev_samp(returns) AS volatility')} FROM daily"))
def volatility(spark, sf):
    return rounded(stats.volatility(engine(spark, sf, "p3").daily))


@query("value_at_risk", O.flow("p3", *BOOK3, out=f"SELECT {rnd(f'{VAR} AS value_at_risk')} FROM daily"))
def value_at_risk(spark, sf):
    return rounded(stats.value_at_risk(engine(spark, sf, "p3").daily))


@query("cvar", O.flow("p3", *BOOK3, out=f"SELECT {rnd('avg(returns) AS cvar')}, count(*) AS n_tail FROM daily WHERE returns <= (SELECT {VAR} FROM daily)"))
def cvar(spark, sf):
    return rounded(stats.cvar(engine(spark, sf, "p3").daily))


_SPELLS = "sp AS (SELECT max(n) AS longest FROM (SELECT count(*) AS n FROM (SELECT *, sum(CASE WHEN drawdown > 0 THEN 0 ELSE 1 END) OVER (ORDER BY row_idx) AS s FROM nav) WHERE drawdown > 0 GROUP BY s))"


@query("drawdown_stats", O.flow("p3", *BOOK3, _SPELLS, out=f"SELECT {rnd('max(drawdown) AS max_drawdown', 'avg(drawdown) AS avg_drawdown')}, CAST(coalesce(any_value(longest), 0) AS BIGINT) AS max_duration FROM nav, sp"))
def drawdown_stats(spark, sf):
    return rounded(stats.drawdown_stats(pnl.drawdown(engine(spark, sf, "p3").daily, A)))


_MOM = "mo AS (SELECT avg(returns) AS m, var_pop(returns) AS v, max(returns) AS best, min(returns) AS worst FROM daily), md AS (SELECT avg(pow(returns - m, 3)) AS t, avg(pow(returns - m, 4)) AS f FROM daily, mo)"


@query("distribution_stats", O.flow("p3", *BOOK3, _MOM, out=f"SELECT {rnd('m AS mean', 't / pow(v, 1.5) AS skew', 'f / (v * v) - 3 AS kurtosis', 'best', 'worst')} FROM mo, md"))
def distribution_stats(spark, sf):
    return rounded(stats.moments(engine(spark, sf, "p3").daily))


_WIN = """SELECT count(*) FILTER (returns > 0) AS wins, count(*) FILTER (returns < 0) AS losses, sum(returns) FILTER (returns > 0) AS gain, -sum(returns) FILTER (returns < 0) AS loss,
    avg(returns) FILTER (returns > 0) AS avg_win, avg(returns) FILTER (returns < 0) AS avg_loss, (SELECT avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FROM (SELECT sum(returns) AS r FROM daily GROUP BY date_trunc('month', ts)) WHERE r <> 0) AS mw FROM daily"""


@query("win_loss", O.flow("p3", *BOOK3, out=f"SELECT {rnd('wins / (wins + losses) AS win_rate', 'mw AS monthly_win_rate', 'gain / loss AS profit_factor', 'avg_win / -avg_loss AS payoff_ratio', 'avg_win', 'avg_loss')} FROM ({_WIN})"))
def win_loss(spark, sf):
    return rounded(stats.win_loss(engine(spark, sf, "p3").daily))


@query("calmar", O.flow("p3", *BOOK3, out=f"SELECT {rnd('avg(returns) * 252 / max(drawdown) AS calmar', 'sum(returns) / max(drawdown) AS recovery_factor')} FROM nav"))
def calmar(spark, sf):
    return rounded(stats.calmar(pnl.drawdown(engine(spark, sf, "p3").daily, A)))


@query("capture", O.flow("p3", *BOOK3, out=f"""SELECT {rnd('avg(returns) FILTER (bench > 0) / avg(bench) FILTER (bench > 0) AS up_capture', 'avg(returns) FILTER (bench < 0) / avg(bench) FILTER (bench < 0) AS down_capture')}
    FROM daily JOIN (SELECT row_idx, avg(ret) AS bench FROM prof GROUP BY 1) USING (row_idx)"""))
def capture(spark, sf):
    e = engine(spark, sf, "p3")
    bench = returns.with_pct_returns(e.panel).groupBy("universe", "row_idx").agg(F.avg("pct_ret").alias("bench"))
    return rounded(stats.capture(e.daily, bench))


@query("worst_k", O.flow("p3", *BOOK3, out=f"SELECT CAST(place AS INTEGER) AS place, ts, {rnd('returns')} FROM (SELECT *, row_number() OVER (ORDER BY returns, row_idx) AS place FROM daily) WHERE place <= 5"))
def worst_k(spark, sf):
    return rounded(stats.worst_k(engine(spark, sf, "p3").daily, 5))


@query("rolling_sharpe", O.flow("p3", *BOOK3, out="""SELECT ts, row_idx, round(CASE WHEN row_idx >= 51 AND s > 1e-12 THEN sqrt(252) * m / s END, 6) AS rolling_sharpe, round(CASE WHEN row_idx >= 51 THEN sqrt(252) * s END, 6) AS rolling_volatility
    FROM (SELECT ts, row_idx, avg(returns) OVER w AS m, stddev_samp(returns) OVER w AS s FROM daily WINDOW w AS (ORDER BY row_idx ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))"""))
def rolling_sharpe(spark, sf):
    return rounded(stats.rolling(engine(spark, sf, "p3").daily, 52))


@query("annual_sharpe", O.flow("p3", *BOOK3, out=f"SELECT CAST(year(ts) AS INTEGER) AS year, {rnd(f'{SHARPE} AS sharpe')} FROM daily GROUP BY 1"))
def annual_sharpe(spark, sf):
    return rounded(stats.annual_sharpe(engine(spark, sf, "p3").daily))


@query("asset_correlation", O.flow("p6", R6, out=f"SELECT x.asset AS asset_i, y.asset AS asset_j, {rnd('CASE WHEN count(*) >= 2 THEN covar_pop(x.pct_ret, y.pct_ret) / nullif(stddev_pop(x.pct_ret) * stddev_pop(y.pct_ret), 0) END AS corr')} FROM ret x JOIN ret y ON x.row_idx = y.row_idx AND x.asset < y.asset WHERE x.pct_ret IS NOT NULL AND y.pct_ret IS NOT NULL GROUP BY 1, 2"))
def asset_correlation(spark, sf):
    return rounded(stats.asset_correlation(returns.with_pct_returns(panel(spark, sf, "p6"))))


@query("stats_summary", O.flow("p3", *BOOK3, _SPELLS, _MOM, f"one AS (SELECT * FROM ({_WIN}))", out=f"""
    SELECT metric, round(value, 6) AS value FROM (SELECT sum(returns) AS total_return, count(*)::DOUBLE AS n_rows, {SHARPE} AS sharpe, sqrt(252) * stddev_samp(returns) AS volatility, {VAR} AS value_at_risk,
        (SELECT avg(returns) FROM daily WHERE returns <= (SELECT {VAR} FROM daily)) AS cvar, max(drawdown) AS max_drawdown, avg(drawdown) AS avg_drawdown, (SELECT coalesce(longest, 0)::DOUBLE FROM sp) AS max_duration,
        (SELECT m FROM mo) AS mean, (SELECT t / pow(v, 1.5) FROM mo, md) AS skew, (SELECT f / (v * v) - 3 FROM mo, md) AS kurtosis, max(returns) AS best, min(returns) AS worst,
        (SELECT wins / (wins + losses) FROM one) AS win_rate, (SELECT mw::DOUBLE FROM one) AS monthly_win_rate, (SELECT gain / loss FROM one) AS profit_factor, (SELECT avg_win / -avg_loss FROM one) AS payoff_ratio,
        (SELECT avg_win FROM one) AS avg_win, (SELECT avg_loss FROM one) AS avg_loss, avg(returns) * 252 / max(drawdown) AS calmar, sum(returns) / max(drawdown) AS recovery_factor FROM nav)
    UNPIVOT (value FOR metric IN (total_return, n_rows, sharpe, volatility, value_at_risk, cvar, max_drawdown, avg_drawdown, max_duration, mean, skew, kurtosis, best, worst, win_rate, monthly_win_rate, profit_factor, payoff_ratio, avg_win, avg_loss, calmar, recovery_factor))"""))
def stats_summary(spark, sf):
    return rounded(engine(spark, sf, "p3").summary())


# ---- sweeps ------------------------------------------------------------------------------------


def _sweep_sql(lams: list[float], mu: str | None = None) -> str:
    """Cramer's rule on a grid of weights for two assets, with the P&L of each."""
    grid = ", ".join(f"{x!r}::DOUBLE" for x in lams)
    m0, m1 = (mu, mu) if mu else ("max(CASE WHEN asset_ord = 0 THEN mu END)", "max(CASE WHEN asset_ord = 1 THEN mu END)")
    return O.flow(
        "p2", O.returns_sql(CFG), O.cov_sql(CFG), f"lam AS (SELECT unnest([{grid}]) AS lam)",
        "r AS (SELECT row_idx, max(CASE WHEN i = 0 AND j = 1 THEN rho END) AS rho, count(rho) AS known FROM cor GROUP BY 1)",
        f"inp AS (SELECT row_idx, {m0} AS m0, {m1} AS m1 FROM panel GROUP BY 1)",
        "x AS (SELECT lam, row_idx, known, m0, m1, (m0 - lam * rho * m1) / nullif(1 - lam * rho * lam * rho, 0) AS x0, (m1 - lam * rho * m0) / nullif(1 - lam * rho * lam * rho, 0) AS x1 FROM inp JOIN r USING (row_idx), lam)",
        f"s AS (SELECT *, greatest(abs(m0), abs(m1)) > 1e-8 AND known = 3 AND m0 * x0 + m1 * x1 > 0 AND sqrt(m0 * x0 + m1 * x1) > {CFG.denom_tol} AS ok FROM x)",
        f"""b AS (SELECT s.lam, a.asset, a.row_idx, a.price, CASE WHEN a.price IS NULL THEN NULL WHEN ok THEN (CASE a.asset_ord WHEN 0 THEN x0 ELSE x1 END) / sqrt(m0 * x0 + m1 * x1) ELSE 0.0 END / nullif(a.vola, 0) * {CFG.position_scale} AS cash FROM adj a JOIN s USING (row_idx))""",
        f"d AS (SELECT lam, row_idx, sum(p) / {A} AS returns FROM (SELECT lam, row_idx, coalesce(lag(cash) OVER w * (price / lag(price) OVER w - 1), 0.0) AS p FROM b WINDOW w AS (PARTITION BY lam, asset ORDER BY row_idx)) GROUP BY 1, 2)",
        out=f"SELECT {'lam AS shrink, ' if mu is None else ''}{rnd(f'{SHARPE} AS sharpe')} FROM d GROUP BY {'lam' if mu is None else 'ALL'}",
    )


GRID = [round(k / 20, 10) for k in range(21)]


@query("sharpe_at_shrink", _sweep_sql([0.3]))
def sharpe_at_shrink(spark, sf):
    return rounded(engine(spark, sf, "p2").sharpe_at_shrink([0.3]))


@query("sharpe_at_shrink_p25")
def sharpe_at_shrink_p25(spark, sf):
    return rounded(engine(spark, sf, "p25").sharpe_at_shrink([0.3]))


@query("lambda_sweep", _sweep_sql(sorted({*GRID, CFG.shrink})))
def lambda_sweep(spark, sf):
    return rounded(sweeps.lambda_sweep(panel(spark, sf, "p2"), CFG))


@query("lambda_sweep_p25")
def lambda_sweep_p25(spark, sf):
    return rounded(sweeps.lambda_sweep(panel(spark, sf, "p25"), CFG))


@query("naive_sharpe", _sweep_sql([CFG.shrink], mu="1.0"))
def naive_sharpe(spark, sf):
    return rounded(engine(spark, sf, "p2").naive_sharpe())


@query("naive_sharpe_p25")
def naive_sharpe_p25(spark, sf):
    return rounded(engine(spark, sf, "p25").naive_sharpe())


@query("sharpe_at_window_factors")
def sharpe_at_window_factors(spark, sf):
    return rounded(engine(spark, sf, "p3", WINDOW).sharpe_at_window_factors([(40, 1), (60, 2)]))


# ---- streaming ---------------------------------------------------------------------------------

STREAM_ASSETS = ["click", "error", "purchase", "signup", "view"]
STREAM_CFG = EngineConfig(vola=8, corr=24, clip=3.0, shrink=0.5, aum=1e6)
STREAM_WINDOW = EngineConfig(vola=8, corr=24, clip=3.0, shrink=0.5, aum=1e6, covariance=SlidingWindow(24, 2))


def _streamed(spark: SparkSession, sf: str, cfg: EngineConfig, asset: str = "event_type", names: list[str] = STREAM_ASSETS, hours: int = 1) -> DataFrame:
    """Runs the whole events table through the stream once; the result is a Parquet sink in the shared folder."""
    from ..streaming.processor import step_stream

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    ticks = ticks.select(F.lit("e5").alias("universe"), F.col("ts").cast("timestamp").alias("ts"), F.expr(asset).alias("asset"), (1 + F.col("value")).alias("value"))
    out = step_stream(ticks, cfg, names, every_ms=hours * 3_600_000)
    q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("stream_step")
def stream_step(spark, sf):
    return _streamed(spark, sf, STREAM_CFG)


# three kinds of events in windows of six hours, stepped as a stream; the SQL solves the closed windows at once
_SOL_STREAM = (O.returns_sql(STREAM_CFG), O.cov_sql(STREAM_CFG), O.solve3_sql(STREAM_CFG), f"sols AS (SELECT * REPLACE (CASE WHEN row_idx + 1 < {STREAM_CFG.corr} THEN 'warmup' ELSE status END AS status) FROM sol)", O.positions_sql(3).replace("JOIN sol s", "JOIN sols s"))


@query("stream_positions", O.flow("e3", *_SOL_STREAM, out=f"SELECT ts, asset_ord, status, {rnd('vola')}, {rnd('cash', digits=4)} FROM cashq WHERE ts + INTERVAL 7 HOUR <= (SELECT max(ts) FROM events)"))
def stream_positions(spark, sf):
    asset = SOURCES["e3"][2]
    out = _streamed(spark, sf, STREAM_CFG, asset, ["browse", "error", "order"], 6)
    known = lambda c: F.nanvl(F.col(f"z.{c}"), F.lit(None).cast("double"))
    flat = out.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "status", F.posexplode(F.arrays_zip("vola", "cash")).alias("asset_ord", "z"))
    return rounded(flat.select("ts", "asset_ord", "status", known("vola").alias("vola"), known("cash").alias("cash")), cash=4)


@query("stream_sw")
def stream_sw(spark, sf):
    return _streamed(spark, sf, STREAM_WINDOW)


@query("stream_status")
def stream_status(spark, sf):
    return _streamed(spark, sf, STREAM_CFG).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("stream_warmup_state")
def stream_warmup_state(spark, sf):
    """The state that a stream starts from after the table's history, one row per universe."""
    from ..streaming.processor import warm_up

    p = panel(spark, sf, "e5")
    rows = p.groupBy("universe", "ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset_ord", "price"))), lambda x: x["price"]).alias("price"))
    return warm_up(rows, STREAM_CFG)
