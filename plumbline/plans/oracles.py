"""DuckDB SQL that the registered queries are held against; each piece is a named table expression."""

from __future__ import annotations

from ..config import EngineConfig
from .panels import panel_sql


def returns_sql(cfg: EngineConfig) -> str:
    """``ret`` (returns), ``vol`` (both deviations by direct sums over all earlier rows) and ``adj``."""
    b = repr(cfg.beta_vola)
    return f"""
        ret AS (SELECT *, ln(price) - ln(lag(price) OVER w) AS log_ret, price / lag(price) OVER w - 1 AS pct_ret FROM panel
                WINDOW w AS (PARTITION BY asset ORDER BY row_idx)),
        acc AS (SELECT t.asset, t.row_idx,
                       sum(pow({b}, t.row_idx - s.row_idx)) AS w, sum(pow({b}, 2 * (t.row_idx - s.row_idx))) AS ww, count(*) AS n,
                       sum(pow({b}, t.row_idx - s.row_idx) * s.log_ret) AS ls, sum(pow({b}, t.row_idx - s.row_idx) * s.log_ret * s.log_ret) AS lss,
                       sum(pow({b}, t.row_idx - s.row_idx) * s.pct_ret) AS ps, sum(pow({b}, t.row_idx - s.row_idx) * s.pct_ret * s.pct_ret) AS pss
                FROM ret t JOIN ret s ON s.asset = t.asset AND s.row_idx <= t.row_idx AND s.log_ret IS NOT NULL
                WHERE t.log_ret IS NOT NULL GROUP BY 1, 2),
        vol AS (SELECT r.*, a.n, CASE WHEN a.n = 1 THEN 0.0 ELSE sqrt(greatest(a.lss / a.w - (a.ls / a.w) * (a.ls / a.w), 0) * a.w * a.w / nullif(a.w * a.w - a.ww, 0)) END AS log_std,
                       CASE WHEN a.n >= {cfg.vola} THEN sqrt(greatest(a.pss / a.w - (a.ps / a.w) * (a.ps / a.w), 0) * a.w * a.w / nullif(a.w * a.w - a.ww, 0)) END AS vola
                FROM ret r LEFT JOIN acc a USING (asset, row_idx)),
        adj AS (SELECT *, CASE WHEN log_ret IS NULL THEN NULL WHEN log_std = 0 AND log_ret = 0 THEN NULL WHEN log_std = 0 THEN sign(log_ret) * {cfg.clip}
                          ELSE greatest(least(log_ret / nullif(log_std, 0), {cfg.clip}), -{cfg.clip}) END AS ret_adj FROM vol)"""


def cov_sql(cfg: EngineConfig) -> str:
    """``cov`` and ``cor`` for pairs ``i <= j``."""
    b = repr(cfg.beta_corr)
    return f"""
        prs AS (SELECT l.ts, l.row_idx, l.asset_ord AS i, r.asset_ord AS j, l.ret_adj AS x, r.ret_adj AS y FROM adj l JOIN adj r ON l.row_idx = r.row_idx AND l.asset_ord <= r.asset_ord),
        jnt AS (SELECT * FROM prs WHERE x IS NOT NULL AND y IS NOT NULL),
        psum AS (SELECT t.row_idx, t.i, t.j, count(*) AS k, sum(pow({b}, t.row_idx - s.row_idx)) AS w, sum(pow({b}, t.row_idx - s.row_idx) * s.x) AS a,
                        sum(pow({b}, t.row_idx - s.row_idx) * s.y) AS b, sum(pow({b}, t.row_idx - s.row_idx) * s.x * s.y) AS c
                 FROM jnt t JOIN jnt s ON s.i = t.i AND s.j = t.j AND s.row_idx <= t.row_idx GROUP BY 1, 2, 3),
        cov AS (SELECT p.ts, p.row_idx, p.i, p.j, CASE WHEN k >= {cfg.corr} THEN c / w - (a / w) * (b / w) END AS cov FROM prs p LEFT JOIN psum q USING (row_idx, i, j)),
        cor AS (SELECT c.*, CASE WHEN c.i = c.j THEN CASE WHEN vi.cov IS NOT NULL THEN 1.0 END
                                 WHEN c.cov IS NOT NULL AND sqrt(vi.cov * vj.cov) > {cfg.min_corr_denom} THEN greatest(least(c.cov / sqrt(vi.cov * vj.cov), 1.0), -1.0) END AS rho
                FROM cov c JOIN cov vi ON vi.row_idx = c.row_idx AND vi.i = c.i AND vi.j = c.i JOIN cov vj ON vj.row_idx = c.row_idx AND vj.i = c.j AND vj.j = c.j)"""


def gram_sql(window: int) -> str:
    return f"""
        prs AS (SELECT l.ts, l.row_idx, l.asset_ord AS i, r.asset_ord AS j, coalesce(l.ret_adj, 0) * coalesce(r.ret_adj, 0) AS xy
                FROM adj l JOIN adj r ON l.row_idx = r.row_idx AND l.asset_ord <= r.asset_ord),
        gram AS (SELECT ts, row_idx, i, j, CASE WHEN row_idx >= {window - 1} THEN sum(xy) OVER (PARTITION BY i, j ORDER BY row_idx ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) END AS gram FROM prs)"""


def solve2_sql(cfg: EngineConfig, source: str) -> str:
    """``sol`` for two assets, from ``mat`` (row_idx, d0, d1, c): Cramer's rule."""
    return f"""
        {source},
        inp AS (SELECT p.row_idx, p.ts, bool_and(p.price IS NOT NULL) AS full_row, max(abs(p.mu)) <= 1e-8 AS zero,
                       max(CASE WHEN asset_ord = 0 THEN p.mu END) AS m0, max(CASE WHEN asset_ord = 1 THEN p.mu END) AS m1 FROM panel p GROUP BY 1, 2),
        x AS (SELECT inp.*, mat.d0, mat.d1, mat.c, (m0 * d1 - c * m1) / nullif(d0 * d1 - c * c, 0) AS x0, (m1 * d0 - c * m0) / nullif(d0 * d1 - c * c, 0) AS x1
              FROM inp LEFT JOIN mat USING (row_idx)),
        nu AS (SELECT *, CASE WHEN m0 * x0 + m1 * x1 > 0 THEN sqrt(m0 * x0 + m1 * x1) END AS nu FROM x),
        sol AS (SELECT *, CASE WHEN zero THEN 'zero_signal' WHEN nu > {cfg.denom_tol} THEN 'valid' ELSE 'degenerate' END AS status FROM nu)"""


def solve3_sql(cfg: EngineConfig, lam: float | str | None = None) -> str:
    """``sol`` for three assets from ``cor``: Cramer's rule on the shrunk correlation."""
    lam = cfg.shrink if lam is None else lam
    return f"""
        mat AS (SELECT row_idx, max(CASE WHEN i = 0 AND j = 0 THEN {lam} * rho + (1 - {lam}) END) AS d,
                       max(CASE WHEN i = 0 AND j = 1 THEN {lam} * rho END) AS a, max(CASE WHEN i = 0 AND j = 2 THEN {lam} * rho END) AS b,
                       max(CASE WHEN i = 1 AND j = 2 THEN {lam} * rho END) AS c, count(rho) AS known FROM cor GROUP BY 1),
        inp AS (SELECT row_idx, ts, max(abs(mu)) <= 1e-8 AS zero, max(CASE WHEN asset_ord = 0 THEN mu END) AS m0, max(CASE WHEN asset_ord = 1 THEN mu END) AS m1,
                       max(CASE WHEN asset_ord = 2 THEN mu END) AS m2 FROM panel GROUP BY 1, 2),
        det AS (SELECT inp.*, known, a, b, c, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM inp LEFT JOIN mat USING (row_idx)),
        x AS (SELECT *, CASE WHEN known = 6 THEN ((1 - c * c) * m0 + (b * c - a) * m1 + (a * c - b) * m2) / nullif(det, 0) END AS x0,
                     CASE WHEN known = 6 THEN ((b * c - a) * m0 + (1 - b * b) * m1 + (a * b - c) * m2) / nullif(det, 0) END AS x1,
                     CASE WHEN known = 6 THEN ((a * c - b) * m0 + (a * b - c) * m1 + (1 - a * a) * m2) / nullif(det, 0) END AS x2 FROM det),
        nu AS (SELECT *, CASE WHEN m0 * x0 + m1 * x1 + m2 * x2 > 0 THEN sqrt(m0 * x0 + m1 * x1 + m2 * x2) END AS nu FROM x),
        sol AS (SELECT *, CASE WHEN zero THEN 'zero_signal' WHEN nu > {cfg.denom_tol} THEN 'valid' ELSE 'degenerate' END AS status FROM nu)"""


def positions_sql(n: int) -> str:
    """``pos`` (risk and cash per asset) from ``sol`` and ``adj``."""
    x = " ".join(f"WHEN {k} THEN x{k}" for k in range(n))
    return f"""
        pos AS (SELECT v.ts, v.row_idx, v.asset, v.asset_ord, v.price, v.vola, s.status,
                       CASE WHEN v.price IS NULL THEN NULL WHEN s.status = 'valid' THEN (CASE v.asset_ord {x} END) / s.nu WHEN s.status = 'warmup' THEN NULL ELSE 0.0 END AS risk
                FROM adj v JOIN sol s USING (row_idx)),
        cashq AS (SELECT *, risk / nullif(vola, 0) AS cash FROM pos)"""


def book_sql(cfg: EngineConfig) -> str:
    """``book``, ``daily``, ``nav``, ``moved`` from ``cashq``."""
    a = repr(float(cfg.aum))
    return f"""
        book AS (SELECT ts, row_idx, asset, asset_ord, price, cash * {cfg.position_scale} AS cash FROM cashq),
        prof AS (SELECT *, coalesce(lag(cash) OVER w * (price / lag(price) OVER w - 1), 0.0) AS profit, price / lag(price) OVER w - 1 AS ret FROM book WINDOW w AS (PARTITION BY asset ORDER BY row_idx)),
        daily AS (SELECT ts, row_idx, sum(profit) AS profit, sum(profit) / {a} AS returns FROM prof GROUP BY 1, 2),
        nav0 AS (SELECT *, {a} + sum(profit) OVER (ORDER BY row_idx) AS nav FROM daily),
        nav1 AS (SELECT *, max(nav) OVER (ORDER BY row_idx) AS highwater FROM nav0),
        nav AS (SELECT *, (highwater - nav) / nullif(highwater, 0) AS drawdown FROM nav1),
        moved AS (SELECT ts, row_idx, sum(CASE WHEN row_idx = 0 THEN 0 ELSE abs(coalesce(cash, 0) - coalesce(before, 0)) END) AS traded
                  FROM (SELECT *, lag(cash) OVER (PARTITION BY asset ORDER BY row_idx) AS before FROM book) GROUP BY 1, 2),
        turn AS (SELECT ts, row_idx, traded / {a} AS turnover FROM moved)"""


def flow(panel: str, *parts: str, out: str) -> str:
    return "WITH " + ",".join([panel_sql(panel), *parts]) + "\n" + out
