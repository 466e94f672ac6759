from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.config import EngineConfig, SlidingWindow
from plumbline.errors import ColumnMismatchError, DuplicateTimestampError, ExcessiveNullsError, MissingDateColumnError, MonotonicPricesError, NonPositivePricesError, ShapeMismatchError
from plumbline.functions.ewm import ewm_std, ewm_sums
from plumbline.operators import pnl, stats
from plumbline.operators.engine import Engine
from plumbline.sources.panel import to_long
from plumbline.streaming.processor import replay
from plumbline.streaming.stepper import State, step


def dates(n: int) -> list[datetime.date]:
    return [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(n)]


def wide(spark, columns: dict[str, np.ndarray]):
    n = len(next(iter(columns.values())))
    frame = pd.DataFrame({"date": dates(n), **columns})
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "date date, " + ", ".join(f"{c} double" for c in columns))


def walk(seed: int = 0, n: int = 80, names: str = "ABC"):
    rng = np.random.default_rng(seed)
    prices, mu = {}, {}
    for a in names:
        prices[a] = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        mu[a] = rng.normal(0, 1, n)
    return prices, mu


CFG = EngineConfig(vola=16, corr=32, clip=3.0, shrink=0.5, aum=1e6)
GOLDEN = {40: (80.147377420387, 37.062861385912, 57.240820014736), 50: (-70.835872743568, -80.359228347184, 32.067213993143), 60: (32.655350383737, 60.901627409479, -81.870898890859), 79: (-84.622435391405, 19.379347467408, 24.031828098832)}


@pytest.fixture(scope="module")
def golden(spark):
    prices, mu = walk()
    return Engine.from_wide(wide(spark, prices), wide(spark, mu), CFG).cache()


def test_pinned_positions_and_leverage(golden):
    cash = golden.cash_position.toPandas().pivot(index="row_idx", columns="asset_ord", values="cash")
    lev = golden.position_leverage.toPandas().set_index("row_idx").leverage
    for t, want in GOLDEN.items():
        np.testing.assert_allclose(cash.loc[t], want, atol=1e-6)
        assert lev[t] == pytest.approx(sum(map(abs, want)), abs=1e-6)
    assert lev[0] == 0.0


def test_status_and_position_agree(golden):
    df = golden.cash_position.toPandas()
    assert set(df.status) <= {"degenerate", "zero_signal", "valid"}
    assert (df[df.status == "valid"].cash.abs() > 0).all()
    bad = df[df.status != "valid"].cash
    assert ((bad == 0) | bad.isna()).all()
    assert (df[(df.status == "valid")].row_idx >= CFG.corr).all()


def test_identity_pipeline(spark):
    rng = np.random.default_rng(17)
    prices = {"A": 100 + np.cumsum(rng.normal(0, 0.5, 15)), "B": 200 + np.cumsum(rng.normal(0, 0.7, 15))}
    mu = {"A": np.zeros(15), "B": np.zeros(15)}
    mu["A"][10], mu["B"][10] = 3, 4
    e = Engine.from_wide(wide(spark, prices), wide(spark, mu), EngineConfig(vola=5, corr=10, clip=3.0, shrink=0.0, aum=1e6))
    cash = e.cash_position.toPandas().pivot(index="row_idx", columns="asset_ord", values="cash")
    vola = e.enriched.toPandas().pivot(index="row_idx", columns="asset_ord", values="vola")
    assert cash.loc[:4].isna().all().all()
    assert (cash.loc[5:9] == 0).all().all()
    np.testing.assert_allclose(cash.loc[10], np.array([0.6, 0.8]) / vola.loc[10], rtol=1e-12)


def test_ewm_covariance_equals_pandas(spark):
    from plumbline.operators.covariance import ewm_cov

    rng = np.random.default_rng(42)
    x = rng.normal(size=(300, 3))
    x[rng.random((300, 3)) < 0.05] = np.nan
    long = [("u", t, t, str(a), a, None if np.isnan(x[t, a]) else float(x[t, a])) for t in range(300) for a in range(3)]
    df = spark.createDataFrame(long, "universe string, ts int, row_idx int, asset string, asset_ord int, ret_adj double")
    got = ewm_cov(df, EngineConfig(vola=4, corr=16, clip=3.0, shrink=0.5, aum=1)).toPandas()
    want = pd.DataFrame(x).ewm(com=16, min_periods=16).cov(bias=True)
    n = 0
    for r in got.dropna().itertuples():
        assert r.cov == pytest.approx(want.loc[(r.row_idx, r.i), r.j], abs=1e-10)
        n += 1
    assert n > 1000


def test_block_scan_over_many_blocks_equals_the_recurrence(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=900)
    x[rng.random(900) < 0.1] = np.nan
    df = spark.createDataFrame([("k", t, None if np.isnan(v) else float(v)) for t, v in enumerate(x)], "key string, row_idx int, x double")
    got = ewm_sums(df, ["key"], {"s": (F.col("x"), 0.5)}).orderBy("row_idx").toPandas().s
    s, want = 0.0, []
    for v in np.nan_to_num(x):
        want.append(s := 0.5 * s + v)
    np.testing.assert_allclose(got, want, atol=1e-13)
    std = ewm_std(df, ["key"], F.col("x"), 0.8, "sd").orderBy("row_idx").toPandas().sd
    ref = pd.Series(x).ewm(com=4, adjust=True, ignore_na=False).std()
    ok = ~np.isnan(x)
    np.testing.assert_allclose(std[ok][1:], ref[ok][1:], rtol=1e-9)
    assert std[np.flatnonzero(ok)[0]] == 0.0


def test_missing_prices_and_dead_rows(spark):
    prices, mu = walk(3, 70, "AB")
    prices["A"][30] = prices["B"][30] = np.nan
    prices["B"][:10] = np.nan
    e = Engine.from_wide(wide(spark, prices), wide(spark, mu), EngineConfig(vola=8, corr=16, clip=3.0, shrink=0.5, aum=1e6))
    s = e.position_status.toPandas().set_index("row_idx").status
    assert s[30] == "degenerate"
    assert s[20] == "degenerate"  # a newly listed asset has no correlation yet
    assert s[69] == "valid"
    assert e.cash_position.where("row_idx = 30").toPandas().cash.isna().all()


def test_collinear_assets_are_degenerate(spark):
    prices, mu = walk(5, 60, "A")
    prices["B"], mu["B"] = prices["A"].copy(), np.random.default_rng(1).normal(size=60)
    e = Engine.from_wide(wide(spark, prices), wide(spark, mu), EngineConfig(vola=8, corr=16, clip=3.0, shrink=1.0, aum=1e6))
    assert set(e.position_status.toPandas().status) <= {"degenerate", "zero_signal"}


def test_validation(spark):
    prices, mu = walk(1, 30, "AB")
    p, m = wide(spark, prices), wide(spark, mu)
    with pytest.raises(MissingDateColumnError):
        to_long(p.drop("date"), m)
    with pytest.raises(ShapeMismatchError):
        to_long(p, m.drop("B"))
    with pytest.raises(ShapeMismatchError):
        to_long(p, m.limit(5))
    with pytest.raises(ColumnMismatchError):
        to_long(p, m.withColumnRenamed("B", "C"))
    with pytest.raises(DuplicateTimestampError):
        to_long(p.union(p), m.union(m))
    for change, error in ((lambda x: np.where(np.arange(30) == 3, -1, x), NonPositivePricesError), (lambda x: np.where(np.arange(30) > 1, np.nan, x), ExcessiveNullsError), (lambda x: np.arange(30) + 1.0, MonotonicPricesError)):
        with pytest.raises(error):
            Engine.from_wide(wide(spark, prices | {"B": change(prices["B"])}), m, CFG)


def test_turnover_cap_bounds_every_step(spark):
    prices, mu = walk(2, 60, "AB")
    cfg = EngineConfig(vola=8, corr=16, clip=3.0, shrink=0.5, aum=1e6, max_turnover=5.0)
    cash = Engine.from_wide(wide(spark, prices), wide(spark, mu), cfg).cash_position.toPandas().pivot(index="row_idx", columns="asset_ord", values="cash").fillna(0.0)
    moved = cash.diff().abs().sum(axis=1)
    assert moved.max() <= 5.0 + 1e-9
    assert moved.max() > 4.9


@pytest.mark.parametrize("cov", [None, SlidingWindow(20, 2)])
def test_stream_equals_batch(spark, cov):
    prices, mu = walk(42, 80, "ABC")
    prices["C"][50] = np.nan
    cfg = EngineConfig(vola=8, corr=16, clip=3.0, shrink=0.5, aum=1e6, **({"covariance": cov} if cov else {}))
    e = Engine.from_wide(wide(spark, prices), wide(spark, mu), cfg)
    batch = e.cash_position.toPandas()
    rows = e.panel.groupBy("universe", "ts").agg(F.array_sort(F.collect_list(F.struct("asset_ord", "price", "mu"))).alias("c"))
    rows = rows.select("universe", F.col("ts").cast("timestamp").alias("ts"), F.col("c.price").alias("price"), F.col("c.mu").alias("mu"))
    stream = replay(rows, cfg).toPandas().sort_values("ts").reset_index(drop=True)
    cond = e.condition_number().toPandas().set_index("row_idx").condition_number
    compared = 0
    for r in batch.itertuples():
        s = stream.loc[r.row_idx]
        if s.status == "warmup" or cond[r.row_idx] > 1e8:
            continue
        compared += r.status == "valid"
        assert s.status == r.status
        np.testing.assert_allclose(np.array(s.cash, float)[r.asset_ord], r.cash, rtol=1e-6)
    assert compared > 60


def test_state_survives_saving(spark):
    prices, mu = walk(7, 60, "AB")
    cfg = EngineConfig(vola=8, corr=16, clip=3.0, shrink=0.5, aum=1e6)
    a, b = State.empty(2, cfg), State.empty(2, cfg)
    for t in range(60):
        p, m = np.array([prices["A"][t], prices["B"][t]]), np.array([mu["A"][t], mu["B"][t]])
        if t == 30:
            b, back = State.from_json(b.to_json(cfg))
            assert back == cfg
        x, y = step(a, p, m, cfg), step(b, p, m, cfg)
        assert x.status == y.status
        np.testing.assert_array_equal(x.cash, y.cash)


def test_stream_recovers_from_its_checkpoint(spark, tmp_path):
    from plumbline.streaming.processor import step_stream

    rng = np.random.default_rng(0)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    cfg = EngineConfig(vola=3, corr=4, clip=3.0, shrink=0.5, aum=1e6)

    def feed(lo, hi):
        rows = [("u", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h, minutes=m), a, float(100 + rng.normal())) for h in range(lo, hi) for m in (1, 31) for a in ("x", "y")]
        spark.createDataFrame(rows, "universe string, ts timestamp, asset string, value double").coalesce(1).write.mode("append").parquet(src)
        df = spark.readStream.schema("universe string, ts timestamp, asset string, value double").parquet(src)
        step_stream(df, cfg, ["x", "y"], late="1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    feed(0, 12)
    feed(12, 24)
    got = spark.read.parquet(out).orderBy("ts").toPandas()
    assert len(got) == 23  # the last hour is still open
    assert got.ts.is_unique
    assert set(got.status[:3]) == {"warmup"}
    assert got.status.iloc[-1] in ("valid", "degenerate")


def test_profit_and_loss_on_a_hand_made_book(spark):
    rows = [("u", datetime.datetime(2024, 1, 1 + t), t, "A", 0, p, c) for t, (p, c) in enumerate([(100.0, 10.0), (110.0, 20.0), (99.0, None), (99.0, 5.0)])]
    b = spark.createDataFrame(rows, "universe string, ts timestamp, row_idx int, asset string, asset_ord int, price double, cash double")
    days = pnl.daily(b, 100.0)
    v = pnl.all_view(days, 100.0).orderBy("row_idx").toPandas()
    np.testing.assert_allclose(v.profit, [0, 1, -2, 0], atol=1e-12)
    np.testing.assert_allclose(v.NAV_accumulated, [100, 101, 99, 99])
    np.testing.assert_allclose(v.NAV_compounded, [100, 101, 98.98, 98.98])
    np.testing.assert_allclose(v.drawdown, [0, 0, 2 / 101, 2 / 101])
    tt = pnl.tilt_timing(b, 100.0).orderBy("row_idx").toPandas()
    np.testing.assert_allclose(tt.portfolio - 100, tt.tilt - 100 + tt.timing - 100, atol=1e-9)
    t = pnl.turnover(b, 100.0).orderBy("row_idx").toPandas()
    np.testing.assert_allclose(t.turnover, [0, 0.1, 0.2, 0.05])
    assert stats.drawdown_stats(pnl.drawdown(days, 100.0)).first().max_duration == 2
    wiped = spark.createDataFrame([("u", t, t, r) for t, r in enumerate([0.5, -2.0, 0.5, -1.0, 0.5])], "universe string, ts int, row_idx int, returns double")
    np.testing.assert_allclose(pnl.nav_compounded(wiped, 1.0).orderBy("row_idx").toPandas().NAV_compounded, [1.5, -1.5, -2.25, 0, 0], atol=1e-12)
