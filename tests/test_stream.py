"""The stream: bad ticks, own signals, warm starts, saved states, values by name."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import walk, wide

from plumbline.config import EngineConfig
from plumbline.errors import InsufficientDataError, StateFormatError
from plumbline.operators.engine import Engine
from plumbline.streaming.processor import replay, save_states, step_stream, warm_up
from plumbline.streaming.stepper import State, step

CFG = EngineConfig(vola=4, corr=8, clip=3.0, shrink=0.5, aum=1e6)


@pytest.mark.parametrize("bad", [0.0, -1.0, np.inf, np.nan])
def test_stream_equals_batch_after_a_bad_tick(spark, bad):
    prices, mu = walk(11, 60, "AB")
    prices["A"][10] = bad
    prices["B"][20:22] = bad
    e = Engine(Engine.from_wide(wide(spark, walk(11, 60, "AB")[0]), wide(spark, mu), CFG).panel, CFG, validate=False)
    panel = e.panel.drop("price").join(spark.createDataFrame([(t, a, float(prices[n][t])) for t in range(60) for a, n in enumerate("AB")], "row_idx int, asset_ord int, price double"), ["row_idx", "asset_ord"])
    e = Engine(panel.withColumn("price", F.when(F.abs("price") < float("inf"), F.col("price"))), CFG, validate=False)
    batch = e.cash_position.toPandas().sort_values(["row_idx", "asset_ord"])
    rows = panel.groupBy("universe", "ts").agg(F.array_sort(F.collect_list(F.struct("asset_ord", "price", "mu"))).alias("c"))
    rows = rows.select("universe", F.col("ts").cast("timestamp").alias("ts"), F.col("c.price").alias("price"), F.col("c.mu").alias("mu"))
    stream = replay(rows, CFG).toPandas().sort_values("ts").reset_index(drop=True)
    valid = 0
    for r in batch.itertuples():
        s = stream.loc[r.row_idx]
        if s.status == "warmup":
            continue
        assert s.status == r.status, r.row_idx
        np.testing.assert_allclose(np.array(s.cash, float)[r.asset_ord], r.cash, rtol=1e-6)
        valid += s.status == "valid"
    assert valid > 60
    assert set(stream.status[30:]) == {"valid"}


def test_values_by_name_and_saved_states(tmp_path):
    prices, mu = walk(7, 40, "AB")
    a, b = State.empty(2, CFG), State.empty(2, CFG)
    for t in range(40):
        x = step(a, np.array([prices["A"][t], prices["B"][t]]), np.array([mu["A"][t], mu["B"][t]]), CFG)
        if t == 20:
            b.save(str(tmp_path / "state.json"), CFG, ["A", "B"])
            b, cfg, names = State.load(str(tmp_path / "state.json"))
            assert (cfg, names) == (CFG, ["A", "B"])
        y = step(b, {"B": prices["B"][t], "A": prices["A"][t], "other": 1.0}, {"A": mu["A"][t], "B": mu["B"][t]}, CFG, ["A", "B"])
        assert x.status == y.status
        np.testing.assert_array_equal(x.cash, y.cash)
    with pytest.raises(StateFormatError, match="no value for"):
        step(b, {"A": 1.0}, {"A": 1.0, "B": 1.0}, CFG, ["A", "B"])
    with pytest.raises(StateFormatError, match="names"):
        step(b, {"A": 1.0}, {"A": 1.0}, CFG)
    text = (tmp_path / "state.json").read_text()
    for broken, what in ((text.replace('"format": 1', '"format": 99'), "99"), (text.replace('"format": 1, ', ""), "version"), (text.replace('"sums"', '"other"'), "sums"), ("x", "not a saved state")):
        (tmp_path / "broken.json").write_text(broken)
        with pytest.raises(StateFormatError, match=what):
            State.load(str(tmp_path / "broken.json"))
    assert "finite" in str(InsufficientDataError())
    assert str(InsufficientDataError("none left")) == "none left"


def _ticks(spark, at, prices, mu, lo, hi):
    rows = [("u/1", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=t, minutes=5), a, float(prices[a][t]), float(mu[a][t])) for t in range(lo, hi) for a in "AB"]
    spark.createDataFrame(rows, "universe string, ts timestamp, asset string, value double, mu double").coalesce(1).write.mode("append").parquet(at)


def test_stream_starts_from_history_with_its_own_signal(spark, tmp_path):
    prices, mu = walk(13, 60, "AB")
    rows = [("u/1", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=t), [float(prices[a][t]) for a in "AB"], [float(mu[a][t]) for a in "AB"]) for t in range(60)]
    table = spark.createDataFrame(rows, "universe string, ts timestamp, price array<double>, mu array<double>")
    whole = replay(table, CFG).toPandas().sort_values("ts").reset_index(drop=True)
    states = str(tmp_path / "states")
    assert save_states(warm_up(table.where("ts < timestamp'2024-01-02 16:00:00'"), CFG), states) == 1  # 40 of 60 steps
    _ticks(spark, str(tmp_path / "in"), prices, mu, 35, 60)  # the first five hours are in the history already
    ticks = spark.readStream.schema("universe string, ts timestamp, asset string, value double, mu double").parquet(str(tmp_path / "in"))
    out = step_stream(ticks, CFG, ["A", "B"], late="1 minute", start=states)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").toPandas()
    assert len(got) == 19  # the last hour is still open
    for k, r in enumerate(got.itertuples()):
        assert (r.status, r.ts) == (whole.status[40 + k], whole.ts[40 + k])
        np.testing.assert_allclose(np.array(r.cash, float), np.array(whole.cash[40 + k], float), rtol=1e-9)
    assert set(got.status) == {"valid"}


def test_warnings_name_degenerate_rows(spark, tmp_path):
    prices, mu = walk(5, 40, "A")
    prices["B"], mu["B"] = prices["A"].copy(), np.random.default_rng(1).normal(size=40)
    prices["A"][30] = prices["B"][30] = np.nan
    e = Engine.from_wide(wide(spark, prices), wide(spark, mu), EngineConfig(vola=4, corr=8, clip=3.0, shrink=1.0, aum=1e6))
    found = {}
    for r in e.warnings().collect():
        found.setdefault(r.row_idx, set()).add(r.warning)
    assert found[30] == {"no_price"}
    assert found[0] == {"unknown_matrix"}
    assert found[20] & {"singular_matrix", "denominator", "ill_conditioned"}
    e.save_cor_tensor(str(tmp_path / "tensor"))
    saved = spark.read.parquet(str(tmp_path / "tensor"))
    assert saved.count() == 40 and {"row_idx", "n", "m"} <= set(saved.columns)
    page = e.cfg.report.to_html("Own <title>")
    assert "Own &lt;title&gt;" in page and "beta_corr" in page and "Shrinkage" in page
