"""Structured Streaming: windows completed by a watermark, then stepped with per-universe state."""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import EngineConfig
from .stepper import State, _filesystem, step

OUT = "universe string, ts timestamp, status string, cash array<double>, vola array<double>"
COLUMNS = ["universe", "ts", "status", "cash", "vola"]


class Stepper:
    """The engine's state with the last prices, from which a momentum signal is made where none is given."""

    def __init__(self, cfg: EngineConfig, signal: tuple[int, int, float], saved: str | None = None):
        self.cfg, (self.fast, self.slow, self.gain) = cfg, signal
        self.state: State | None = None
        self.past: list[np.ndarray] = []
        self.last: int | None = None  # milliseconds of the last step
        if saved:
            body = json.loads(saved)
            self.state, _ = State.from_json(body["state"])
            self.past = [np.array(r, float) for r in body["past"]]
            self.last = body.get("last")

    def save(self) -> str:
        return json.dumps({"state": self.state.to_json(self.cfg), "past": [p.tolist() for p in self.past], "last": self.last}) if self.state else ""

    def __call__(self, universe: str, ts, price: np.ndarray, mu: np.ndarray | None = None) -> tuple:
        if self.state is None:
            self.state = State.empty(len(price), self.cfg)
        self.past = [*self.past[-(self.slow - 1) :], price]
        if mu is None:
            with np.errstate(all="ignore"), warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)  # means of assets that were never seen
                mu = np.nan_to_num(np.tanh(self.gain * (np.nanmean(self.past[-self.fast :], axis=0) - np.nanmean(self.past, axis=0)) / price))
        s = step(self.state, price, mu, self.cfg)
        self.last = int(np.datetime64(pd.Timestamp(ts), "ms").astype("int64"))
        return universe, ts, s.status, s.cash.tolist(), s.vola.tolist()


def _tick_function(cfg: EngineConfig, names: list[str], every_ms: int, signal: tuple[int, int, float], own_signal: bool, start: str | None) -> Callable:
    order = {n: k for k, n in enumerate(names)}
    columns = ["value", "mu"] if own_signal else ["value"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        saved, opened = group.get if group.exists else (_saved_state(start, key[0]) if start else "", "{}")
        stepper = Stepper(cfg, signal, saved or None)
        windows = {int(k): np.array(v, float) for k, v in json.loads(opened).items()}
        mark = group.getCurrentWatermarkMs()
        done = -1 if stepper.last is None else stepper.last  # what the history holds is not stepped again
        for pdf in frames:
            at = pdf.asset.map(order)
            began = pdf.ts.astype("datetime64[ms]").astype("int64") // every_ms * every_ms
            use = at.notna() & (began + every_ms > mark) & (began > done)  # a closed window takes no more ticks
            ticks = pdf[use].assign(at=at[use].astype(int), began=began[use])
            for row, c in enumerate(columns):
                sums = ticks[ticks[c].notna()].groupby(["began", "at"])[c].agg(["sum", "count"])
                for (w, a), r in zip(sums.index, sums.to_numpy(), strict=True):
                    windows.setdefault(int(w), np.zeros((2 * len(columns), len(names))))[2 * row : 2 * row + 2, a] += r
        out = []
        for w in sorted(k for k in windows if k + every_ms <= mark):
            means = [np.where(n > 0, total / np.maximum(n, 1), np.nan) for total, n in windows.pop(w).reshape(-1, 2, len(names))]
            out.append(stepper(key[0], pd.Timestamp(w, unit="ms"), means[0], means[1] if own_signal else None))
        group.update((stepper.save(), json.dumps({k: v.tolist() for k, v in windows.items()})))
        if windows:
            group.setTimeoutTimestamp(max(min(windows) + every_ms, mark + 1))
        yield pd.DataFrame(out, columns=COLUMNS)

    return run


def step_stream(ticks: DataFrame, cfg: EngineConfig, names: list[str], *, every_ms: int = 3_600_000, late: str = "1 hour", signal: tuple[int, int, float] = (5, 20, 20.0), start: str | None = None) -> DataFrame:
    """Positions of a stream of ``universe, ts, asset, value`` ticks, one row per completed window.

    The mean tick of each asset in a window is its price. Where ticks have a column ``mu``, its mean is
    the asset's signal, missing as 0; otherwise the signal is momentum. A window closes when the
    watermark passes its end; windows then step in time order and later ticks for them are dropped.
    State holds the engine's sums, the last prices of the signal and the sums of open windows, so it is
    bounded by the lateness, and it recovers from the query's checkpoint. With ``start`` a universe
    begins with the state that :func:`save_states` wrote there, after the last timestamp of its history.
    """
    own = "mu" in ticks.columns
    rows = ticks.withWatermark("ts", late).select("universe", "ts", "asset", "value", *["mu"] * own)
    run = _tick_function(cfg, names, every_ms, signal, own, start)
    return rows.groupBy("universe").applyInPandasWithState(run, OUT, "engine string, windows string", "append", GroupStateTimeout.EventTimeTimeout)


def _state_file(path: str, universe: str) -> tuple:
    fs, top = _filesystem(path)
    return fs, top, f"{top}/{quote(universe, safe='')}.json"


def _saved_state(path: str, universe: str) -> str:
    fs, _, at = _state_file(path, universe)
    if fs.get_file_info(at).type.name == "NotFound":
        return ""
    with fs.open_input_file(at) as f:
        return f.read().decode()


def save_states(states: DataFrame, path: str) -> int:
    """Writes what :func:`warm_up` made, a file for each universe, from the executors; ``path`` must be shared by all. Returns their number."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for universe, state in zip(pdf.universe, pdf.state, strict=True):
                fs, top, at = _state_file(path, universe)
                fs.create_dir(top, recursive=True)
                own = f"{at}.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as f:
                    f.write(state.encode())
                fs.move(own, at)  # whole, also when a task is repeated
            yield pd.DataFrame({"n": [len(pdf)]})

    return states.select("universe", "state").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def replay(rows: DataFrame, cfg: EngineConfig, *, signal: tuple[int, int, float] = (5, 20, 20.0)) -> DataFrame:
    """The same steps over a bounded table ``universe, ts, price`` and maybe ``mu``: one ordered pass per universe."""

    def once(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stepper = Stepper(cfg, signal)
        own = "mu" in pdf.columns
        out = [stepper(key[0], r.ts, np.array(r.price, float), np.array(r.mu, float) if own else None) for r in pdf.sort_values("ts").itertuples(index=False)]
        return pd.DataFrame(out, columns=COLUMNS)

    return rows.groupBy("universe").applyInPandas(once, OUT)


def warm_up(rows: DataFrame, cfg: EngineConfig, *, signal: tuple[int, int, float] = (5, 20, 20.0)) -> DataFrame:
    """``universe, state``: the saved state after a bounded table, one row per universe."""

    def once(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stepper = Stepper(cfg, signal)
        own = "mu" in pdf.columns
        for r in pdf.sort_values("ts").itertuples(index=False):
            stepper(key[0], r.ts, np.array(r.price, float), np.array(r.mu, float) if own else None)
        return pd.DataFrame([(key[0], stepper.save())], columns=["universe", "state"])

    return rows.groupBy("universe").applyInPandas(once, "universe string, state string")
