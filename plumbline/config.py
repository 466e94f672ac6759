"""Settings of the engine: immutable, checked when made."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field

_KEEP = object()


@dataclass(frozen=True)
class EwmShrink:
    """Exponentially weighted correlation, shrunk towards the identity."""

    mode = "ewm_shrink"


@dataclass(frozen=True)
class SlidingWindow:
    """A factor model on the last ``window`` rows; ``max_components`` caps the factors in streaming."""

    window: int
    n_factors: int
    max_components: int | None = None
    mode = "sliding_window"

    def __post_init__(self) -> None:
        if self.window < 1 or self.n_factors < 1:
            raise ValueError("window and n_factors must be positive")
        if self.max_components is not None and not 1 <= self.max_components <= self.n_factors:
            raise ValueError("max_components must be between 1 and n_factors")


@dataclass(frozen=True)
class EngineConfig:
    """``shrink`` 1 keeps the raw correlation matrix, 0 makes it the identity."""

    vola: int
    corr: int
    clip: float
    shrink: float
    aum: float
    denom_tol: float = 1e-12
    position_scale: float = 1e6
    min_corr_denom: float = 1e-14
    max_nan_fraction: float = 0.9
    covariance: EwmShrink | SlidingWindow = field(default_factory=EwmShrink)
    cost_per_unit: float = 0.0
    max_turnover: float | None = None

    def __post_init__(self) -> None:
        for name in ("vola", "corr", "clip", "aum", "denom_tol", "position_scale", "min_corr_denom"):
            if not (math.isfinite(v := getattr(self, name)) and v > 0):
                raise ValueError(f"{name} must be positive")
        if int(self.vola) != self.vola or int(self.corr) != self.corr:
            raise ValueError("vola and corr must be whole numbers")
        if self.corr < self.vola:
            raise ValueError("corr must be at least vola")
        if not 0 <= self.shrink <= 1:
            raise ValueError("shrink must be between 0 and 1")
        if not 0 < self.max_nan_fraction < 1:
            raise ValueError("max_nan_fraction must lie strictly between 0 and 1")
        if self.cost_per_unit < 0:
            raise ValueError("cost_per_unit must not be negative")
        if self.max_turnover is not None and self.max_turnover <= 0:
            raise ValueError("max_turnover must be positive or None")

    @classmethod
    def make(cls, **given) -> EngineConfig:
        """Like the constructor, with advice for settings that belong to the covariance mode."""
        flat = {"covariance_mode", "n_factors", "window"} & set(given)
        if flat:
            raise TypeError(f"{sorted(flat)} belong to the covariance mode: covariance=SlidingWindow(window=..., n_factors=...)")
        return cls(**given)

    @property
    def covariance_mode(self) -> str:
        return self.covariance.mode

    @property
    def window(self) -> int | None:
        return getattr(self.covariance, "window", None)

    @property
    def n_factors(self) -> int | None:
        return getattr(self.covariance, "n_factors", None)

    @property
    def beta_vola(self) -> float:
        return (self.vola - 1) / self.vola

    @property
    def beta_corr(self) -> float:
        return self.corr / (self.corr + 1)

    @property
    def report(self):
        """The settings as an HTML page, without prices: parameters and advice on the shrinkage weight."""
        from .report import ConfigReport

        return ConfigReport(cfg=self)

    def replace(self, *, max_turnover: float | None | object = _KEEP, **changes) -> EngineConfig:
        """A copy with changes; ``max_turnover=None`` clears the cap, leaving it out keeps it."""
        if max_turnover is not _KEEP:
            changes["max_turnover"] = max_turnover
        return dataclasses.replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self) | {"covariance": {"mode": self.covariance.mode, **dataclasses.asdict(self.covariance)}})

    @classmethod
    def from_json(cls, text: str) -> EngineConfig:
        d = json.loads(text)
        cov = d.pop("covariance")
        mode = cov.pop("mode")
        return cls(**d, covariance=SlidingWindow(**cov) if mode == SlidingWindow.mode else EwmShrink())
