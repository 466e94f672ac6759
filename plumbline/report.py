"""A self-contained HTML page about an engine's settings: parameters, a sweep over shrinkage, status counts.

It is made on the driver from a few dozen collected rows.
"""

from __future__ import annotations

import dataclasses
import html
from pathlib import Path

from .config import EngineConfig
from .operators import diagnostics, sweeps
from .operators.engine import Engine


def _table(head: list[str], rows: list[tuple]) -> str:
    cells = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape(f'{x:.6g}' if isinstance(x, float) else str(x))}</{tag}>" for x in r) + "</tr>"
    return f"<table>{cells('th', head)}{''.join(cells('td', r) for r in rows)}</table>"


def _line(points: list[tuple[float, float]], mark: float, width: int = 640, height: int = 240) -> str:
    """The sweep as an inline SVG line with a mark at the current weight."""
    known = [p for p in points if p[1] is not None]
    if len(known) < 2:
        return "<p>Too few values for a chart.</p>"
    lo, hi = min(y for _, y in known), max(y for _, y in known)
    px = lambda x: 40 + x * (width - 60)
    py = lambda y: height - 30 - (y - lo) / ((hi - lo) or 1) * (height - 60)
    path = " ".join(f"{px(x):.1f},{py(y):.1f}" for x, y in known)
    return (
        f'<svg width="{width}" height="{height}" role="img" aria-label="Sharpe ratio by shrinkage"><polyline fill="none" stroke="#1f6feb" stroke-width="2" points="{path}"/>'
        f'<line x1="{px(mark):.1f}" x2="{px(mark):.1f}" y1="20" y2="{height - 30}" stroke="#999" stroke-dasharray="4"/>'
        f'<text x="2" y="{py(hi):.0f}">{hi:.2f}</text><text x="2" y="{py(lo):.0f}">{lo:.2f}</text></svg>'
    )


#: Advice by the ratio of assets to the observations that the correlation window holds.
GUIDE = (("below 0.1", "0.7 to 0.9", "many observations: the sample matrix is trusted"), ("0.1 to 0.5", "0.4 to 0.7", "moderate: noise and structure are balanced"), ("above 0.5", "0.1 to 0.4", "few observations: stay close to the identity"))
THEORY = "A correlation matrix estimated from few observations spreads its eigenvalues too far, and its inverse trades on the smallest ones. Mixing it with the identity pulls all eigenvalues towards one: weight 1 keeps the estimate, weight 0 treats assets as unrelated."


class ConfigReport:
    """Settings alone, or with an engine also its sweep over shrinkage and its status counts."""

    def __init__(self, engine: Engine | None = None, *, cfg: EngineConfig | None = None):
        self.engine, self.cfg = engine, cfg or engine.cfg

    def _measured(self) -> str:
        try:
            sweep = sorted((r.shrink, r.sharpe) for r in sweeps.lambda_sweep(self.engine.panel, self.cfg).collect())
            body = _line(sweep, self.cfg.shrink) + _table(["shrink", "sharpe"], sweep)
        except Exception as e:  # a report without its chart is better than none
            body = f"<p>The sweep is not available: {html.escape(type(e).__name__)}</p>"
        counts = [(r.status, r.n) for r in diagnostics.status_counts(self.engine.solution).orderBy("status").collect()]
        return f"<h2>Sharpe ratio by shrinkage</h2>{body}<h2>Rows by status</h2>{_table(['status', 'rows'], counts)}"

    def to_html(self, title: str = "Engine settings") -> str:
        settings = [(f.name, getattr(self.cfg, f.name)) for f in dataclasses.fields(self.cfg)]
        derived = [(n, getattr(self.cfg, n)) for n in ("covariance_mode", "window", "n_factors", "beta_vola", "beta_corr")]
        guide = _table(["assets / corr", "shrink", "why"], list(GUIDE)) + f"<p>{THEORY}</p>"
        style = "body{font:15px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}"
        return (
            f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>"
            f"<h2>Settings</h2>{_table(['name', 'value'], settings + derived)}<h2>Shrinkage</h2>{guide}{self._measured() if self.engine else ''}</body></html>"
        )

    def save(self, path: str | Path, title: str = "Engine settings") -> Path:
        """Writes the page; adds ``.html`` and makes folders as needed."""
        path = Path(path)
        if path.suffix != ".html":
            path = path.with_name(path.name + ".html")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(self.to_html(title), encoding="utf-8")
        return path
