from __future__ import annotations

import json
import logging

import pytest

from plumbline.deprecation import warn_deprecated
from plumbline.log import JsonFormatter


def test_json_log_lines():
    r = logging.makeLogRecord({"name": "n", "levelname": "WARNING", "msg": "short_window", "rows": 3, "bad": float("nan"), "deep": {"x": [float("inf")]}})
    d = json.loads(JsonFormatter().format(r))
    assert (d["event"], d["level"], d["logger"], d["rows"], d["bad"], d["deep"]) == ("short_window", "WARNING", "n", 3, "nan", {"x": ["inf"]})


def test_deprecation_warning():
    with pytest.warns(DeprecationWarning, match="old is deprecated since 1.0 and goes in 2.0; use new"):
        warn_deprecated("old", since="1.0", remove_in="2.0", replacement="new")


def test_report(spark, tmp_path):
    from plumbline.plans.catalog import engine
    from plumbline.report import ConfigReport

    path = ConfigReport(engine(spark, "/root/testdata/sf0.001", "p2")).save(tmp_path / "a" / "page", "A <title>")
    text = path.read_text()
    assert path.name == "page.html"
    assert "A &lt;title&gt;" in text and "<svg" in text and "position_scale" in text
