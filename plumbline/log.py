"""One JSON object per log record, for log collectors."""

from __future__ import annotations

import datetime
import json
import logging
import math

_OWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


def _plain(x):
    if isinstance(x, float) and not math.isfinite(x):
        return str(x)  # JSON has no NaN and no infinity
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


class JsonFormatter(logging.Formatter):
    """``timestamp, level, logger, event`` and whatever ``extra`` a record carries."""

    def format(self, record: logging.LogRecord) -> str:
        out = {
            "timestamp": datetime.datetime.fromtimestamp(record.created, datetime.UTC).isoformat(), "level": record.levelname, "logger": record.name, "event": record.getMessage(),
        }
        out |= {k: _plain(v) for k, v in vars(record).items() if k not in _OWN}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out)
