"""Log lines as JSON objects, one a line."""

from __future__ import annotations

import json
import logging
import sys
from datetime import UTC, datetime

_PLAIN = frozenset(logging.makeLogRecord({}).__dict__) | {"message", "asctime", "taskName"}


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, UTC)
        line = {"time": f"{at:%Y-%m-%dT%H:%M:%S}.{at.microsecond // 1000:03d}Z", "level": record.levelname.lower(), "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k, v in record.__dict__.items() if k not in _PLAIN}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"logmill.{name}")


def to_stderr(level: str = "info") -> None:
    """Send the engine's log lines to stderr."""
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonFormatter())
    top = logging.getLogger("logmill")
    top.handlers[:] = [handler]
    top.setLevel(level.upper())
    top.propagate = False
