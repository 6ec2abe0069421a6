"""Logging as text or JSON lines."""

from __future__ import annotations

import json
import logging

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "msg": record.getMessage()}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False)


def configure(level: str = "info", form: str = "text") -> logging.Logger:
    """The engine's logger at one of LEVELS."""
    log, handler = logging.getLogger("crestline"), logging.StreamHandler()
    handler.setFormatter(JsonFormatter() if form == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    log.handlers, log.propagate = [handler], False
    log.setLevel(LEVELS[level])
    return log
