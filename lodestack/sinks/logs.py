"""Structured logs on the driver: JSON or human, with extras that can't collide with a record's own fields."""

from __future__ import annotations

import json
import logging
import sys

_OWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


def _extras(r: logging.LogRecord) -> dict:
    return {k: v for k, v in vars(r).items() if k not in _OWN}


class JsonFormatter(logging.Formatter):
    def format(self, r: logging.LogRecord) -> str:
        out = {"ts": self.formatTime(r), "level": r.levelname, "logger": r.name, "event": r.getMessage(), **_extras(r)}
        if r.exc_info:
            out["error"] = self.formatException(r.exc_info)
        return json.dumps(out, default=str)


class HumanFormatter(logging.Formatter):
    def format(self, r: logging.LogRecord) -> str:
        tail = " ".join("=".join((k, str(v))) for k, v in _extras(r).items())
        return f"{self.formatTime(r)} {r.levelname:7} {r.name} {r.getMessage()}" + (f" [{tail}]" if tail else "") + (f"\n{self.formatException(r.exc_info)}" if r.exc_info else "")


class SafeExtra(logging.LoggerAdapter):
    """Extras named like a record's own field get an underscore at the end."""

    def process(self, msg, kwargs):
        safe = {k + "_" if k in _OWN else k: v for k, v in (kwargs.get("extra") or {}).items()}
        return msg, kwargs | {"extra": safe}


def get_logger(name: str) -> SafeExtra:
    return SafeExtra(logging.getLogger(name), {})


def configure(level: str = "INFO", as_json: bool = False) -> None:
    h = logging.StreamHandler(sys.stderr)
    h.setFormatter(JsonFormatter() if as_json else HumanFormatter())
    root = logging.getLogger()
    root.handlers[:] = [h]
    root.setLevel(level.upper())
