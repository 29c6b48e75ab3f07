"""Log lines of ``key=value`` pairs in UTC."""

from __future__ import annotations

import logging
import time


class KeyValues(logging.Formatter):
    converter = time.gmtime

    def format(self, record: logging.LogRecord) -> str:
        parts = {
            "ts": self.formatTime(record, "%Y-%m-%dT%H:%M:%SZ"),
            "level": record.levelname,
            "logger": record.name,
            "msg": record.getMessage(),
        } | getattr(record, "pairs", {})
        line = " ".join(f'{k}="{v}"' if " " in str(v) else f"{k}={v}" for k, v in parts.items())
        return line + (f"\n{self.formatException(record.exc_info)}" if record.exc_info else "")


def setup(level: str = "INFO") -> None:
    handler = logging.StreamHandler()
    handler.setFormatter(KeyValues())
    root = logging.getLogger("tidemark")
    root.handlers[:] = [handler]
    root.setLevel(level.upper())


def event(log: logging.Logger, message: str, **pairs: object) -> None:
    log.info(message, extra={"pairs": pairs})
