"""Structured log lines: JSON or text; errors go to stderr."""

from __future__ import annotations

import json
import sys
import time
from typing import Any

LEVELS = ("debug", "info", "warning", "error")


class Log:
    def __init__(self, form: str = "json", level: str = "info", **bound: Any):
        self.form, self.level, self.bound = form, level, bound

    def bind(self, **more: Any) -> Log:
        return Log(self.form, self.level, **{**self.bound, **more})

    def _write(self, level: str, message: str, fields: dict[str, Any]) -> None:
        if LEVELS.index(level) < LEVELS.index(self.level):
            return
        row = {"time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "level": level, "message": message, **self.bound, **fields}
        if self.form == "json":
            text = json.dumps(row, default=str)
        else:
            text = " ".join([row.pop("time"), row.pop("level").upper(), row.pop("message"), *[f"{k}={v}" for k, v in row.items()]])
        print(text, file=sys.stderr if level == "error" else sys.stdout, flush=True)

    def debug(self, message: str, **fields: Any) -> None:
        self._write("debug", message, fields)

    def info(self, message: str, **fields: Any) -> None:
        self._write("info", message, fields)

    def warning(self, message: str, **fields: Any) -> None:
        self._write("warning", message, fields)

    def error(self, message: str, **fields: Any) -> None:
        self._write("error", message, fields)
