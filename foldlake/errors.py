"""One error class; the code tells what went wrong."""

from __future__ import annotations

CODES = ("InvalidConfig", "SchemaError", "UnsatisfiablePredicate", "Conflict", "NotFound", "InvalidResponse", "Internal")


class EngineError(Exception):
    def __init__(self, code: str, message: str, issues: list | None = None, retriable: bool = False):
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.issues, self.retriable = code, message, issues or [], retriable
