"""Errors by code. Messages never hold filter values, so that these stay out of logs."""

from __future__ import annotations

CODES = ("CONFIG", "FORMAT_VERSION", "DEPLOY_INTEGRITY", "NETWORK", "CORRUPT_DATA", "LIMIT_EXCEEDED", "NEEDS_PRUNING", "ABORTED")


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code = code


class DriftError(EngineError):
    """Data that do not fit the schema. `report` has a row for each field and fault."""

    def __init__(self, message: str, report: list[dict]):
        super().__init__("CORRUPT_DATA", message)
        self.report = report
