"""Typed settings from the environment, each with its range."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """What a deployment may set, as LOGMILL_<NAME>; a value that isn't of the type or range is an error."""

    logs_path: str = "logs"
    rejected_path: str = "rejected"
    checkpoint_path: str = "checkpoint"
    files_per_batch: int = 100
    batch_seconds: int = 2
    stall_seconds: int = 60
    retention_enabled: bool = True
    retention_days: int = 30
    retention_seconds: int = 300
    query_seconds: int = 30
    auth_enabled: bool = False
    log_level: str = "info"

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        out = {}
        for f in fields(cls):
            raw = env.get(f"LOGMILL_{f.name.upper()}", "")
            if raw != "":
                out[f.name] = _parse(f.name, type(f.default), raw)
        return cls(**out)


_RANGES = {"files_per_batch": (1, 100_000), "batch_seconds": (1, 3600), "stall_seconds": (1, 86_400), "retention_days": (1, 3650), "retention_seconds": (1, 86_400), "query_seconds": (1, 3600)}


def _parse(name: str, kind: type, raw: str) -> str | int | bool:
    if kind is bool:
        if raw.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{name} must be true or false")
        return raw.lower() in ("true", "1")
    if kind is int:
        least, most = _RANGES[name]
        if not (raw.isascii() and raw.isdigit() and least <= int(raw) <= most):
            raise ValueError(f"{name} must be an integer from {least} to {most}")
        return int(raw)
    if name == "log_level" and raw not in ("debug", "info", "warning", "error"):
        raise ValueError("log_level must be debug, info, warning or error")
    return raw
