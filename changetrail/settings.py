"""Settings of the log as plain arguments."""

from __future__ import annotations

from dataclasses import dataclass

from changetrail import fixed_values as fixed


@dataclass(frozen=True)
class Settings:
    enabled: bool = True                 # gates web requests only; CLI runs are always logged
    retention_days: int = fixed.DEFAULT_RETENTION_DAYS   # zero or less keeps everything
    json_log_enabled: bool = False
    json_log_path: str = ""
    rows_per_page: int = 30              # used when a caller asks for -1 rows
