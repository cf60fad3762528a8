"""Typed settings.  One frozen object is passed to the operators instead of module constants."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    tolerance_deposit: int = 90
    tolerance_withdraw: int = 180
    minute_tolerance: int = 60
    untimed_window: int = 86400
    time_diff_horizon: int = 3600
    near_fraction: float = 0.6
    duplicate_floor: int = 120
    critical_above: int = 10000
    late_night_sec: int = 82800
    # business rules
    amount_tolerance: float = 1
    dup_window_sec: int = 300
    large_threshold: float = 100000
    large_withdraw_only: bool = True
    # review
    diff_alert: float = 1
    daily_cutoff: str = "17:00"
    daily_respond_hours: int = 24
    cycle_respond_days: int = 3
    # ingest
    filter_carry_forward: bool = True
    pm_success_only: bool = True
    close_time: str = "10:00:00"
    close_day_offset: int = 1
    timezone: str = "Asia/Bangkok"
    max_attempts: int = 3
    default_company: str = "SYS123"
    # A matched gateway pair has no bank account in the master list; exempt it unless asked not to.
    exempt_gateway_from_master: bool = True
    # Local timestamp ("2026-08-01 05:00:00") the case age is measured at; None = end of the business day.
    as_of: str | None = None
    # Rows after which a matching unit ends at the next time slice.
    unit_rows: int = 200_000
    # Rows up to which a lane with rows without time is one unit, and units of a lane that exchange rows are joined.
    walk_rows: int = 200_000

    @property
    def widest_tolerance(self) -> int:
        return max(self.tolerance_deposit, self.tolerance_withdraw, self.minute_tolerance)
