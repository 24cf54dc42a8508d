"""What a report may be asked for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones


@dataclass(frozen=True)
class Options:
    tz: str = "UTC"
    idle_minutes: int = 15
    since_ms: int | None = None
    until_ms: int | None = None
    redact: bool = False
    plan_name: str | None = None
    plan_usd_per_month: float | None = None
    cleanup_period_days: int | None = None
    stats_cache_days: tuple[str, ...] | None = None
    project_rules: tuple[tuple[str, str], ...] = ()
    price_overrides: dict = field(default_factory=dict)

    @property
    def idle_ms(self) -> int:
        return self.idle_minutes * 60_000


def check_zone(tz: str) -> str:
    """The zone itself, or an error for one that isn't known."""
    if tz == "UTC" or re.fullmatch(r"[+-]\d{2}:\d{2}", tz) or tz in available_timezones():
        return tz
    raise ValueError(f"unknown time zone: {tz}")


def day_bound(day: str, tz: str, last: bool = False) -> int:
    """Epoch milliseconds of local midnight; ``last`` takes in the whole day."""
    at = datetime.strptime(day, "%Y-%m-%d") + timedelta(days=int(last))
    if m := re.fullmatch(r"([+-])(\d{2}):(\d{2})", tz):
        shift = timedelta(hours=int(m[2]), minutes=int(m[3])) * (1 if m[1] == "+" else -1)
        return int((at.replace(tzinfo=UTC) - shift).timestamp() * 1000)
    return int(at.replace(tzinfo=ZoneInfo(tz)).timestamp() * 1000)
