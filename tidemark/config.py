"""Parameters of every rule, and their parsers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from pathlib import Path

DAY = 86_400
_UNITS = {"h": 3600, "m": 60, "s": 1}


def duration_seconds(value: str | int) -> int:
    """Sum of the parts of `1h30m`; a bare number is minutes; text that is no part is ignored."""
    if isinstance(value, int):
        return value * 60
    parts = re.findall(r"(\d+)\s*([hms])", value)
    if not parts:
        raise ValueError(f"no duration in {value!r}")
    return sum(int(n) * _UNITS[u] for n, u in parts)


def minute_of_day(value: str) -> int:
    hours, minutes = value.split(":")
    found = int(hours) * 60 + int(minutes)
    if not 0 <= found < 1440 or not 0 <= int(minutes) < 60:
        raise ValueError(f"no time of day: {value!r}")
    return found


@dataclass(frozen=True)
class Config:
    """Fixed default values of the rules. Times of day are minutes, durations seconds."""

    active_start: int = 540
    active_end: int = 1380
    slot: int = 3600
    timezone: str = "Asia/Seoul"
    max_per_day: int = 4
    low_max: int = 2
    high_extra: int = 2
    gap_any: int = 5400
    gap_unanswered: int = 14_400
    max_unanswered: int = 2
    backoff: tuple[tuple[float, int], ...] = ((0.2, 1), (0.5, 2))
    backoff_samples: int = 3
    reflect_at: int = 1410
    review_weekday: int = 6
    recent_messages: int = 20
    max_episodes: int = 5
    max_hypotheses: int = 8
    paths: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "backoff", tuple(sorted(self.backoff)))


_WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def from_dict(raw: dict, base: Path | None = None) -> Config:
    """Of a nested mapping as a YAML file has it; what is missing keeps its default."""
    hours, limits, ctx = (raw.get(k) or {} for k in ("active_hours", "limits", "context"))
    found: dict = {}
    for key, section, name, parse in (
        ("active_start", hours, "start", minute_of_day), ("active_end", hours, "end", minute_of_day),
        ("slot", raw, "check_interval", duration_seconds), ("timezone", raw, "timezone", str),
        ("max_per_day", limits, "max_proactive_per_day", int), ("gap_any", limits, "min_gap_after_any_message", duration_seconds),
        ("gap_unanswered", limits, "min_gap_after_unanswered", duration_seconds), ("max_unanswered", limits, "max_consecutive_unanswered", int),
        ("reflect_at", raw, "reflection_time", minute_of_day), ("review_weekday", raw, "review_day", lambda d: _WEEKDAYS.index(d.lower())),
        ("recent_messages", ctx, "recent_messages", int), ("max_episodes", ctx, "max_episodes", int), ("max_hypotheses", ctx, "max_hypotheses", int),
    ):
        if section.get(name) is not None:
            found[key] = parse(section[name])
    if raw.get("backoff"):
        found["backoff"] = tuple((float(r["response_rate_below"]), int(r["max_proactive_per_day"])) for r in raw["backoff"])
    paths = {k: str((base or Path()) / v) for k, v in raw.items() if k.endswith("_path")}
    return replace(Config(), **found, paths=paths)


def load(path: str | Path) -> Config:
    import yaml

    path = Path(path)
    return from_dict(yaml.safe_load(path.read_text(encoding="utf-8")) or {}, path.parent)
