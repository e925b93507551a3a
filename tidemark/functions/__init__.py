"""Column expressions of the rules. Times are local wall-clock seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DAY, Config

#: What is stripped from texts, time of day, bounds of reply lengths, weekday names.
BLANK = "[\\s　\u0085   -     ]"
HHMM = "^([01][0-9]|2[0-3]):[0-5][0-9]$"
SHORT, LONG = 10, 80
WEEKDAYS = "월화수목금토일"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def reply_length(text: Column) -> Column:
    n = F.length(strip(text))
    return F.when(n <= SHORT, "short").when(n >= LONG, "long").otherwise("normal")


def delay_minutes(sent: Column, replied: Column) -> Column:
    return F.floor((replied - sent) / 60)


def day_start(ts: Column) -> Column:
    return ts - F.pmod(ts, F.lit(DAY))


def slot_start(ts: Column, slot: int) -> Column:
    """Slots are multiples of the interval since local midnight, where they start anew."""
    within = F.pmod(ts, F.lit(DAY))
    return ts - within + within - F.pmod(within, F.lit(slot))


def next_slot(ts: Column, slot: int) -> Column:
    return F.least(slot_start(ts, slot) + slot, day_start(ts) + DAY)


def crossed(before: Column, now: Column, at: Column) -> Column:
    return (before < at) & (at <= now)


def minutes(hhmm: Column) -> Column:
    part = F.split(hhmm, ":")
    return part[0].cast("int") * 60 + part[1].cast("int")


def is_hhmm(c: Column) -> Column:
    return F.coalesce(c.rlike(HHMM), F.lit(False))


def in_hours(ts: Column, start: Column, end: Column) -> Column:
    """start <= time < end, across midnight if start > end; in minutes of the day."""
    t = F.pmod(ts, F.lit(DAY)) / 60
    return F.when(start <= end, (t >= start) & (t < end)).otherwise((t >= start) | (t < end))


def seconds_of(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * DAY


def date_of(ts: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / DAY).cast("int"))


def shown_time(ts: Column) -> Column:
    """`2026-09-29 (화) 19:00`."""
    day, m = date_of(ts), F.floor(F.pmod(ts, F.lit(DAY)) / 60)
    return F.concat(day.cast("string"), F.lit(" ("), F.substring(F.lit(WEEKDAYS), F.weekday(day) + 1, F.lit(1)), F.lit(") "), F.format_string("%02d:%02d", F.floor(m / 60), m % 60))


def duration_seconds(text: Column) -> Column:
    """Sum of the parts of `1h30m`; null if there are none."""
    part = lambda unit: F.aggregate(F.regexp_extract_all(text, F.lit(f"([0-9]+)\\s*{unit}"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return F.when(text.rlike("[0-9]\\s*[hms]"), part("h") * 3600 + part("m") * 60 + part("s"))


def base_max(frequency: Column, cfg: Config) -> Column:
    return F.when(frequency == "low", min(cfg.low_max, cfg.max_per_day)).when(frequency == "high", cfg.max_per_day + cfg.high_extra).otherwise(cfg.max_per_day)


def daily_max(frequency: Column, rate: Column, samples: Column, cfg: Config) -> Column:
    """The first backoff rule whose bound lies above the rate caps the base."""
    cap = F.lit(None).cast("int")
    for below, most in reversed(cfg.backoff):
        cap = F.when(rate < below, most).otherwise(cap)
    return F.least(base_max(frequency, cfg), F.when(samples >= cfg.backoff_samples, cap))


def matches_forgotten(text: Column, phrase: Column) -> Column:
    """Either holds the other, both stripped; an empty phrase matches nothing."""
    t, p = strip(text), strip(phrase)
    return (p != "") & (t.contains(p) | p.contains(t))
