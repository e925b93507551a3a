"""Simulation with feedback: a SEND changes the gate at the next slot, so slots run one after another.

Rows of one user make one task's group; users run in parallel. The decider is pluggable: a function
of (user_id, now, last type) that gives (message_type, message) or a reason to skip.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from ..config import DAY, Config
from ..schemas import MESSAGE_TYPES
from ..shipping import ship


def in_turn(user_id: int, now: int, last: str | None) -> tuple[str, str] | str:
    """The default decider: kinds of message by the hour, never the last one again."""
    kind = MESSAGE_TYPES[now // 3600 % len(MESSAGE_TYPES)]
    return (kind if kind != last else MESSAGE_TYPES[(now // 3600 + 1) % len(MESSAGE_TYPES)], f"{kind} {now}")


class Feedback:
    """One user's gate over their own past."""

    def __init__(self, cfg: Config, frequency: str = "normal", start: int | None = None, end: int | None = None, quiet: int | None = None):
        self.cfg, self.frequency, self.quiet = cfg, frequency, quiet
        self.start, self.end = cfg.active_start if start is None else start, cfg.active_end if end is None else end
        self.sent: list[list] = []  # [ts, type, replied]
        self.last: int | None = None

    def heard(self, ts: int) -> None:
        for s in self.sent:
            if s[2] is None:
                s[2] = True
        self.last = ts

    def most(self, now: int) -> int:
        cfg = self.cfg
        limit = {"low": min(cfg.low_max, cfg.max_per_day), "high": cfg.max_per_day + cfg.high_extra}.get(self.frequency, cfg.max_per_day)
        past = [s[2] for s in self.sent if s[0] >= now - 7 * DAY and s[2] is not None]
        if len(past) >= cfg.backoff_samples:
            share = sum(past) / len(past)
            limit = min([limit, *[most for below, most in cfg.backoff if share < below][:1]])
        return limit

    def closed(self, now: int) -> str | None:
        cfg, minute = self.cfg, now % DAY / 60
        inside = self.start <= minute < self.end if self.start <= self.end else minute >= self.start or minute < self.end
        today = [s for s in self.sent if s[0] >= now - now % DAY]
        streak = next((i for i, s in enumerate(reversed(today)) if s[2]), len(today))
        rules = (
            (self.quiet is not None and now < self.quiet, "gate_do_not_disturb"), (not inside, "gate_active_hours"), (len(today) >= self.most(now), "gate_daily_max"),
            (self.last is not None and now - self.last < cfg.gap_any, "gate_recent_message"),
            (bool(self.sent) and not self.sent[-1][2] and now - self.sent[-1][0] < cfg.gap_unanswered, "gate_unanswered_wait"), (streak >= cfg.max_unanswered, "gate_consecutive_unanswered"),
        )
        return next((name for hit, name in rules if hit), None)

    def tick(self, user_id: int, now: int, decide: Callable = in_turn) -> tuple[str, str, str | None]:
        for s in self.sent:
            if s[2] is None:
                s[2] = False
        if why := self.closed(now):
            return "SKIP", why, None
        last = self.sent[-1][1] if self.sent else None
        answer = decide(user_id, now, last)
        if isinstance(answer, str):
            return "SKIP", answer or "model_skip", None
        kind, text = answer
        if not text.strip() or kind not in MESSAGE_TYPES:
            return "SKIP", "invalid_output", None
        if kind == last:
            return "SKIP", "repeat_type", None
        self.sent.append([now, kind, None])
        self.last = now
        return "SEND", "", kind


def simulate(messages: DataFrame, ticks: DataFrame, cfg: Config, decide: Callable = in_turn) -> DataFrame:
    """Decisions at ticks (user_id, ts), given the users' messages (user_id, ts)."""
    ship(messages.sparkSession)
    rows = messages.selectExpr("user_id", "ts", "0 as tick").unionByName(ticks.selectExpr("user_id", "ts", "1 as tick"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = Feedback(cfg), []
        for ts, tick in pdf.sort_values(["ts", "tick"])[["ts", "tick"]].itertuples(index=False):
            if tick:
                out.append((key[0], ts, *state.tick(int(key[0]), int(ts), decide)))
            else:
                state.heard(int(ts))
        return pd.DataFrame(out, columns=["user_id", "ts", "decision", "reason", "message_type"])

    return rows.groupBy("user_id").applyInPandas(run, "user_id long, ts long, decision string, reason string, message_type string")
