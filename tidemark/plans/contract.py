"""What a decider answers: strict JSON, its checks, and texts for it."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import date_of, seconds_of, strip
from ..schemas import CHAT, MESSAGE_TYPES, PROACTIVE, REFLECTION, REVIEW

SCHEMAS = {"proactive": PROACTIVE, "chat": CHAT, "reflection": REFLECTION, "review": REVIEW}
#: Chapters of the core text, the answer when there is none, and bounds.
CORE_CHAPTERS = frozenset({1, 2, 3, 4, 10, 11, 12, 16})
FALLBACK = "앗, 잠깐 말이 꼬였어. 한 번만 다시 말해줄래?"
QUIET_DAYS = 30
FREQUENCIES = ("low", "normal", "high")
#: An ISO date, time of day and offset.
ISO_TIME = "^\\s*([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ]([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?)?(Z|([+-])([0-9]{2}):?([0-9]{2})?)?)?\\s*$"


def keys(purpose: str) -> list[str]:
    depth, found, part = 0, [], ""
    for ch in SCHEMAS[purpose][7:-1] + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            found.append(part.split(":")[0])
            part = ""
        else:
            part += ch
    return found


def parsed(text: Column, purpose: str, strict: bool = True) -> Column:
    """The answer as a struct; null if it is no object, or (strict) keys lack or are too many."""
    have = F.json_object_keys(text)
    fine = have.isNotNull()
    if strict:
        fine = fine & (F.array_sort(have) == F.array_sort(F.lit(keys(purpose))))
    return F.when(fine, F.from_json(text, SCHEMAS[purpose]))


def outcome(answer: Column, error: Column, previous_type: Column) -> Column:
    """struct(decision, reason, message_type, message) of a proactive answer."""
    message, reason = F.coalesce(strip(answer["message"]), F.lit("")), F.coalesce(answer["reason"], F.lit(""))
    skip = (
        F.when(error.isNotNull() | answer.isNull(), "llm_error")
        .when(F.coalesce(answer["decision"], F.lit("")) != "SEND", F.when(reason == "", "model_skip").otherwise(reason))
        .when((message == "") | ~F.coalesce(answer["message_type"].isin(*MESSAGE_TYPES), F.lit(False)), "invalid_output")
        .when(answer["message_type"] == previous_type, "repeat_type")
    )
    sent = skip.isNull()
    return F.struct(F.when(sent, "SEND").otherwise("SKIP").alias("decision"), F.coalesce(skip, reason).alias("reason"), F.when(sent, answer["message_type"]).alias("message_type"), F.when(sent, message).alias("message"))


def chat_text(answer: Column, error: Column) -> Column:
    text = strip(answer["message"])
    return F.when(error.isNull() & (text != ""), text).otherwise(FALLBACK)


def iso_seconds(text: Column, zone: str = "UTC") -> Column:
    """Local seconds in zone of an ISO date or time; with an offset it is brought to the zone, without one it is local already."""
    part = lambda i: F.regexp_extract(text, ISO_TIME, i)
    number = lambda i: F.coalesce(F.try_to_number(part(i), F.lit("99")), F.lit(0)).cast("long")
    day = F.try_to_date(part(1), "yyyy-MM-dd")
    local = seconds_of(day) + number(2) * 3600 + number(3) * 60 + number(4)
    shift = F.when(part(6) == "-", -1).otherwise(1) * (number(7) * 3600 + number(8) * 60)
    there = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(local - shift), zone))
    fine = text.rlike(ISO_TIME) & (number(2) < 24) & (number(3) < 60) & (number(4) < 60) & (number(7) < 24) & (number(8) < 60)
    return F.when(fine, F.when(part(5) == "", local).otherwise(there))


def iso_text(ts: Column, zone: str = "UTC") -> Column:
    """`2026-09-29T19:00:00+09:00` of local seconds; an hour that a zone has twice is taken as its first."""
    utc = F.to_utc_timestamp(F.timestamp_seconds(ts), zone)
    shift = F.floor((ts - F.unix_seconds(utc)) / 60)
    clock = F.pmod(ts, F.lit(86400))
    shown = F.format_string("%sT%02d:%02d:%02d%s%02d:%02d", date_of(ts).cast("string"), F.floor(clock / 3600), F.floor(clock / 60) % 60, clock % 60, F.when(shift < 0, "-").otherwise("+"), F.floor(F.abs(shift) / 60), F.abs(shift) % 60)
    return F.when(ts.isNotNull(), shown)


def quiet_until(text: Column, now: Column, zone: str = "UTC") -> Column:
    """Local seconds of an ISO date or time; past or unreadable: null; 30 days ahead at most."""
    at = iso_seconds(text, zone)
    return F.when(at > now, F.least(at, now + QUIET_DAYS * 86400))


def effects(turns: DataFrame, zone: str = "UTC") -> DataFrame:
    """What chat turns (user_id, seq, ts, text, answer, error) do: rows (user_id, seq, step, effect, value), in order of seq and step.

    answer: the decider's JSON. A command other than forget and list, a quiet time that is past or unreadable
    and an unknown frequency have no row. The listing is appended to the reply by whoever delivers it.
    """
    a = parsed(F.col("answer"), "chat", strict=False)
    t = turns.withColumn("a", F.when(F.col("error").isNull(), a))
    action = F.col("a.memory_command.action")
    step = lambda n, name, value, when=F.lit(True): F.when(when, F.struct(F.lit(n).alias("step"), F.lit(name).alias("effect"), value.cast("string").alias("value")))
    quiet, reply = quiet_until(F.col("a.do_not_disturb_until"), F.col("ts"), zone), chat_text(F.col("a"), F.col("error"))
    rows = F.array(
        step(1, "store_user", F.col("text")), step(2, "track_reaction", F.col("ts")),
        step(3, "forget", F.to_json(F.struct(F.coalesce("a.memory_command.target", F.lit("")).alias("target"), F.coalesce("a.memory_command.target_ids", F.array()).alias("target_ids"))), action == "forget"),
        step(3, "list", F.lit(None), action == "list"),
        step(4, "quiet_until", quiet, quiet.isNotNull()), step(5, "frequency", F.col("a.preferred_frequency"), F.col("a.preferred_frequency").isin(*FREQUENCIES)),
        step(6, "send", reply), step(7, "store_reply", reply), step(8, "track_continuation", F.col("ts")),
    )
    return t.select("user_id", "seq", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("e")).select("user_id", "seq", "e.*")


def frequencies(effects: DataFrame) -> DataFrame:
    """(user_id, preferred_frequency): the last that was set."""
    return effects.filter("effect = 'frequency'").groupBy("user_id").agg(F.max_by("value", "seq").alias("preferred_frequency"))


def exploded(reflections: DataFrame) -> dict[str, DataFrame]:
    """Reflections (user_id, date, data) as rows of events, resolved, states and updates; n counts from 0 in each list."""
    r = reflected(reflections).filter("r is not null")
    one = lambda field: r.select("user_id", "date", F.posexplode(f"r.{field}").alias("n", "x"))
    return {
        "events": one("important_events").select("user_id", "date", "n", F.col("x.summary").alias("summary"), F.col("x.related_date").alias("related_text"), F.col("x.importance").alias("importance_text")),
        "resolved": one("resolved_episode_ids").select("user_id", F.col("x").alias("id")).filter("id is not null").distinct(),
        "states": one("current_state").select("user_id", "date", "n", strip(F.col("x.statement")).alias("statement"), F.col("x.expires_in_days").alias("days_text")).filter("statement <> ''"),
        "updates": one("hypothesis_updates").select("user_id", "date", "n", "x.*"),
    }


def reflected(reflections: DataFrame) -> DataFrame:
    """Reflections (user_id, date, data) with the answer's struct in `r`."""
    return reflections.withColumn("r", parsed(F.col("data"), "reflection", strict=False))


def core_text(text: str, chapters: frozenset[int] = CORE_CHAPTERS) -> str:
    """Chosen chapters of a Markdown text; all of it if no heading has a number."""
    pieces = re.split(r"(?m)^(?=#{1,3}\s*\d+\s*(?:\.|장))", text)
    number = [re.match(r"#{1,3}\s*(\d+)", p) for p in pieces]
    if not any(number):
        return text.strip()
    return "\n\n".join(p.strip() for p, m in zip(pieces, number) if m and int(m[1]) in chapters)


def load_core(path: str | Path) -> str:
    path = Path(path)
    return core_text(path.read_text(encoding="utf-8")) if path.exists() else ""


def prompt(core: str, instruction: str) -> str:
    return f"{core}\n\n---\n\n{instruction}" if core else instruction
