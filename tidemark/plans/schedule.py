"""Which jobs a stretch of time (before, now] calls for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DAY, Config
from ..functions import crossed, slot_start


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.pmod(F.floor(ts / DAY) + 3, F.lit(7))


def due(stretches: DataFrame, cfg: Config) -> DataFrame:
    """Stretches (before, now, ...) with the instants of jobs: proactive (now, once however many slots), reflections, reviews."""
    before, now = F.col("before"), F.col("now")
    slot = slot_start(now, cfg.slot)
    today = now - F.pmod(now, F.lit(DAY)) + cfg.reflect_at * 60
    at = F.filter(F.array(today - DAY, today), lambda x: crossed(before, now, x))
    return stretches.withColumn("proactive", F.when(crossed(before, now, slot), now)).withColumn("reflections", at).withColumn("reviews", F.filter(at, lambda x: weekday(x) == cfg.review_weekday))


def reflection_windows(messages: DataFrame, cfg: Config) -> DataFrame:
    """Messages with the reflection day they belong to: [23:30 the day before, 23:30], the last second in both."""
    shift = DAY - cfg.reflect_at * 60
    day = F.floor((F.col("ts") + shift - 1) / DAY)
    again = F.pmod(F.col("ts") + shift, F.lit(DAY)) == 0
    return messages.withColumn("day", F.explode(F.when(again, F.array(day, day + 1)).otherwise(F.array(day)))).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")))
