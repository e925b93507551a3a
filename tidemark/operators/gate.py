"""The gate: ordered rules over one feature row for each user and instant; the first that fails is the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DAY, Config
from ..functions import daily_max, day_start, in_hours, minutes, slot_start
from .reactions import response_rate, sends, unanswered_today
from .scans import settings_of


def reason(now: Column, cfg: Config) -> Column:
    """Null: the gate is open. Over columns of a feature row."""
    c = F.col
    start = F.coalesce(minutes(c("active_start")), F.lit(cfg.active_start))
    end = F.coalesce(minutes(c("active_end")), F.lit(cfg.active_end))
    waiting = ~F.coalesce(c("last_send_replied"), F.lit(False)) & (now - c("last_send_ts") < cfg.gap_unanswered)
    return (
        F.when(c("do_not_disturb_until") > now, "gate_do_not_disturb")
        .when(~in_hours(now, start, end), "gate_active_hours")
        .when(c("sent_today") >= c("daily_max"), "gate_daily_max")
        .when(now - c("last_ts") < cfg.gap_any, "gate_recent_message")
        .when(waiting, "gate_unanswered_wait")
        .when(c("unanswered") >= cfg.max_unanswered, "gate_consecutive_unanswered")
    )


def features(log: DataFrame, settings: DataFrame, as_of: int, cfg: Config) -> DataFrame:
    """One row for each user of the log up to as_of."""
    sent = sends(log, as_of, cfg)
    heard = log.filter(F.col("ts") <= as_of).groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    own = sent.groupBy("user_id").agg(
        F.max(F.struct("ts", "id", "replied")).alias("l"),
        F.count(F.when(F.col("ts") >= as_of - as_of % DAY, 1)).alias("sent_today"),
        F.count(F.when(F.col("ts") >= as_of - 7 * DAY, 1)).alias("sent_7d"),
    )
    rows = settings_of(heard, settings).join(own, "user_id", "left").join(response_rate(sent, as_of), "user_id", "left").join(unanswered_today(sent, as_of), "user_id", "left")
    rows = rows.select(*settings_of(heard, settings).columns, "rate", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("samples", "sent_today", "sent_7d")), F.coalesce("n", F.lit(0)).alias("unanswered"), F.col("l.ts").alias("last_send_ts"), F.col("l.replied").alias("last_send_replied"))
    return rows.withColumn("daily_max", daily_max(F.col("preferred_frequency"), F.col("rate"), F.col("samples"), cfg))


def check(log: DataFrame, settings: DataFrame, as_of: int, cfg: Config) -> DataFrame:
    return features(log, settings, as_of, cfg).withColumn("reason", reason(F.lit(as_of).cast("long"), cfg))


def slots(log: DataFrame, start: int, end: int, cfg: Config) -> DataFrame:
    """(user_id, ts) for each user and slot boundary in [start, end)."""
    days = F.explode(F.sequence(F.lit(start - start % DAY).cast("long"), F.lit(end - 1).cast("long"), F.lit(DAY).cast("long")))
    within = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DAY - 1).cast("long"), F.lit(cfg.slot).cast("long")))
    users = log.select("user_id").distinct()
    return users.withColumn("day", days).withColumn("at", within).select("user_id", (F.col("day") + F.col("at")).alias("ts")).filter((F.col("ts") >= start) & (F.col("ts") < end))


def before_week(past: DataFrame, cfg: Config) -> DataFrame:
    """Each user's last SEND, with whether it was answered, and last other row: all that later slots need of a log."""
    send, ts = F.col("kind") == "send", F.col("ts")
    slots_ = past.groupBy("user_id", slot_start(ts, cfg.slot).alias("slot")).agg(
        F.max(F.when(send, F.struct("ts", "id"))).alias("s"), F.max(F.when(F.col("kind") == "user", ts)).alias("u"), F.max(F.when(~send, ts)).alias("o")
    )
    # the slot's last SEND is answered if the slot's last user row isn't before it
    answered = F.struct("s.ts", "s.id", F.lit("send").alias("kind"), F.coalesce(F.col("u") >= F.col("s.ts"), F.lit(False)).alias("ok"))
    own = slots_.groupBy("user_id").agg(F.max(F.when(F.col("s").isNotNull(), answered)).alias("s"), F.max("o").alias("o"))
    other = F.struct(F.col("o").alias("ts"), F.lit(0).cast("long").alias("id"), F.lit("other").alias("kind"), F.lit(None).cast("boolean").alias("ok"))
    return own.select("user_id", F.explode(F.filter(F.array(F.col("s"), other), lambda r: r["ts"].isNotNull())).alias("r")).select("user_id", "r.id", "r.ts", "r.kind", "r.ok")


def check_slots(log: DataFrame, settings: DataFrame, start: int, end: int, cfg: Config) -> DataFrame:
    """The gate at every slot boundary against a fixed log: windows over each user's log, no as-of joins.

    At a boundary every earlier SEND is final and one of the same second is pending. Rows from end on are not
    read; those from before the first slot's week are one row or two for each user.
    """
    last, old = 1 << 60, start - start % DAY - 7 * DAY
    near = log.filter((F.col("ts") >= old) & (F.col("ts") < end))
    sent = sends(near, last, cfg).select("user_id", "id", "ts", F.lit("send").alias("kind"), F.coalesce("replied", F.lit(False)).alias("ok"))
    other = near.filter("kind <> 'send'").select("user_id", "id", "ts", "kind", F.lit(None).cast("boolean").alias("ok"))
    ticks = slots(log, start, end, cfg).select("user_id", F.lit(last).alias("id"), "ts", F.lit("tick").alias("kind"), F.lit(None).cast("boolean").alias("ok"))
    rows = sent.unionByName(other).unionByName(before_week(log.filter(F.col("ts") < old), cfg)).unionByName(ticks).withColumn("day", day_start(F.col("ts")))
    send, ok = F.col("kind") == "send", F.col("ok")
    week = Window.partitionBy("user_id").orderBy("ts").rangeBetween(-7 * DAY, -1)
    so_far = Window.partitionBy("user_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    today = Window.partitionBy("user_id", "day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    f = rows.select("user_id", "id", "ts", "kind", "day",
        F.count(F.when(send, 1)).over(week).alias("samples"), F.sum(F.when(send, ok.cast("int"))).over(week).alias("good"),
        F.max(F.when(F.col("kind") != "tick", F.col("ts"))).over(so_far).alias("last_ts"),
        F.max(F.when(send, F.col("ts"))).over(so_far).alias("last_send_ts"),
        F.max(F.when(send, F.struct("ts", "id", "ok"))).over(before).alias("l"), ok.alias("ok"),
        F.count(F.when(send, 1)).over(today).alias("sent_today"))
    # an answer counts once the SEND lies before the tick
    ok_before = F.max(F.when(F.col("ok"), F.struct("ts", "sent_today"))).over(Window.partitionBy("user_id", "day").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("ok_before", ok_before).filter("kind = 'tick'")
    f = f.join(settings, "user_id", "left").withColumn("preferred_frequency", F.coalesce("preferred_frequency", F.lit("normal")))
    f = f.withColumn("rate", F.when(F.col("samples") > 0, F.col("good") / F.col("samples"))).withColumn("unanswered", F.col("sent_today") - F.coalesce("ok_before.sent_today", F.lit(0)))
    f = f.withColumn("last_send_replied", F.when(F.col("l.ts") == F.col("last_send_ts"), F.col("l.ok")))
    f = f.withColumn("daily_max", daily_max(F.col("preferred_frequency"), F.col("rate"), F.col("samples"), cfg))
    return f.select("user_id", "ts", "samples", "rate", "sent_today", "unanswered", "daily_max", reason(F.col("ts"), cfg).alias("reason"))
