"""Ranked context: what a decider is shown for each user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions import WEEKDAYS, shown_time
from .scans import live


#: Keys that are left out without a value. Within a JSON string a quote has a backslash before it, so no text matches.
OPTIONAL = ',"(related_date|sensitive|forgotten)":null'


def rank_episodes(episodes: DataFrame, k: int) -> DataFrame:
    """Open before resolved, then importance, then newest; ties: larger id."""
    importance = F.when(F.col("importance") == "high", 0).when(F.col("importance") == "mid", 1).otherwise(2)
    w = Window.partitionBy("user_id").orderBy("resolved", importance, F.desc("date"), F.desc("id"))
    return episodes.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)


def unresolved_near(episodes: DataFrame, today, days: int = 2) -> DataFrame:
    return episodes.filter(~F.col("resolved") & (F.abs(F.datediff("related_date", today)) <= days))


def rank_hypotheses(hypotheses: DataFrame, k: int, with_sensitive: bool) -> DataFrame:
    """By level, then last seen; ties: smaller id."""
    level = F.when(F.col("level") == "confirmed", 0).when(F.col("level") == "repeated", 1).otherwise(2)
    w = Window.partitionBy("user_id").orderBy(level, F.desc_nulls_last("last_seen"), "id")
    pool = hypotheses if with_sensitive else hypotheses.filter(~F.col("sensitive"))
    return pool.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)


def last_two(types):
    """The last two of an array, or all of a shorter one."""
    return F.slice(types, F.greatest(F.size(types) - 1, F.lit(1)), 2)


def documents(users: DataFrame, messages: DataFrame, episodes: DataFrame, hypotheses: DataFrame, states: DataFrame, sent: DataFrame, forgotten: DataFrame, as_of: int, purpose: str, cfg: Config) -> DataFrame:
    """(user_id, context): one JSON document for each user. messages: user_id, id, ts, sender, text."""
    now, today = F.lit(as_of).cast("long"), as_of - as_of % 86400
    date = F.date_add(F.lit("1970-01-01").cast("date"), as_of // 86400)
    clock = lambda ts: F.format_string("%02d:%02d", F.floor(F.pmod(ts, F.lit(86400)) / 3600), F.floor(F.pmod(ts, F.lit(3600)) / 60))

    def gather(rows, order, fields, name):
        """Ranked rows only, at most a fixed number for each user."""
        got = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("v")))).alias("g"))
        return got.select("user_id", F.transform("g", lambda x: x["v"]).alias(name))

    dated = F.concat(F.col("related_date").cast("string"), F.lit(" ("), F.substring(F.lit(WEEKDAYS), F.weekday("related_date") + 1, F.lit(1)), F.lit(")")).alias("related_date")
    shown = ["id", F.col("date").cast("string").alias("date"), "summary", "resolved", dated]
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    seen = messages.filter(F.col("ts") <= as_of)
    tail = seen.filter(F.col("ts") >= today).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cfg.recent_messages)
    last = seen.groupBy("user_id").agg(F.max(F.struct("ts", "id", "sender")).alias("last"))
    alive = live(episodes, as_of)
    near = rank_episodes(unresolved_near(alive, date), 1 << 30)
    recent = sent.withColumn("n", F.row_number().over(w)).filter("n <= 5")
    count = sent.filter(F.col("ts") >= today).groupBy("user_id").agg(F.count(F.lit(1)).alias("today_n"))
    out = users.select("user_id").distinct().join(last, "user_id", "left").join(count, "user_id", "left")
    order_desc = [(-F.col("n")).alias("o")]
    parts = (
        (gather(tail, order_desc, [clock(F.col("ts")).alias("at"), F.col("sender").alias("by"), "text"], "today_messages"), "today_messages"),
        (gather(rank_episodes(alive, cfg.max_episodes), ["n"], shown, "recent_episodes"), "recent_episodes"),
        (gather(near, ["n"], shown, "unresolved_topics"), "unresolved_topics"),
        (gather(live(states, as_of), [(-F.col("created_at")).alias("o"), (-F.col("id")).alias("o2")], ["statement"], "current_state"), "current_state"),
        (gather(rank_hypotheses(hypotheses, cfg.max_hypotheses, purpose == "chat"), ["n"], ["id", "statement", "level", F.when(F.col("sensitive"), True).alias("sensitive")], "hypotheses"), "hypotheses"),
        (gather(recent, order_desc, [F.col("message_type").alias("type"), shown_time(F.col("ts")).alias("at"), "replied"], "recent_proactive"), "recent_proactive"),
        (gather(forgotten, ["id"], ["text"], "forgotten"), "forgotten"),
    )
    for rows, _ in parts:
        out = out.join(rows, "user_id", "left")
    none = lambda name: F.coalesce(F.col(name), F.array())
    doc = F.struct(
        shown_time(now).alias("now"), shown_time(F.col("last.ts")).alias("last_message_at"), F.col("last.sender").alias("last_message_by"),
        none("today_messages").alias("today_messages"), none("recent_episodes").alias("recent_episodes"), none("unresolved_topics").alias("unresolved_topics"),
        F.transform(none("current_state"), lambda x: x["statement"]).alias("current_state"), none("hypotheses").alias("hypotheses"), none("recent_proactive").alias("recent_proactive"),
        F.coalesce("today_n", F.lit(0)).alias("today_proactive_count"), last_two(F.transform(none("recent_proactive"), lambda x: x["type"])).alias("last_message_types"),
        F.transform("forgotten", lambda x: x["text"]).alias("forgotten"),
    )
    text = F.to_json(doc, {"ignoreNullFields": "false"})  # keys stay, but for those that only some objects have
    return out.select("user_id", F.regexp_replace(text, OPTIONAL, "").alias("context"))
