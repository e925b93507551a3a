"""The engine's relations out of the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DAY
from ..schemas import MESSAGE_TYPES
from .tables import table


def local_seconds(ts: Column) -> Column:
    """Of the wall clock that ts shows; a timestamp without zone is the same in every session."""
    return F.unix_date(F.to_date(ts)).cast("long") * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, id, ts, kind (send, user, assistant), message_type, k."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "view", "send").when(F.col("event_type") == "error", "assistant").otherwise("user")
    types = F.array(*map(F.lit, MESSAGE_TYPES))
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), local_seconds(F.col("ts")).alias("ts"), kind.alias("kind"), k.alias("k"), "event_type")
    return e.select("user_id", "id", "ts", "kind", F.when(F.col("kind") == "send", types[F.col("k") % len(MESSAGE_TYPES)]).alias("message_type"), "k", "event_type")


def settings(spark: SparkSession, sf_dir: str, as_of: int) -> DataFrame:
    """Settings by a rule on user_id, so that every branch of the gate comes up."""
    u, m = table(spark, sf_dir, "events").select("user_id").distinct(), F.col("user_id")
    return u.select("user_id", F.when(m % 7 == 3, "20:00").alias("active_start"), F.when(m % 7 == 3, "11:00").alias("active_end"), F.when(m % 11 == 5, F.lit(as_of + 3600)).when(m % 11 == 6, F.lit(as_of - 60)).alias("do_not_disturb_until"), F.when(m % 3 == 0, "low").when(m % 3 == 1, "normal").otherwise("high").alias("preferred_frequency"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each order: date, related date (first shipping), importance by priority."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ship = li.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
    importance = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "high").when(F.substring("o_orderpriority", 1, 1) == "3", "mid").when(F.substring("o_orderpriority", 1, 1) == "4", "low").otherwise("other")
    return o.join(ship, o.o_orderkey == ship.l_orderkey, "left").select(F.col("o_custkey").cast("long").alias("user_id"), F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("order "), F.col("o_orderstatus")).alias("summary"), F.col("ship").cast("date").cast("string").alias("related_text"), importance.alias("importance_text"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypothesis updates: user_id, seq, day, statement, observation, user_stated, sensitive."""
    e = interactions(spark, sf_dir)
    observation = F.when(F.col("event_type") == "error", "contradict").when(F.col("k") % 2 == 0, "new").otherwise("support")
    return e.select("user_id", F.col("id").alias("seq"), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int")).alias("day"), F.concat(F.lit("s"), F.floor(F.col("k") / 5).cast("int").cast("string")).alias("statement"), observation.alias("observation"), (F.col("k") % 17 == 0).alias("user_stated"), (F.col("k") % 13 == 0).alias("sensitive"))


def forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that users asked to forget: user_id, id, text; four benchmark items for each of the first users."""
    return table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 4).cast("long").alias("user_id"), F.col("item_id").cast("long").alias("id"), "text")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role <> 'system'").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("id"), F.when(F.col("role") == "user", "user").otherwise("assistant").alias("sender"), "text")


def reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, date, data: the decider's JSON, one a day of a customer's orders."""
    e = episodes(spark, sf_dir)
    event = F.struct("summary", F.col("related_text").alias("related_date"), F.col("importance_text").alias("importance"))
    own = e.groupBy("user_id", "date").agg(F.array_sort(F.collect_list(F.struct("id", event.alias("e")))).alias("l"))  # one user's orders of a day
    data = F.struct(F.col("date").cast("string").alias("date"), F.transform("l", lambda x: x["e"]).alias("important_events"), F.transform(F.filter("l", lambda x: x["id"] % 2 == 0), lambda x: x["id"]).alias("resolved_episode_ids"))
    return own.select("user_id", "date", F.to_json(data).alias("data"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only change log of rows (user_id, id) with columns kind and k."""
    e = interactions(spark, sf_dir)
    op = F.when(F.col("k") % 5 < 2, "put").when(F.col("k") % 5 == 4, "delete").otherwise("patch")
    return e.select("user_id", (F.col("k") % 10).cast("long").alias("id"), "ts", F.col("id").alias("seq"), op.alias("op"), F.array(F.lit("kind")).alias("sets"), F.when(F.col("k") % 7 != 0, F.col("kind")).alias("kind"), "k")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns: user_id, seq, ts, text and a decider's answer by a rule on seq."""
    n = F.col("seq") % 6
    command = F.when(n == 0, F.struct(F.lit("forget").alias("action"), F.lit("tea").alias("target"), F.array(F.lit("episode:1")).alias("target_ids"))).when(n == 1, F.struct(F.lit("list").alias("action"), F.lit(None).cast("string").alias("target"), F.array().cast("array<string>").alias("target_ids")))
    quiet = F.when(n == 2, "2024-01-20T18:00:00+03:00").when(n == 3, "2024-01-21").when(n == 4, "soon")
    frequency = F.when(n == 1, "low").when(n == 2, "often").when(n == 4, "high")
    m = messages(spark, sf_dir).filter("sender = 'user'").select("user_id", F.col("id").alias("seq"), F.lit(1705752000).cast("long").alias("ts"), "text")
    answer = F.to_json(F.struct(F.when(n == 5, "  ").otherwise("ok").alias("message"), command.alias("memory_command"), quiet.alias("do_not_disturb_until"), frequency.alias("preferred_frequency")))
    return m.select("user_id", "seq", "ts", "text", answer.alias("answer"), F.when(F.col("seq") % 11 == 0, "refused").alias("error"))
