"""Reply attribution: which outbound messages were answered, as of an instant.

A SEND is final at the first slot boundary after it. It is answered by the first user message from
its own second until then. Both lie in one slot, so one window over (user, slot) does it: many small
groups, whatever a single user's share of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions import delay_minutes, next_slot, slot_start


def sends(log: DataFrame, as_of: int, cfg: Config) -> DataFrame:
    """SENDs up to as_of: user_id, id, ts, message_type, fin, reply_ts, replied (null: pending), delay_minutes."""
    seen = log.filter((F.col("ts") <= as_of) & F.col("kind").isin("send", "user"))
    w = Window.partitionBy("user_id", "slot").orderBy("ts").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    answered = seen.withColumn("slot", slot_start(F.col("ts"), cfg.slot)).withColumn("reply_ts", F.min(F.when(F.col("kind") == "user", F.col("ts"))).over(w))
    fin = next_slot(F.col("ts"), cfg.slot)
    replied = F.when(F.col("reply_ts").isNotNull(), True).when(fin <= as_of, False)
    return answered.filter("kind = 'send'").select("user_id", "id", "ts", "message_type", fin.alias("fin"), "reply_ts", replied.alias("replied"), delay_minutes(F.col("ts"), F.col("reply_ts")).alias("delay_minutes"))


def response_rate(sent: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """user_id, rate, samples over decided SENDs of the last days."""
    recent = sent.filter((F.col("ts") >= as_of - days * 86400) & F.col("replied").isNotNull())
    return recent.groupBy("user_id").agg(F.avg(F.col("replied").cast("int").cast("double")).alias("rate"), F.count(F.lit(1)).alias("samples"))


def unanswered_today(sent: DataFrame, as_of: int) -> DataFrame:
    """user_id, n: SENDs of the day after the last answered one; pending ones count."""
    today = sent.filter(F.col("ts") >= as_of - as_of % 86400)
    ok = F.max(F.when(F.col("replied"), F.struct("ts", "id"))).over(Window.partitionBy("user_id"))
    after = today.withColumn("ok", ok).filter(F.col("ok").isNull() | (F.struct("ts", "id") > F.col("ok")))
    return after.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def continued(log: DataFrame, sent: DataFrame, turns: int = 3) -> DataFrame:
    """Answered SENDs followed by at least so many messages of anyone before the user's next SEND."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    run = log.withColumn("turn", F.sum(F.when(F.col("kind") == "send", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = run.groupBy("user_id", "turn").agg(F.max(F.when(F.col("kind") == "send", F.col("id"))).alias("id"), F.count(F.lit(1)).alias("rows")).filter("turn > 0")
    return sent.join(after.select("user_id", "id", "rows"), ["user_id", "id"]).select("user_id", "id", (F.coalesce("replied", F.lit(False)) & (F.col("rows") - 1 >= turns)).alias("continued"))


def repeated_type(sent: DataFrame) -> DataFrame:
    """SENDs of the type of the SEND before, on a fixed log."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    return sent.withColumn("before", F.lag("message_type").over(w)).filter("message_type = before")
