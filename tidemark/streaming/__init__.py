"""Structured Streaming forms of reply tracking and slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import delay_minutes, slot_start


def timed(log: DataFrame) -> DataFrame:
    return log.withColumn("at", F.timestamp_seconds("ts"))


def slotted(log: DataFrame, cfg: Config, late: str) -> DataFrame:
    """With slot_at, the slot's start; slots start anew at midnight. A slot ends when one that starts a slot and the lateness later is seen."""
    rows = log.withColumn("slot_at", F.timestamp_seconds(slot_start(F.col("ts"), cfg.slot)))
    return rows.withWatermark("slot_at", f"{cfg.slot} seconds {late}")


def replies(log: DataFrame, cfg: Config, late: str = "10 minutes") -> DataFrame:
    """SENDs and their first replies. A SEND and its reply share a slot, so state lasts one slot and the
    lateness: rows of a slot are given out when the watermark has passed it, answered or not."""
    rows = slotted(log.filter(F.col("kind").isin("send", "user")), cfg, late)
    item = F.struct("ts", "id", "kind")
    slots = rows.groupBy("slot_at", "user_id").agg(F.sort_array(F.collect_list(item)).alias("rows"))  # one user's rows of one slot
    sent = slots.select("user_id", "rows", F.explode(F.filter("rows", lambda r: r["kind"] == "send")).alias("s"))
    reply = F.array_min(F.transform(F.filter("rows", lambda r: (r["kind"] == "user") & (r["ts"] >= F.col("s.ts"))), lambda r: r["ts"]))
    return sent.select("user_id", F.col("s.id").alias("id"), F.col("s.ts").alias("ts"), reply.isNotNull().alias("replied"), delay_minutes(F.col("s.ts"), reply).alias("delay_minutes"))


def slot_counts(log: DataFrame, cfg: Config, late: str = "10 minutes") -> DataFrame:
    """Messages of each kind in each slot."""
    return slotted(log, cfg, late).groupBy("slot_at", "kind").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("slot_at").alias("slot"), "kind", "n")


def to_messenger(sent: DataFrame, deliver, checkpoint: str):
    """A sink: deliver(batch, id) for each micro-batch of SEND rows."""
    return sent.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)


__all__ = ["replies", "slot_counts", "slot_start", "slotted", "timed", "to_messenger"]
