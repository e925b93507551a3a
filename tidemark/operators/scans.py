"""Scans, latest rows and top-k, by user; and tables as replays of append-only changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def between(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Half-open in ts."""
    return rows.filter((F.col("ts") >= start) & (F.col("ts") < end))


def latest(rows: DataFrame, k: int, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Each user's last k rows, with n counting from the latest."""
    w = Window.partitionBy("user_id").orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)


def last(rows: DataFrame) -> DataFrame:
    """Each user's last row: a partial maximum, no sort."""
    best = F.max(F.struct("ts", "id", *(c for c in rows.columns if c not in ("user_id", "ts", "id"))))
    return rows.groupBy("user_id").agg(best.alias("r")).select("user_id", "r.*")


def by_id(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys, ["user_id", "id"], "left_semi")


def user_times(log: DataFrame, since: int) -> DataFrame:
    """When users wrote, from an instant on."""
    return log.filter((F.col("kind") == "user") & (F.col("ts") >= since)).select("user_id", "ts")


def live(rows: DataFrame, as_of: int) -> DataFrame:
    """Not expired; a null expiry means never."""
    return rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def purge(rows: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many of each user's rows go."""
    gone = rows.filter(F.col("expires_at") <= as_of).groupBy("user_id").agg(F.count(F.lit(1)).alias("purged"))
    return live(rows, as_of), gone


def upsert(rows: DataFrame, keys: tuple[str, ...], order: str = "seq") -> DataFrame:
    """Last write wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def patch(rows: DataFrame, changes: DataFrame, allowed: tuple[str, ...], keys: tuple[str, ...] = ("user_id", "id"), seq: str = "seq", nulls: bool = False) -> DataFrame:
    """Rows with the columns of changes put in; unknown columns are an error.

    A null changes nothing, or with nulls it is put in. Of several changes of a key the last in order of seq
    counts, for each column by itself; changes without that column have no order, and the largest value counts.
    """
    new = [c for c in changes.columns if c not in (*keys, seq)]
    if not new or set(new) - set(allowed):
        raise ValueError(f"columns to change: {new or 'none'}; allowed: {allowed}")
    order = F.col(seq) if seq in changes.columns else F.lit(0)
    put = lambda c: F.max(F.when(F.lit(nulls) | F.col(c).isNotNull(), F.struct(order.alias("at"), F.col(c).alias("v")))).alias(f"_{c}")
    last = changes.groupBy(*keys).agg(*(put(c) for c in new))
    return rows.join(last, list(keys), "left").select(*(F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.col(f"_{c}.v")).alias(c) if c in new else c for c in rows.columns))


def replay(changes: DataFrame, columns: tuple[str, ...], as_of: int | None = None, keys: tuple[str, ...] = ("user_id", "id")) -> DataFrame:
    """A table (keys, columns) out of its append-only changes, as of an instant.

    changes: keys, ts, seq, op, sets, columns. put writes a whole row, patch the columns that the array sets
    names (null is a value), delete removes it. What patches a row that isn't there is ignored. One aggregate.
    """
    log = changes if as_of is None else changes.filter(F.col("ts") <= as_of)
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("seq"))).alias(f"_{op}")
    value = lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.when((F.col("op") == "put") | ((F.col("op") == "patch") & F.array_contains("sets", c)), F.col("seq"))).alias(f"_{c}")
    # a patch between a delete and the next put changes no row, and that put overwrites it
    seen = log.groupBy(*keys).agg(last("put"), last("delete"), *map(value, columns))
    return seen.filter("_put > coalesce(_delete, -1)").select(*keys, *(F.col(f"_{c}.v").alias(c) for c in columns))


def reflections_since(reflections: DataFrame, since) -> DataFrame:
    """Inclusive in date."""
    return reflections.filter(F.col("date") >= since)


def has_reflection(users: DataFrame, reflections: DataFrame, day) -> DataFrame:
    """(user_id, reflected) for each user."""
    have = reflections.filter(F.col("date") == day).select("user_id").distinct().withColumn("_has", F.lit(True))
    return users.select("user_id").distinct().join(have, "user_id", "left").select("user_id", F.coalesce("_has", F.lit(False)).alias("reflected"))


def replace(rows: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("user_id", "id")) -> DataFrame:
    return rows.join(new, list(keys), "left_anti").unionByName(new)


def delete(rows: DataFrame, tombstones: DataFrame, keys: tuple[str, ...] = ("user_id", "id")) -> DataFrame:
    return rows.join(tombstones, list(keys), "left_anti")


def settings_of(users: DataFrame, settings: DataFrame) -> DataFrame:
    """One row for each user; defaults where there is none."""
    return users.join(settings, "user_id", "left").withColumn("preferred_frequency", F.coalesce("preferred_frequency", F.lit("normal")))


def first_of_each(rows: DataFrame, by: tuple[str, ...], ordinal: str) -> DataFrame:
    """Ordered dedup: the first occurrence stays."""
    return rows.groupBy(*by).agg(F.min(ordinal).alias(ordinal))


def activity_hours(rows: DataFrame, since: int) -> DataFrame:
    """Histogram of the users' message hours."""
    hour = F.format_string("%02d", F.floor(F.pmod(F.col("ts"), F.lit(86400)) / 3600))
    return rows.filter((F.col("kind") == "user") & (F.col("ts") >= since)).groupBy("user_id", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
