"""Reflection and review: episodes, short-lived states, hypotheses, forgetting, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DAY
from ..functions import is_hhmm, seconds_of, strip
from ..schemas import IMPORTANCES, LEVELS
from .phrases import without
from .scans import live

#: Forgotten phrases up to this many are broadcast; more are left to the planner, by user.
BROADCAST_PHRASES = 20_000
#: Texts of the memory listing.
STATE = "- 요즘: "
LISTED, LISTED_END = "내가 기억하고 있는 건 이 정도야:", "지우고 싶은 게 있으면 말해줘."
NOTHING = "아직 따로 기억해 둔 건 없어."


def build_episodes(events: DataFrame) -> DataFrame:
    """Of reflected events (user_id, id, date, summary, related_text, importance_text)."""
    related = F.to_date(F.try_to_timestamp(F.substring("related_text", 1, 10), F.lit("yyyy-MM-dd")))
    e = events.withColumn("related_date", related).withColumn("importance", F.when(F.col("importance_text").isin(*IMPORTANCES), F.col("importance_text")).otherwise("mid")).withColumn("summary", strip(F.col("summary")))
    resolved = F.col("related_date").isNull() | (F.col("related_date") < F.col("date"))
    days = F.when(F.col("importance") == "high", 60).otherwise(30)
    expires = F.when(F.col("related_date").isNotNull(), seconds_of(F.col("related_date")) + 7 * DAY).otherwise(F.coalesce("now", seconds_of(F.col("date"))) + days * DAY if "now" in events.columns else seconds_of(F.col("date")) + days * DAY)
    return e.filter("summary <> ''").select("user_id", "id", "date", "summary", "related_date", resolved.alias("resolved"), "importance", expires.alias("expires_at"))


def resolve(episodes: DataFrame, ids: DataFrame, as_of: int) -> DataFrame:
    """Ids of open, live episodes become resolved; others are ignored."""
    hit = ids.select("user_id", "id").distinct().withColumn("_hit", F.lit(True))
    open_ = ~F.col("resolved") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    return episodes.join(hit, ["user_id", "id"], "left").withColumn("resolved", F.col("resolved") | (open_ & F.coalesce("_hit", F.lit(False)))).drop("_hit")


def state_days(text: Column) -> Column:
    """Days a state lasts: 3 unless it is a whole number of 1 or more, 14 at most."""
    n = F.when(text.rlike("^-?[0-9]{1,9}$"), text.cast("long"))
    return F.least(F.when(n >= 1, n).otherwise(3), F.lit(14))


def live_states(states: DataFrame, as_of: int) -> DataFrame:
    """States that last, with n counting from each user's newest."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return live(states, as_of).withColumn("n", F.row_number().over(w))


def without_forgotten(rows: DataFrame, text: str, forgotten: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Rows that neither hold a forgotten phrase nor lie within one. Without keys every phrase counts for every row."""
    phrases = forgotten.select(*(F.col(k).alias(f"_{k}") for k in keys), strip(F.col("text")).alias("_phrase")).filter("_phrase <> ''").distinct()
    stripped = rows.withColumn("_text", strip(F.col(text)))  # once a row, not once a pair
    if not keys:
        return without(stripped, "_text", phrases).drop("_text")
    hit = F.col("_text").contains(F.col("_phrase")) | F.col("_phrase").contains(F.col("_text"))
    for k in keys:
        hit = hit & (F.col(k) == F.col(f"_{k}"))
    small = phrases.limit(BROADCAST_PHRASES + 1).count() <= BROADCAST_PHRASES
    return stripped.join(F.broadcast(phrases) if small else phrases, hit, "left_anti").drop("_text")


def hypothesis_levels(updates: DataFrame) -> DataFrame:
    """Between reviews the fold of updates has a closed form: one aggregate for each statement.

    The first `new` creates; what came before is dropped. A later `new` supports. confirmed if a
    later support is user-stated, else repeated with two days of support, else mentioned.
    """
    w = Window.partitionBy("user_id", "statement")
    u = updates.withColumn("born", F.min(F.when(F.col("observation") == "new", F.col("seq"))).over(w)).filter("seq >= born")
    creates, supports = F.col("seq") == F.col("born"), F.col("observation").isin("new", "support")
    days = F.count_distinct(F.when(supports, F.col("day")))
    stated = F.coalesce(F.bool_or(F.when(supports & ~creates, F.col("user_stated"))), F.lit(False))
    return u.groupBy("user_id", "statement").agg(
        F.when(stated, "confirmed").when(days >= 2, "repeated").otherwise("mentioned").alias("level"),
        days.alias("evidence"),
        F.count_distinct(F.when(~supports, F.col("day"))).alias("contradictions"),
        F.max("day").alias("last_seen"),
        F.bool_or("sensitive").alias("sensitive"),
        F.min("born").alias("id"),
    )


def fold(updates: DataFrame) -> DataFrame:
    """The whole fold, reviews interleaved: a left fold over each hypothesis' rows in Catalyst.

    Rows: user_id, statement (the hypothesis' key), seq, day, observation (new, support, contradict,
    keep, upgrade, downgrade, delete, rewrite, review), user_stated, sensitive, new_statement. A
    `review` row ends a review that left the hypothesis alone.
    """
    row = F.struct("seq", "day", "observation", "user_stated", "sensitive", "new_statement")
    kept = "struct<text:string,level:int,evidence:array<date>,contradictions:array<date>,last_seen:date,sensitive:boolean>"
    none = F.lit(None).cast(kept)

    def build(text, level, evidence, contradictions, seen, sensitive):
        return F.struct(text.alias("text"), level.cast("int").alias("level"), evidence.alias("evidence"), contradictions.alias("contradictions"), seen.alias("last_seen"), sensitive.alias("sensitive")).cast(kept)

    empty = F.array().cast("array<date>")

    def step(a, r):
        o, day = r["observation"], r["day"]
        more = F.when(F.array_contains(a["evidence"], day), a["evidence"]).otherwise(F.concat(a["evidence"], F.array(day)))
        less = F.when(F.array_contains(a["contradictions"], day), a["contradictions"]).otherwise(F.concat(a["contradictions"], F.array(day)))
        sensitive = a["sensitive"] | F.coalesce(r["sensitive"], F.lit(False))
        level = F.when(F.coalesce(r["user_stated"], F.lit(False)), 3).when((a["level"] == 1) & (F.size(F.array_distinct(more)) >= 2), 2).otherwise(a["level"])
        as_is = lambda level: build(a["text"], level, a["evidence"], a["contradictions"], a["last_seen"], a["sensitive"])
        return (
            F.when(a.isNull(), F.when(o == "new", build(F.col("statement"), F.lit(1), F.array(day), empty, day, F.coalesce(r["sensitive"], F.lit(False)))).otherwise(none))
            .when(o.isin("new", "support"), build(a["text"], level, more, a["contradictions"], day, sensitive))
            .when(o == "contradict", build(a["text"], a["level"], a["evidence"], less, day, sensitive))
            .when(o == "upgrade", as_is(F.least(a["level"] + 1, F.lit(3))))
            .when(o == "downgrade", as_is(F.greatest(a["level"] - 1, F.lit(1))))
            .when(o == "delete", none)
            .when((o == "rewrite") & (F.coalesce(strip(r["new_statement"]), F.lit("")) != ""), build(strip(r["new_statement"]), F.lit(1), F.array(day), empty, a["last_seen"], a["sensitive"]))
            .when((o == "review") & (F.size(a["contradictions"]) > F.size(a["evidence"])), none)
            .otherwise(a)
        )

    rows = updates.groupBy("user_id", "statement").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # one hypothesis' own updates
    done = rows.select("user_id", "statement", F.aggregate("rows", none, step).alias("h")).filter("h is not null")
    level = F.array(*map(F.lit, LEVELS))
    return done.select("user_id", F.col("h.text").alias("statement"), level[F.col("h.level") - 1].alias("level"), "h.evidence", "h.contradictions", "h.last_seen", "h.sensitive")


def contradicted(hypotheses: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Hypotheses that a review deletes by itself: untouched, with more contradictions than evidence (counts)."""
    left = hypotheses if touched is None else hypotheses.join(touched, ["user_id", "id"], "left_anti")
    return left.filter("contradictions > evidence")


def active_hours(settings: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggested hours (user_id, start, end, seq): the last pair that is well formed wins."""
    fine = suggestions.filter(is_hhmm(F.col("start")) & is_hhmm(F.col("end"))).groupBy("user_id").agg(F.max(F.struct("seq", "start", "end")).alias("s"))
    return settings.join(fine, "user_id", "left").withColumn("active_start", F.coalesce("s.start", "active_start")).withColumn("active_end", F.coalesce("s.end", "active_end")).drop("s")


def forget(items: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (user_id, kind, id, text, live) that commands (user_id, target, target_ids) remove, and the phrases to keep out.

    Typed ids come first; a command's text is looked for only where its own ids removed nothing, among live
    episodes and all hypotheses; states go by text always. Commands of one call see the same items.
    """
    c = commands.withColumn("target", strip(F.coalesce("target", F.lit("")))).withColumn("command", F.struct("user_id", "target", "target_ids"))
    ids = c.select("user_id", "command", F.explode("target_ids").alias("t")).filter(F.col("t").rlike("^(episode|hypothesis):[0-9]{1,18}$")).select("user_id", "command", F.split_part("t", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("t", F.lit(":"), F.lit(2)).cast("long").alias("id")).distinct()
    by_id = items.join(ids.drop("command"), ["user_id", "kind", "id"], "left_semi")
    done = ids.join(items.select("user_id", "kind", "id"), ["user_id", "kind", "id"], "left_semi").select(F.col("command").alias("_done")).distinct()
    text = c.filter("target <> ''").select("user_id", "target", "command")
    rest = text.join(done, F.col("command").eqNullSafe(F.col("_done")), "left_anti").drop("command")
    text = text.drop("command")
    fallback = items.filter("kind = 'hypothesis' or (kind = 'episode' and live)").join(rest, "user_id").filter(F.col("text").contains(F.col("target"))).drop("target")
    states = items.filter("kind = 'state' and live").join(text, "user_id").filter(F.col("text").contains(F.col("target"))).drop("target")
    gone = by_id.unionByName(fallback).unionByName(states).distinct()
    order = F.when(F.col("kind") == "episode", 0).when(F.col("kind") == "hypothesis", 1).otherwise(2)
    phrases = gone.select("user_id", "text", order.alias("o"), "id").unionByName(text.select("user_id", F.col("target").alias("text"), F.lit(3).alias("o"), F.lit(0).cast("long").alias("id")))
    phrases = phrases.groupBy("user_id", "text").agg(F.min(F.struct("o", "id")).alias("at"))
    return gone, phrases


def matched(updates: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Updates (user_id, seq, id, statement, observation) with the hypothesis (user_id, id, statement) that each means.

    By id where there is such a hypothesis, else by the stripped statement (the smallest id of equal ones);
    a `new` that matches by statement is a `support`. hypothesis_id is null where nothing matches.
    """
    known = hypotheses.select("user_id", F.col("id").alias("_id"))
    by_text = hypotheses.groupBy("user_id", F.col("statement").alias("_text")).agg(F.min("id").alias("_of_text"))
    u = updates.withColumn("_text", strip(F.col("statement")))
    u = u.join(known, (u.user_id == known.user_id) & (u.id == known._id), "left").drop(known.user_id)
    u = u.join(by_text, ["user_id", "_text"], "left")
    told = F.when(F.col("_id").isNull() & F.col("_of_text").isNotNull() & (F.col("observation") == "new"), "support").otherwise(F.col("observation"))
    return u.withColumn("observation", told).withColumn("hypothesis_id", F.coalesce("_id", F.when(F.col("_text") != "", F.col("_of_text")))).drop("_id", "_text", "_of_text")


def described(users: DataFrame, lines: DataFrame) -> DataFrame:
    """(user_id, text): each user's listing as one text."""
    own = lines.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("section", "n", "line"))).alias("l"))  # what one user's memory holds
    text = F.concat(F.lit(LISTED), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"), F.lit(LISTED_END))
    return users.select("user_id").distinct().join(own, "user_id", "left").select("user_id", F.coalesce(text, F.lit(NOTHING)).alias("text"))


def listing(hypotheses: DataFrame, episodes: DataFrame, states: DataFrame, as_of: int) -> DataFrame:
    """Lines (user_id, section, n, line) of what is remembered."""
    h = hypotheses.filter(F.col("level").isin("repeated", "confirmed")).select("user_id", F.lit(1).alias("section"), F.col("id").alias("n"), F.concat(F.lit("- "), F.col("statement")).alias("line"))
    shown = F.concat(F.lit("- "), F.col("summary"), F.coalesce(F.concat(F.lit(" ("), F.date_format("related_date", "MM/dd"), F.lit(")")), F.lit("")))
    e = live(episodes, as_of).filter("not resolved").select("user_id", F.lit(2).alias("section"), F.col("id").alias("n"), shown.alias("line"))
    s = live(states, as_of).select("user_id", F.lit(3).alias("section"), F.col("id").alias("n"), F.concat(F.lit(STATE), F.col("statement")).alias("line"))
    return h.unionByName(e).unionByName(s)
