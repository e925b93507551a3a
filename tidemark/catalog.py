"""Every registered query of the engine, with its SQL where SQL can express it.

All instants are local seconds. Slots are of six hours but where a name says `1h`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DAY, Config
from .functions import daily_max, date_of, minutes, reply_length, shown_time
from .operators import context, gate, memory, reactions, scans
from .plans import contract, schedule, simulate
from .sources import adapters
from .sources.tables import table

AS_OF = 1705752000  # 2024-01-20 12:00
WEEK_AGO = AS_OF - 7 * DAY
TODAY = AS_OF - AS_OF % DAY
HOURLY, SIX = Config(timezone="UTC"), Config(timezone="UTC", slot=6 * 3600)
FROM, TO = TODAY - 3 * DAY, TODAY

_log, _set = adapters.interactions, adapters.settings


def _sends(s, d, cfg=SIX):
    return reactions.sends(_log(s, d), AS_OF, cfg)


def response_rate_7d(s: SparkSession, d: str) -> DataFrame:
    return reactions.response_rate(_sends(s, d), AS_OF)


def response_rate_7d_1h(s, d):
    return reactions.response_rate(_sends(s, d, HOURLY), AS_OF)


def reply_attribution(s, d):
    return _sends(s, d).select("user_id", "id", "ts", "fin", "reply_ts", "replied", "delay_minutes")


def consecutive_unanswered(s, d):
    return reactions.unanswered_today(_sends(s, d), AS_OF)


def conversation_continued(s, d):
    log = _log(s, d).filter(F.col("ts") <= AS_OF)
    return reactions.continued(log, _sends(s, d))


def reply_length_bucket(s, d):
    users = adapters.messages(s, d).filter("sender = 'user'")
    return users.groupBy(reply_length(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def reply_delay_histogram(s, d):
    return _sends(s, d).filter("replied").groupBy(F.floor(F.col("delay_minutes") / 60).alias("hours")).agg(F.count(F.lit(1)).alias("n"), F.sum("delay_minutes").alias("minutes"))


def repeat_type_lag(s, d):
    return reactions.repeated_type(_sends(s, d)).select("user_id", "id", "message_type")


def gate_reason_asof(s, d):
    f = gate.check(_log(s, d), _set(s, d, AS_OF), AS_OF, SIX)
    return f.select("user_id", "rate", "samples", "sent_today", "unanswered", "daily_max", "reason")


def gate_reason_by_slot(s, d):
    return gate.check_slots(_log(s, d), _set(s, d, AS_OF), FROM, TO, SIX)


def daily_max_now(s, d):
    f = gate.features(_log(s, d), _set(s, d, AS_OF), AS_OF, SIX)
    return f.select("user_id", "preferred_frequency", daily_max(F.col("preferred_frequency"), F.col("rate"), F.col("samples"), SIX).alias("daily_max"))


def skip_reason_counts(s, d):
    f = gate_reason_by_slot(s, d)
    return f.groupBy(F.when(F.col("reason").isNull(), "SEND").otherwise("SKIP").alias("decision"), "reason").agg(F.count(F.lit(1)).alias("n"))


def weekly_stats(s, d):
    f = gate.features(_log(s, d), _set(s, d, AS_OF), AS_OF, SIX)
    return f.select("user_id", "sent_7d", "rate", "samples", "daily_max")


def activity_hours(s, d):
    return scans.activity_hours(_log(s, d), WEEK_AGO)


def messages_between(s, d):
    return scans.between(_log(s, d), TODAY, AS_OF + 1).select("user_id", "id", "ts", "kind")


def recent_messages_topk(s, d):
    return scans.latest(_log(s, d).filter(F.col("ts") <= AS_OF), 20).select("user_id", "id", "ts", "kind", "n")


def today_tail(s, d):
    return scans.latest(scans.between(_log(s, d), TODAY, AS_OF + 1), 20).select("user_id", "id", "n")


def last_message(s, d):
    return scans.last(_log(s, d).filter(F.col("ts") <= AS_OF)).select("user_id", "id", "ts", "kind")


def recent_sends_types(s, d):
    five = scans.latest(_sends(s, d), 5)
    types = F.transform(F.sort_array(F.collect_list(F.struct("ts", "id", "message_type"))), lambda x: x["message_type"])  # five rows at most
    return five.groupBy("user_id").agg(types.alias("t")).select("user_id", F.array_join(context.last_two(F.col("t")), ",").alias("last_types"), F.size("t").alias("n"))


def pending_sends(s, d):
    return reactions.sends(_log(s, d), AS_OF + 7200, SIX).filter("replied is null").select("user_id", "id")


def messages_after(s, d):
    log = _log(s, d)
    anchor = scans.last(_sends(s, d)).select("user_id", F.col("id").alias("after"))
    return log.join(anchor, "user_id").filter("id > after").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def settings_defaults(s, d):
    known = _set(s, d, AS_OF).filter("user_id % 5 <> 0")
    c = scans.settings_of(_log(s, d).select("user_id").distinct(), known)
    return c.select("user_id", "preferred_frequency", F.coalesce(minutes(F.col("active_start")), F.lit(SIX.active_start)).alias("start"), F.coalesce(minutes(F.col("active_end")), F.lit(SIX.active_end)).alias("end"))


EPISODE_DAY = 803347200  # 1995-06-17


def _episodes(s, d):
    return memory.build_episodes(adapters.episodes(s, d))


def _dates(df, *cols):
    return df.select(*(F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns))


def episode_build(s, d):
    return _dates(_episodes(s, d), "date", "related_date")


def active_episodes(s, d):
    return scans.live(_episodes(s, d), EPISODE_DAY).select("user_id", "id", "expires_at")


def purge_counts(s, d):
    return scans.purge(_episodes(s, d), EPISODE_DAY)[1]


def episode_rank(s, d):
    return context.rank_episodes(scans.live(_episodes(s, d), EPISODE_DAY), 5).select("user_id", "id", "n")


def unresolved_near(s, d):
    return context.unresolved_near(_episodes(s, d), F.date_add(F.col("date"), 1)).select("user_id", "id")


def episode_resolve(s, d):
    e = _episodes(s, d)
    return memory.resolve(e, e.filter("id % 3 = 0"), EPISODE_DAY).groupBy("user_id").agg(F.count_if("resolved").alias("resolved"), F.count(F.lit(1)).alias("n"))


def state_clamp(s, d):
    e = table(s, d, "events")
    text = F.when(F.col("event_id") % 7 == 0, "soon").otherwise((F.get_json_object("props", "$.k").cast("int") - 5).cast("string"))
    return e.select("event_id", memory.state_days(text).alias("days"))


def hypothesis_levels(s, d):
    return _dates(memory.hypothesis_levels(adapters.updates(s, d)), "last_seen")


def _hypotheses(s, d):
    return memory.hypothesis_levels(adapters.updates(s, d))


def hypothesis_rank(s, d):
    return context.rank_hypotheses(_hypotheses(s, d), 8, False).select("user_id", "id", "level", "n")


def contradicted_delete(s, d):
    return memory.contradicted(_hypotheses(s, d)).select("user_id", "statement")


def hypothesis_fold(s, d):
    u = adapters.updates(s, d).withColumn("new_statement", F.lit(None).cast("string"))
    f = memory.fold(u)
    return f.select("user_id", "statement", "level", F.size("evidence").alias("evidence"), F.size("contradictions").alias("contradictions"), F.col("last_seen").cast("string").alias("last_seen"), "sensitive")


def forgotten_filter(s, d):
    phrases = table(s, d, "benchmark").select("text")
    return memory.without_forgotten(table(s, d, "documents").select("doc_id", "text"), "text", phrases, keys=()).select("doc_id")


def memory_listing(s, d):
    states = adapters.updates(s, d).filter("user_stated").select("user_id", F.col("seq").alias("id"), "statement", F.lit(EPISODE_DAY + 1).cast("long").alias("expires_at"))
    return memory.listing(_hypotheses(s, d), _episodes(s, d), states, EPISODE_DAY)


def reflection_upsert(s, d):
    r = adapters.interactions(s, d).select("user_id", date_of(F.col("ts")).cast("string").alias("date"), "kind", F.col("id").alias("seq"))
    return scans.upsert(r, ("user_id", "date"))


def _days(s, d):
    return scans.upsert(adapters.interactions(s, d).select("user_id", date_of(F.col("ts")).alias("date"), F.col("id").alias("seq")), ("user_id", "date"))


def reflections_since(s, d):
    """Up to eight calendar dates."""
    return _dates(scans.reflections_since(_days(s, d), date_of(F.lit(WEEK_AGO).cast("long"))), "date")


def has_reflection(s, d):
    return scans.has_reflection(_log(s, d), _days(s, d), date_of(F.lit(TODAY).cast("long")))


def reflection_events(s, d):
    return _dates(memory.build_episodes(contract.exploded(adapters.reflections(s, d))["events"].withColumn("id", F.col("n"))), "date", "related_date")


def reflection_resolved(s, d):
    return contract.exploded(adapters.reflections(s, d))["resolved"]


def hypothesis_match(s, d):
    u = adapters.updates(s, d)
    k = F.regexp_extract("statement", "[0-9]+", 0).cast("int")
    u = u.select("user_id", "seq", F.when(F.col("seq") % 3 == 0, F.col("seq")).alias("id"), F.concat(F.lit("s"), (k + F.col("seq") % 2 * 15).cast("string")).alias("statement"), "observation")
    return memory.matched(u, _hypotheses(s, d)).select("user_id", "seq", "observation", "hypothesis_id")


def change_replay(s, d):
    return scans.replay(adapters.changes(s, d), ("kind", "k"), AS_OF)


def by_id(s, d):
    """Rows by their ids: every hundredth episode."""
    e = _episodes(s, d)
    return scans.by_id(e, e.filter("id % 100 = 1").select("user_id", "id")).select("user_id", "id", "summary")


def user_message_times(s, d):
    return scans.user_times(_log(s, d), WEEK_AGO)


def live_states(s, d):
    states = _log(s, d).filter("k % 17 = 0").select("user_id", "id", F.concat(F.lit("s"), F.col("k").cast("string")).alias("statement"), F.col("ts").alias("created_at"), (F.col("ts") + 3 * DAY).alias("expires_at"))
    return memory.live_states(states, AS_OF).select("user_id", "n", "id", "statement")


def settings_patch(s, d):
    """Every fifth user sets a frequency twice and takes the quiet time back."""
    rows = _set(s, d, AS_OF)
    fifth = rows.filter("user_id % 5 = 0").select("user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    changes = fifth.select("user_id", "seq", F.when(F.col("seq") == 1, "low").otherwise("high").alias("preferred_frequency"), F.lit(None).cast("long").alias("do_not_disturb_until"))
    return scans.patch(rows, changes, ("preferred_frequency", "do_not_disturb_until"), keys=("user_id",), nulls=True).select("user_id", "preferred_frequency", "do_not_disturb_until")


def forget_commands(s, d):
    """Every tenth user forgets an episode by its id, which rules the text out; the next one by text alone."""
    e = _episodes(s, d)
    live = F.col("expires_at").isNull() | (F.col("expires_at") > EPISODE_DAY)
    items = e.select("user_id", F.lit("episode").alias("kind"), "id", F.col("summary").alias("text"), live.alias("live"))
    own = e.groupBy("user_id").agg(F.min("id").alias("id"))
    ids = F.when(F.col("user_id") % 10 == 0, F.array(F.concat(F.lit("episode:"), F.col("id").cast("string"))))
    commands = own.filter("user_id % 10 < 2").select("user_id", F.lit("order F").alias("target"), ids.alias("target_ids"))
    return memory.forget(items, commands)[0].select("user_id", "kind", "id")


def iso_times(s, d):
    return scans.last(_log(s, d)).select("user_id", contract.iso_text(F.col("ts"), "Asia/Seoul").alias("at"))


def memory_described(s, d):
    lines = memory_listing(s, d)
    return memory.described(_log(s, d).select("user_id"), lines)


def chat_effects(s, d):
    return contract.effects(adapters.turns(s, d))


def chat_frequency(s, d):
    return contract.frequencies(chat_effects(s, d))


def ordered_dedup(s, d):
    r = adapters.interactions(s, d).select("user_id", "message_type", F.col("id").alias("ordinal")).filter("message_type is not null")
    return scans.first_of_each(r, ("user_id", "message_type"), "ordinal")


def slot_calendar(s, d):
    return gate.slots(_log(s, d), FROM + 5 * 3600, TO, replace(SIX, slot=5 * 3600))


def weekday_trigger(s, d):
    stretches = s.range(0, 14 * 24, 7).select((F.lit(FROM) + F.col("id") * 3600).alias("before"), (F.lit(FROM) + (F.col("id") + 7) * 3600).alias("now"))
    return schedule.due(stretches, HOURLY).select("before", "now", F.coalesce("proactive", F.lit(0).cast("long")).alias("proactive"), F.size("reflections").alias("reflections"), F.size("reviews").alias("reviews"))


def reflection_windows(s, d):
    return schedule.reflection_windows(_log(s, d), HOURLY).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def shown_times(s, d):
    return scans.last(_log(s, d)).select("user_id", shown_time(F.col("ts")).alias("shown"))


def context_documents(s, d):
    log = _log(s, d).filter(F.col("ts") <= AS_OF)
    messages = log.select("user_id", "id", "ts", F.when(F.col("kind") == "user", "user").otherwise("assistant").alias("sender"), F.col("event_type").alias("text"))
    h = _hypotheses(s, d)
    states = adapters.updates(s, d).filter("user_stated").select("user_id", F.col("seq").alias("id"), "statement", F.col("seq").alias("created_at"), F.lit(AS_OF + 1).cast("long").alias("expires_at"))
    return context.documents(log.select("user_id"), messages, _episodes(s, d), h, states, _sends(s, d), adapters.forgotten(s, d), AS_OF, "proactive", SIX)


def feedback_simulation(s, d):
    log = _log(s, d)
    return simulate.simulate(log.filter("kind = 'user'").select("user_id", "ts"), gate.slots(log, FROM, TO, HOURLY), HOURLY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (
        "response_rate_7d response_rate_7d_1h reply_attribution consecutive_unanswered conversation_continued reply_length_bucket reply_delay_histogram repeat_type_lag "
        "gate_reason_asof gate_reason_by_slot daily_max_now skip_reason_counts weekly_stats activity_hours messages_between recent_messages_topk today_tail last_message recent_sends_types "
        "pending_sends messages_after settings_defaults episode_build active_episodes purge_counts episode_rank unresolved_near episode_resolve state_clamp hypothesis_levels hypothesis_rank "
        "contradicted_delete hypothesis_fold forgotten_filter memory_listing reflection_upsert ordered_dedup slot_calendar weekday_trigger reflection_windows shown_times context_documents feedback_simulation "
        "reflections_since has_reflection reflection_events reflection_resolved hypothesis_match change_replay by_id memory_described chat_effects chat_frequency user_message_times live_states settings_patch forget_commands iso_times"
    )
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.sql(AS_OF, FROM, TO, EPISODE_DAY)
