"""Rules on literal rows. Times are hours of a day unless a test says otherwise."""

import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import catalog, config, schemas
from tidemark.config import DAY, Config
from tidemark.functions import daily_max, duration_seconds, in_hours, reply_length, shown_time, slot_start
from tidemark.operators import context, gate, memory, reactions, scans
from tidemark.operators import phrases as phrases_of
from tidemark.plans import contract, schedule, simulate

CFG = Config()
D0 = 20725 * DAY  # 2026-09-29, a Tuesday


def at(hour, minute=0, day=0):
    return D0 + day * DAY + hour * 3600 + minute * 60


LOG = "user_id long, id long, ts long, kind string, message_type string"
NO_SETTINGS = "user_id long, active_start string, active_end string, do_not_disturb_until long, preferred_frequency string"


def log_of(spark, rows):
    return spark.createDataFrame([(1, i, ts, kind, t) for i, (ts, kind, t) in enumerate(rows)], LOG)


def reason(spark, rows, now, settings=()):
    f = gate.check(log_of(spark, rows), spark.createDataFrame(list(settings), NO_SETTINGS), now, CFG).collect()
    return f[0].reason


def test_config():
    assert config.duration_seconds("1h30m") == 5400 and config.duration_seconds(90) == 5400 and config.duration_seconds("1h30") == 3600
    with pytest.raises(ValueError):
        config.duration_seconds("soon")
    c = config.from_dict({"active_hours": {"start": "08:30", "end": "22:00"}, "backoff": [{"response_rate_below": 0.5, "max_proactive_per_day": 2}, {"response_rate_below": 0.2, "max_proactive_per_day": 1}], "review_day": "Monday", "db_path": "x.db"}, Path("/a"))
    assert (c.active_start, c.active_end, c.review_weekday) == (510, 1320, 0)
    assert c.backoff == ((0.2, 1), (0.5, 2)) and c.paths["db_path"] == "/a/x.db" and c.max_per_day == 4


def test_column_parsers(spark):
    r = spark.createDataFrame([("1h30m",), ("45s",), ("1h30",), ("x",)], "t string").select(duration_seconds(F.col("t")).alias("s")).collect()
    assert [x.s for x in r] == [5400, 45, 3600, None]
    r = spark.createDataFrame([(" 응　",), ("a" * 80,), ("b" * 11,)], "t string").select(reply_length(F.col("t")).alias("b")).collect()
    assert [x.b for x in r] == ["short", "long", "normal"]
    r = spark.createDataFrame([(at(19),)], "t long").select(shown_time(F.col("t")).alias("s"), slot_start(F.col("t") + 3599, 5 * 3600).alias("b")).first()
    assert r.s == "2026-09-29 (화) 19:00" and r.b == at(15)


def test_gate_hours(spark):
    assert reason(spark, [(at(6), "user", None)], at(8)) == "gate_active_hours"
    r = spark.createDataFrame([(at(1),), (at(10),), (at(20),)], "t long").select(in_hours(F.col("t"), F.lit(1200), F.lit(120)).alias("x"), in_hours(F.col("t"), F.lit(600), F.lit(600)).alias("y")).collect()
    assert [(x.x, x.y) for x in r] == [(True, False), (False, False), (True, False)]


def test_gate_recent_message(spark):
    rows = [(at(10), "user", None)]
    assert reason(spark, rows, at(11)) == "gate_recent_message" and reason(spark, rows, at(12)) is None


def test_gate_unanswered_wait(spark):
    rows = [(at(10), "send", "recall")]
    assert reason(spark, rows, at(13)) == "gate_unanswered_wait" and reason(spark, rows, at(14)) is None


def test_gate_consecutive(spark):
    rows = [(at(9), "send", "recall"), (at(13), "send", "playful")]
    assert reason(spark, rows, at(18)) == "gate_consecutive_unanswered"
    assert reason(spark, [*rows, (at(13, 5), "user", None)], at(18)) is None


def test_gate_quiet(spark):
    settings = [(1, None, None, at(9, day=1), "normal")]
    assert reason(spark, [(at(6), "user", None)], at(20), settings) == "gate_do_not_disturb"
    assert reason(spark, [(at(6), "user", None)], at(10, day=1), settings) is None


@pytest.mark.parametrize("rate, samples, frequency, most", [(0.25, 4, "normal", 2), (0.2, 5, "normal", 2), (1 / 6, 6, "normal", 1), (0.9, 9, "normal", 4), (0.0, 2, "normal", 4), (None, 0, "low", 2), (None, 0, "high", 6)])
def test_daily_max(spark, rate, samples, frequency, most):
    r = spark.createDataFrame([(rate, samples, frequency)], "r double, n int, f string").select(daily_max(F.col("f"), F.col("r"), F.col("n"), CFG).alias("m")).first()
    assert r.m == most


def test_reply_and_continuation(spark):
    rows = [(at(10), "send", "recall"), (at(10, 25), "user", None), (at(10, 25), "assistant", None), (at(10, 30), "user", None)]
    one = reactions.sends(log_of(spark, rows[:3]), at(10, 26), CFG)
    r = one.first()
    assert (r.replied, r.delay_minutes) == (True, 25)
    assert reactions.continued(log_of(spark, rows[:3]), one).first().continued is False
    assert reactions.continued(log_of(spark, rows), reactions.sends(log_of(spark, rows), at(10, 31), CFG)).first().continued is True


def test_finalized_at_next_tick(spark):
    rows = [(at(10), "send", "recall"), (at(11, 5), "user", None)]
    assert reactions.sends(log_of(spark, rows), at(10, 59), CFG).first().replied is None
    assert reactions.sends(log_of(spark, rows), at(12), CFG).first().replied is False


def test_outcomes(spark):
    cases = [
        ('{"decision":"SEND","reason":"r","message_type":"recall","message":" hi "}', None, "SEND", "r"),
        ('{"decision":"SKIP","reason":"","message_type":null,"message":null}', None, "SKIP", "model_skip"),
        ('{"decision":"SEND","reason":"","message_type":"nope","message":"x"}', None, "SKIP", "invalid_output"),
        ('{"decision":"SEND","reason":"","message_type":"playful","message":"x"}', None, "SKIP", "repeat_type"),
        ("[1]", None, "SKIP", "llm_error"),
        ('{"decision":"SEND"}', None, "SKIP", "llm_error"),
        ("{}", "timeout", "SKIP", "llm_error"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, e string").select(contract.outcome(contract.parsed(F.col("t"), "proactive"), F.col("e"), F.lit("playful")).alias("o"))
    assert [(r.o.decision, r.o.reason) for r in df.collect()] == [c[2:] for c in cases]


def test_quiet_until(spark):
    rows = [("2026-09-29T09:00:00",), ("2026-12-31 09:00",), ("2020-01-01T00:00:00",), ("later",)]
    r = spark.createDataFrame(rows, "t string").select(contract.quiet_until(F.col("t"), F.lit(at(8)).cast("long")).alias("u")).collect()
    assert [x.u for x in r] == [at(9), at(8, day=30), None, None]


def test_quiet_until_with_offsets_and_dates(spark):
    """Offsets are brought to the zone, a bare date is its midnight; what is no such time is ignored."""
    rows = [("2026-09-29T09:00:00+09:00",), ("2026-09-29T03:00:00Z",), ("2026-09-29 05:30:00.250+05:30",), ("2026-09-30",), ("2026-09-29T10",), ("2026-09-29T25:00",), ("2026-02-30",), ("2026-09-29T09:00:00+05:00x",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string").select(contract.quiet_until(F.col("t"), F.lit(at(8)).cast("long"), "Asia/Seoul").alias("u"), contract.iso_text(contract.iso_seconds(F.col("t"), "Asia/Seoul"), "Asia/Seoul").alias("i"))
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = df.collect()
        assert [r.u for r in got] == [at(9), at(12), at(9), at(0, day=1), at(10), None, None, None, None, None], zone
        assert got[1].i == "2026-09-29T12:00:00+09:00" and got[5].i is None
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_chat_effects_in_order(spark):
    full = '{"message": " ok ", "memory_command": {"action": "forget", "target": "tea", "target_ids": ["episode:1"]}, "do_not_disturb_until": "2026-09-29T20:00", "preferred_frequency": "high"}'
    rows = [(1, 1, at(8), "hi", full, None), (1, 2, at(9), "so", '{"message": "", "memory_command": {"action": "list"}, "preferred_frequency": "often"}', None), (1, 3, at(9), "x", full, "refused")]
    e = contract.effects(spark.createDataFrame(rows, "user_id long, seq long, ts long, text string, answer string, error string"))
    got = [(r.seq, r.effect, r.value) for r in e.orderBy("seq", "step").collect()]
    assert got[:8] == [(1, "store_user", "hi"), (1, "track_reaction", str(at(8))), (1, "forget", '{"target":"tea","target_ids":["episode:1"]}'), (1, "quiet_until", str(at(20))), (1, "frequency", "high"), (1, "send", "ok"), (1, "store_reply", "ok"), (1, "track_continuation", str(at(8)))]
    assert [x[1] for x in got[8:]] == ["store_user", "track_reaction", "list", "send", "store_reply", "track_continuation", "store_user", "track_reaction", "send", "store_reply", "track_continuation"] and got[11][2] == contract.FALLBACK
    assert contract.frequencies(e).collect()[0].preferred_frequency == "high"


def test_changes_replay(spark):
    rows = [(1, 1, 1, 1, "put", None, "a", 1), (1, 1, 2, 2, "patch", ["t"], None, 9), (1, 2, 1, 3, "patch", ["t"], "no row", 0), (1, 3, 1, 4, "put", None, "b", 2), (1, 3, 5, 5, "delete", None, None, None), (1, 3, 9, 6, "put", None, "c", 3)]
    log = spark.createDataFrame(rows, "user_id long, id long, ts long, seq long, op string, sets array<string>, t string, n long")
    at_ = lambda t: {(r.id, r.t, r.n) for r in scans.replay(log, ("t", "n"), t).collect()}
    assert at_(1) == {(1, "a", 1), (3, "b", 2)} and at_(5) == {(1, None, 1)} and at_(None) == {(1, None, 1), (3, "c", 3)}


def test_updates_match_by_id_then_statement(spark):
    h = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 12, "a")], "user_id long, id long, statement string")
    rows = [(1, 1, 11, "a", "new"), (1, 2, None, " a ", "new"), (1, 3, 99, "b", "contradict"), (1, 4, None, "z", "new"), (1, 5, None, None, "support")]
    got = {r.seq: (r.hypothesis_id, r.observation) for r in memory.matched(spark.createDataFrame(rows, "user_id long, seq long, id long, statement string, observation string"), h).collect()}
    assert got == {1: (11, "new"), 2: (10, "support"), 3: (11, "contradict"), 4: (None, "new"), 5: (None, "support")}


def test_reflections_explode(spark):
    data = json.dumps({"date": "2026-09-29", "important_events": [{"summary": "trip", "related_date": "2026-10-01", "importance": "high"}], "resolved_episode_ids": [4, 4], "current_state": [{"statement": " tired ", "expires_in_days": 2}, {"statement": " "}], "hypothesis_updates": [{"id": 3, "statement": "s", "observation": "new"}]})
    rows = contract.exploded(spark.createDataFrame([(1, date(2026, 9, 29), data), (2, date(2026, 9, 29), "no json")], "user_id long, date date, data string"))
    assert [(r.user_id, r.summary, r.related_text, r.importance_text) for r in rows["events"].collect()] == [(1, "trip", "2026-10-01", "high")]
    assert [r.id for r in rows["resolved"].collect()] == [4] and [(r.statement, r.days_text) for r in rows["states"].collect()] == [("tired", "2")] and [(r.id, r.observation) for r in rows["updates"].collect()] == [(3, "new")]


HYP = "user_id long, statement string, seq long, day date, observation string, user_stated boolean, sensitive boolean, new_statement string"


def updates(spark, rows):
    return spark.createDataFrame([(1, s, i, date(2026, 9, d), o, u, x, n) for i, (s, d, o, u, x, n) in enumerate(rows)], HYP)


def test_levels(spark):
    rows = [("a", 27, "new", True, False, None), ("a", 27, "support", False, False, None), ("a", 28, "new", False, True, None)]
    r = memory.fold(updates(spark, rows)).first()
    assert r.level == "repeated" and r.evidence == [date(2026, 9, 27), date(2026, 9, 28)] and r.sensitive
    assert memory.hypothesis_levels(updates(spark, rows)).first().level == "repeated"
    assert memory.fold(updates(spark, [*rows, ("a", 29, "support", True, False, None)])).first().level == "confirmed"
    assert memory.fold(updates(spark, rows[:1])).first().level == "mentioned"
    assert memory.fold(updates(spark, [("b", 27, "support", True, False, None)])).count() == 0


def test_review(spark):
    rows = [("a", 1, "new", False, False, None), ("a", 2, "delete", False, False, None), ("b", 1, "new", False, False, None), ("b", 2, "upgrade", False, False, None),
            ("c", 1, "new", False, False, None), ("c", 2, "contradict", False, False, None), ("c", 3, "contradict", False, False, None), ("c", 4, "review", False, False, None),
            ("d", 1, "new", False, False, None), ("d", 2, "contradict", False, False, None), ("d", 3, "contradict", False, False, None), ("d", 4, "keep", False, False, None),
            ("e", 1, "new", False, False, None), ("e", 2, "support", False, False, None), ("e", 4, "rewrite", False, False, " E "), ("f", 1, "new", False, False, None), ("f", 2, "downgrade", False, False, None)]
    got = {r.statement: (r.level, len(r.evidence), len(r.contradictions)) for r in memory.fold(updates(spark, rows)).collect()}
    assert got == {"b": ("repeated", 1, 0), "d": ("mentioned", 1, 2), "E": ("mentioned", 1, 0), "f": ("mentioned", 1, 0)}
    s = spark.createDataFrame([(1, "08:00", "20:00")], "user_id long, active_start string, active_end string")
    bad = spark.createDataFrame([(1, "09:00", "25:00", 1)], "user_id long, start string, end string, seq long")
    assert memory.active_hours(s, bad).first().active_start == "08:00"
    assert memory.active_hours(s, bad.unionAll(spark.createDataFrame([(1, "10:00", "21:00", 2)], bad.schema))).first().active_end == "21:00"


def test_episodes(spark):
    rows = [(1, 1, date(2026, 9, 27), " trip ", "2026-09-29", "high"), (1, 2, date(2026, 9, 27), "same", "2026-09-27", "x"), (1, 3, date(2026, 9, 27), "past", "2026-09-26", "low"), (1, 4, date(2026, 9, 27), "open", "soon", "high"), (1, 5, date(2026, 9, 27), " ", None, "low")]
    e = memory.build_episodes(spark.createDataFrame(rows, "user_id long, id long, date date, summary string, related_text string, importance_text string"))
    got = {r.id: r for r in e.collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].summary == "trip" and not got[1].resolved and not got[2].resolved and got[2].importance == "mid" and got[3].resolved and got[4].resolved
    assert got[1].expires_at == at(0, day=7) and got[4].expires_at == at(0, day=-2 + 60)
    ids = spark.createDataFrame([(1, 1), (1, 999)], "user_id long, id long")
    assert {r.id: r.resolved for r in memory.resolve(e, ids, at(0)).collect()}[1] is True
    near = context.unresolved_near(e, F.lit(date(2026, 9, 29)))
    assert sorted(r.id for r in near.collect()) == [1, 2]
    assert [r.id for r in context.rank_episodes(e, 2).orderBy("n").collect()] == [1, 2]


def test_state_days(spark):
    r = spark.createDataFrame([("99",), ("0",), ("x",), ("7",), (None,)], "t string").select(memory.state_days(F.col("t")).alias("d")).collect()
    assert [x.d for x in r] == [14, 3, 3, 7, 3]


def test_forgotten(spark):
    rows = spark.createDataFrame([(1, "lost my cat today"), (1, "cat"), (1, "dog"), (2, "cat")], "user_id long, text string")
    gone = spark.createDataFrame([(1, " my cat "), (1, "  ")], "user_id long, text string")
    assert sorted((r.user_id, r.text) for r in memory.without_forgotten(rows, "text", gone).collect()) == [(1, "dog"), (2, "cat")]


def test_forgotten_by_everyone_equals_every_pair(spark, monkeypatch):
    texts = ["", None, "lost my cat today", "cat", "a", "dog", "nightcats", "x my ca", "고양이 찻집", "찻집", " y cat ", "lost my cat today"]
    phrases = ["my cat", " 찻집 ", "  ", "night", "my cat", "돌고래 찻집 앞", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    gone = spark.createDataFrame([(p,) for p in phrases], "text string")
    held = [p.strip() for p in phrases if p and p.strip()]
    want = [n for n, t in enumerate(texts) if t is None or not any(p in t.strip() or t.strip() in p for p in held)]
    stripped = rows.withColumn("text", F.trim("text"))
    assert sorted(r.n for r in memory.without_forgotten(rows, "text", gone, keys=()).collect()) == want
    monkeypatch.setattr(phrases_of, "BLOCK_CHARS", 4)  # short texts in several automata
    assert phrases_of.within({"cat", "y ca", "dog"}, held) == {"cat", "y ca"}
    own = spark.createDataFrame([(p,) for p in set(held)], "phrase string")
    assert sorted(r.n for r in phrases_of.without(stripped, "text", own, block_chars=3).collect()) == want  # many blocks
    assert memory.without_forgotten(rows, "text", gone.limit(0), keys=()).count() == len(texts)
    assert memory.without_forgotten(rows.limit(0), "text", gone, keys=()).count() == 0


ITEMS = "user_id long, kind string, id long, text string, live boolean"


def test_forget(spark):
    items = spark.createDataFrame([(1, "episode", 1, "cat show", True), (1, "episode", 2, "cat old", False), (1, "hypothesis", 3, "likes cat", True), (1, "state", 4, "cat sick", True)], ITEMS)
    cmd = "user_id long, target string, target_ids array<string>"
    gone, phrases = memory.forget(items, spark.createDataFrame([(1, "cat", ["episode:1", "junk", "state:4"])], cmd))
    assert sorted(r.id for r in gone.collect()) == [1, 4]
    assert [r.text for r in phrases.orderBy("at").collect()] == ["cat show", "cat sick", "cat"]
    gone, _ = memory.forget(items, spark.createDataFrame([(1, "cat", [])], cmd))
    assert sorted(r.id for r in gone.collect()) == [1, 3, 4]
    two = spark.createDataFrame([(1, "cat", ["episode:2"]), (1, "likes", None)], cmd)  # each command by itself
    assert sorted(r.id for r in memory.forget(items, two)[0].collect()) == [2, 3, 4]


def test_listing_and_context(spark):
    h = spark.createDataFrame([(1, 1, "m", "mentioned", None, False), (1, 2, "c", "confirmed", date(2026, 9, 1), True), (1, 3, "r", "repeated", date(2026, 9, 2), False)], "user_id long, id long, statement string, level string, last_seen date, sensitive boolean")
    e = spark.createDataFrame([(1, 1, date(2026, 9, 1), "trip", date(2026, 9, 29), False, "mid", None), (1, 2, date(2026, 9, 1), "gone", None, False, "mid", at(0))], schemas.EPISODES)
    s = spark.createDataFrame([(1, 1, "tired", at(0), at(0, day=1)), (1, 2, "over", at(0), at(1))], schemas.CURRENT_STATE)
    lines = memory.listing(h, e, s, at(19)).orderBy("section", "n").collect()
    assert [r.line for r in lines] == ["- c", "- r", "- trip (09/29)", "- 요즘: tired"]
    text = {r.user_id: r.text for r in memory.described(spark.createDataFrame([(1,), (2,)], "user_id long"), memory.listing(h, e, s, at(19))).collect()}
    assert text == {1: "\n".join((memory.LISTED, "- c", "- r", "- trip (09/29)", "- 요즘: tired", memory.LISTED_END)), 2: memory.NOTHING}
    m = spark.createDataFrame([(1, 1, at(18), "user", "hello")], "user_id long, id long, ts long, sender string, text string")
    none = spark.createDataFrame([], "user_id long, id long, text string")
    sent = reactions.sends(log_of(spark, [(at(10), "send", "recall")]), at(19), CFG)
    docs = {p: json.loads(context.documents(m, m, e, h, s, sent, none, at(19), p, CFG).first().context) for p in ("proactive", "chat")}
    c = docs["proactive"]
    assert c["now"] == "2026-09-29 (화) 19:00" and c["last_message_by"] == "user" and c["today_messages"] == [{"at": "18:00", "by": "user", "text": "hello"}]
    assert [x["statement"] for x in c["hypotheses"]] == ["r", "m"] and [x["statement"] for x in docs["chat"]["hypotheses"]] == ["c", "r", "m"]
    assert docs["chat"]["hypotheses"][0]["sensitive"] is True and "sensitive" not in c["hypotheses"][0] and "forgotten" not in c
    assert c["current_state"] == ["tired"] and c["unresolved_topics"][0]["related_date"] == "2026-09-29 (화)" and c["last_message_types"] == ["recall"] and c["today_proactive_count"] == 1
    early = reactions.sends(log_of(spark, [(at(18, 50), "send", "recall")]), at(18, 55), CFG)
    odd = m.filter("ts < 0")
    c = json.loads(context.documents(m, odd, e, h, s, early, none, at(18, 55), "chat", CFG).first().context)  # null keys stay
    assert c["recent_proactive"][0]["replied"] is None and c["last_message_at"] is None and c["last_message_by"] is None


def test_registered_context_has_forgotten_phrases(spark):
    d = "/root/testdata/sf0.001"
    got = {r.user_id: json.loads(r.context).get("forgotten") for r in catalog.queries()["context_documents"](spark, d).collect()}
    want = {}
    for r in spark.read.parquet(f"{d}/benchmark.parquet").orderBy("item_id").collect():
        want.setdefault(r.item_id // 4, []).append(r.text)
    assert got == {u: want.get(u) for u in got} and any(got.values()) and not all(got.values())


def test_schedule(spark):
    sunday, monday = D0 - 2 * DAY, D0 - DAY
    rows = [(at(14, 59), at(15)), (at(15), at(15, 30)), (sunday + 23 * 3600 + 29 * 60, sunday + 23 * 3600 + 31 * 60), (monday + 23 * 3600 + 20 * 60, monday + DAY + 600)]
    got = schedule.due(spark.createDataFrame(rows, "before long, now long"), CFG).orderBy("now").collect()
    by = {r.now: (r.proactive is not None, len(r.reflections), len(r.reviews)) for r in got}
    assert [by[n] for _, n in rows] == [(True, 0, 0), (False, 0, 0), (False, 1, 1), (True, 1, 0)]
    m = spark.createDataFrame([(at(23, 30),), (at(23, 31),), (at(1),)], "ts long")
    got = schedule.reflection_windows(m, CFG).groupBy("day").count().collect()
    assert {str(r.day): r["count"] for r in got} == {"2026-09-29": 2, "2026-09-30": 2}


def test_texts():
    text = "intro\n## 1. A\na\n## 5. B\nb\n# 16장 C\nc\n"
    assert contract.core_text(text) == "## 1. A\na\n\n# 16장 C\nc" and contract.core_text(" plain ") == "plain" and contract.load_core("/nowhere") == ""
    assert contract.prompt("x", "y") == "x\n\n---\n\ny" and contract.prompt("", "y") == "y"


def test_changes(spark):
    rows = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", None)], "user_id long, id long, t string, expires_at long")
    new = spark.createDataFrame([(1, 2, "z")], "user_id long, id long, t string")
    assert {r.id: r.t for r in scans.patch(rows, new, ("t",)).collect()} == {1: "a", 2: "z"}
    with pytest.raises(ValueError):
        scans.patch(rows, new, ("other",))
    many = spark.createDataFrame([(1, 1, 1, "x"), (1, 1, 2, "y"), (1, 1, 3, None), (1, 2, 1, None)], "user_id long, id long, seq long, t string")
    assert sorted((r.id, r.t) for r in scans.patch(rows, many, ("t",)).collect()) == [(1, "y"), (2, "b")]
    assert sorted((r.id, r.t) for r in scans.patch(rows, many, ("t",), nulls=True).collect()) == [(1, None), (2, None)]
    kept, gone = scans.purge(rows, 5)
    assert [r.id for r in kept.collect()] == [2] and gone.first().purged == 1
    assert scans.delete(rows, new).count() == 1 and scans.replace(rows, rows.filter("id = 2").withColumn("t", F.lit("q"))).filter("t = 'q'").count() == 1


def test_silent_day(spark):
    ticks = spark.createDataFrame([(1, at(h)) for h in range(24)], "user_id long, ts long")
    got = simulate.simulate(spark.createDataFrame([], "user_id long, ts long"), ticks, CFG).orderBy("ts").collect()
    assert [r.ts for r in got if r.decision == "SEND"] == [at(9), at(13)] and len(got) == 24


def test_repeat_type():
    f = simulate.Feedback(CFG)
    recall = lambda *_: ("recall", "x")
    assert f.tick(1, at(9), recall)[0] == "SEND" and f.tick(1, at(14), recall)[1] == "repeat_type"


def test_slots_agree_with_simulation_rules(spark):
    rows = [(at(9), "send", "recall"), (at(9, 10), "user", None), (at(12), "send", "playful"), (at(16), "send", "recall")]
    log = log_of(spark, rows)
    none = spark.createDataFrame([], NO_SETTINGS)
    got = {r.ts: r.reason for r in gate.check_slots(log, none, at(0), at(24), CFG).collect()}
    for h in range(24):
        if rows[0][0] <= at(h):
            assert got[at(h)] == reason(spark, rows, at(h)), h


def test_slots_after_a_long_past(spark):
    past = [(at(9, day=-30), "send", "recall"), (at(9, 5, day=-30), "user", None), (at(12, day=-20), "send", "recall"), (at(18, day=-15), "assistant", None)]
    week = [(at(10, day=-7), "send", "recall"), (at(10, 59, day=-7), "user", None), (at(13, day=-5), "send", "recall"), (at(22, 30, day=-1), "send", "recall"), (at(15, day=2), "user", None)]
    none = spark.createDataFrame([], NO_SETTINGS)
    for rows in (past, past[:1], past[:2], past[3:], past + week, week):
        log = log_of(spark, rows)
        got = {r.ts: (r.reason, r.samples, r.sent_today, r.daily_max) for r in gate.check_slots(log, none, at(0), at(24), CFG).collect()}
        assert len(got) == 24
        for h in (0, 9, 12, 13, 23):
            if rows[0][0] > at(h):
                continue
            f = gate.check(log, none, at(h), CFG).collect()[0]
            assert got[at(h)] == (f.reason, f.samples, f.sent_today, f.daily_max), (rows, h)


def test_streaming_equals_batch(spark, tmp_path):
    from tidemark import streaming

    rows = [(at(9), "send", "recall"), (at(9, 10), "user", None), (at(12), "send", "playful"), (at(13, 5), "user", None), (at(20), "user", None)]
    log = log_of(spark, rows)
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = streaming.replies(stream, CFG).writeStream.outputMode("append").format("memory").queryName("replied").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.ts, r.replied) for r in spark.table("replied").collect()}
    assert got == {(r.ts, r.replied) for r in reactions.sends(log, at(23), CFG).collect()}


def test_streaming_slots_start_anew_at_midnight(spark, tmp_path):
    from dataclasses import replace

    from tidemark import streaming

    cfg = replace(CFG, slot=5 * 3600)
    log = log_of(spark, [(at(21), "user", None), (at(23), "send", "recall"), (at(0, 10, 1), "user", None), (at(4, 0, 1), "user", None), (at(5, 0, 1), "user", None), (at(23, 0, 3), "user", None)])
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = streaming.slot_counts(stream, cfg).writeStream.outputMode("append").format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {(r.slot, r.kind): r.n for r in spark.table("slots").collect()}
    finally:
        q.stop()
    assert got == {(at(20), "user"): 1, (at(20), "send"): 1, (at(0, 0, 1), "user"): 2, (at(5, 0, 1), "user"): 1}
