"""The registered queries as plain SQL over the supplied tables, written apart from the DataFrame code."""

from __future__ import annotations

DAY = 86_400
TYPES = ("follow_up", "observation", "recall", "sharing", "check_in", "playful", "recommendation")


def sql(as_of: int, start: int, end: int, episode_day: int) -> dict[str, str]:
    today, week = as_of - as_of % DAY, as_of - 7 * DAY
    types = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
    log = f"""log as (select user_id, event_id as id, epoch_us(ts) // 1000000 as ts, cast(json_extract_string(props, '$.k') as int) as k, event_type,
        case event_type when 'view' then 'send' when 'error' then 'assistant' else 'user' end as kind,
        case when event_type = 'view' then {types}[cast(json_extract_string(props, '$.k') as int) % 7 + 1] end as message_type from events)"""

    def sends(slot: int, until: int = as_of) -> str:
        return f"""raw as (select *, least(ts - ts % {DAY} + ((ts % {DAY}) // {slot} + 1) * {slot}, ts - ts % {DAY} + {DAY}) as fin from log where kind = 'send' and ts <= {until}),
        rep as (select r.user_id, r.id, min(u.ts) as reply_ts from raw r join log u on u.user_id = r.user_id and u.kind = 'user' and u.ts >= r.ts and u.ts < r.fin and u.ts <= {until} group by 1, 2),
        sent as (select r.user_id, r.id, r.ts, r.message_type, r.fin, p.reply_ts, case when p.reply_ts is not null then true when r.fin <= {until} then false end as replied,
            (p.reply_ts - r.ts) // 60 as delay_minutes from raw r left join rep p on p.user_id = r.user_id and p.id = r.id)"""

    six, hour = f"with {log}, {sends(21600)}", f"with {log}, {sends(3600)}"
    rate = f"rate as (select user_id, avg(case when replied then 1.0 else 0.0 end)::double as rate, count(*) as samples from sent where ts >= {week} and replied is not null group by 1)"
    settings = f"""setting as (select distinct user_id, case when user_id % 7 = 3 then 1200 else 540 end as h0, case when user_id % 7 = 3 then 660 else 1380 end as h1,
        case when user_id % 11 = 5 then {as_of + 3600} when user_id % 11 = 6 then {as_of - 60} end as quiet,
        case user_id % 3 when 0 then 'low' when 1 then 'normal' else 'high' end as freq from events)"""
    today_n = f"""ok as (select user_id, max(id) as ok_id from sent where ts >= {today} and replied group by 1),
        streak as (select s.user_id, count(*) as n from sent s left join ok using (user_id) where s.ts >= {today} and (ok_id is null or s.id > ok_id) group by 1)"""
    most = "least(case freq when 'low' then 2 when 'high' then 6 else 4 end, case when samples >= 3 and rate < 0.2 then 1 when samples >= 3 and rate < 0.5 then 2 end)"
    feats = f"""{rate}, {settings}, {today_n},
        f as (select h.user_id, t.freq, t.h0, t.h1, t.quiet, r.rate, coalesce(r.samples, 0) as samples, coalesce(c.sent_today, 0) as sent_today, coalesce(c.sent_7d, 0) as sent_7d,
            coalesce(k.n, 0) as unanswered, c.last_send, c.last_ok, h.last_ts
          from (select user_id, max(ts) as last_ts from log where ts <= {as_of} group by 1) h left join setting t using (user_id) left join rate r using (user_id)
          left join (select user_id, count(*) filter (ts >= {today}) as sent_today, count(*) filter (ts >= {week}) as sent_7d, max(ts) as last_send, arg_max(coalesce(replied, false), id) as last_ok from sent group by 1) c using (user_id)
          left join streak k using (user_id))"""

    def reason(now: str) -> str:
        return f"""case when quiet > {now} then 'gate_do_not_disturb'
            when not (case when h0 <= h1 then ({now} % {DAY}) >= h0 * 60 and ({now} % {DAY}) < h1 * 60 else ({now} % {DAY}) >= h0 * 60 or ({now} % {DAY}) < h1 * 60 end) then 'gate_active_hours'
            when sent_today >= daily_max then 'gate_daily_max' when {now} - last_ts < 5400 then 'gate_recent_message'
            when not last_ok and {now} - last_send < 14400 then 'gate_unanswered_wait' when unanswered >= 2 then 'gate_consecutive_unanswered' end"""

    slots = f"""{settings}, tick as (select user_id, cast(t.range as bigint) as tk from (select distinct user_id from log), range({start}, {end}, 21600) t),
        heard as (select k.user_id, k.tk, max(l.ts) as last_ts from tick k join log l on l.user_id = k.user_id and l.ts <= k.tk group by 1, 2),
        past as (select k.user_id, k.tk, s.id, s.ts, case when s.ts < k.tk then coalesce(s.replied, false) else false end as ok, s.ts < k.tk as final
                 from tick k join sent s on s.user_id = k.user_id and s.ts <= k.tk),
        agg as (select user_id, tk, count(*) filter (final and ts >= tk - {7 * DAY}) as samples, avg(case when ok then 1.0 else 0.0 end) filter (final and ts >= tk - {7 * DAY})::double as rate,
                 count(*) filter (ts >= tk - tk % {DAY}) as sent_today, max(id) filter (ok and ts >= tk - tk % {DAY}) as ok_id, max(ts) as last_send, arg_max(ok, id) as last_ok from past group by 1, 2),
        runs as (select p.user_id, p.tk, count(*) as n from past p join agg a on a.user_id = p.user_id and a.tk = p.tk where p.ts >= p.tk - p.tk % {DAY} and (a.ok_id is null or p.id > a.ok_id) group by 1, 2),
        f as (select k.user_id, k.tk as ts, coalesce(samples, 0) as samples, rate, coalesce(sent_today, 0) as sent_today, coalesce(n, 0) as unanswered, last_send, last_ok, last_ts, freq, h0, h1, quiet
              from tick k left join heard using (user_id, tk) left join agg using (user_id, tk) left join runs using (user_id, tk) left join setting using (user_id)),
        g as (select *, {most} as daily_max from f),
        by_slot as (select user_id, ts, samples, rate, sent_today, unanswered, daily_max, {reason('ts')} as reason from g)"""
    every = f"with {log}, {sends(21600, 1 << 60)}"

    episode = f"""ep as (select cast(o_custkey as bigint) as user_id, cast(o_orderkey as bigint) as id, cast(o_orderdate as date) as date, 'order ' || o_orderstatus as summary, ship as related_date,
          ship is null or ship < cast(o_orderdate as date) as resolved,
          case when left(o_orderpriority, 1) in ('1', '2') then 'high' when left(o_orderpriority, 1) = '4' then 'low' else 'mid' end as importance
        from orders left join (select l_orderkey, cast(min(l_shipdate) as date) as ship from lineitem group by 1) on o_orderkey = l_orderkey),
        episode as (select *, case when related_date is not null then date_diff('day', date '1970-01-01', related_date) * {DAY} + {7 * DAY}
          else date_diff('day', date '1970-01-01', date) * {DAY} + case when importance = 'high' then 60 else 30 end * {DAY} end as expires_at from ep)"""
    update = """upd as (select user_id, id as seq, date '1970-01-01' + cast(ts // 86400 as int) as day, 's' || (k // 5) as statement,
          case when event_type = 'error' then 'contradict' when k % 2 = 0 then 'new' else 'support' end as obs, k % 17 = 0 as stated, k % 13 = 0 as sensitive from log),
        born as (select user_id, statement, min(seq) as born from upd where obs = 'new' group by 1, 2),
        hyp as (select user_id, statement, born as id, case when bool_or(stated and obs <> 'contradict' and seq > born) then 'confirmed'
            when count(distinct case when obs <> 'contradict' then day end) >= 2 then 'repeated' else 'mentioned' end as level,
          count(distinct case when obs <> 'contradict' then day end) as evidence, count(distinct case when obs = 'contradict' then day end) as contradictions,
          max(day) as last_seen, bool_or(sensitive) as sensitive from upd join born using (user_id, statement) where seq >= born group by 1, 2, 3)"""
    blank = "[\\s　\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}]"
    strip = lambda c: f"regexp_replace({c}, '^{blank}+|{blank}+$', '', 'g')"
    turns = f"with turn as (select conv_id as user_id, turn as seq, text, {as_of} as ts, turn % 6 as n, turn % 11 = 0 as bad from conversations where role = 'user')"
    fallback = "앗, 잠깐 말이 꼬였어. 한 번만 다시 말해줄래?"
    chat = f"""eff as (select user_id, seq, 1 as step, 'store_user' as effect, text as value from turn
          union all select user_id, seq, 2, 'track_reaction', cast(ts as varchar) from turn
          union all select user_id, seq, 3, 'forget', '{{"target":"tea","target_ids":["episode:1"]}}' from turn where n = 0 and not bad
          union all select user_id, seq, 3, 'list', null from turn where n = 1 and not bad
          union all select user_id, seq, 4, 'quiet_until', case n when 2 then '1705762800' else '1705795200' end from turn where n in (2, 3) and not bad
          union all select user_id, seq, 5, 'frequency', case n when 1 then 'low' else 'high' end from turn where n in (1, 4) and not bad
          union all select user_id, seq, unnest([6, 7]), unnest(['send', 'store_reply']), case when bad or n = 5 then '{fallback}' else 'ok' end from turn
          union all select user_id, seq, 8, 'track_continuation', cast(ts as varchar) from turn)"""
    return {
        "response_rate_7d": f"{six}, {rate} select * from rate",
        "response_rate_7d_1h": f"{hour}, {rate} select * from rate",
        "reply_attribution": f"{six} select user_id, id, ts, fin, reply_ts, replied, delay_minutes from sent",
        "consecutive_unanswered": f"{six}, {today_n} select user_id, n from streak",
        "conversation_continued": f"""{six}, nxt as (select user_id, id, replied, lead(id) over (partition by user_id order by ts, id) as stop from sent)
            select n.user_id, n.id, coalesce(any_value(n.replied), false) and count(l.id) >= 3 as continued from nxt n left join log l on l.user_id = n.user_id and l.id > n.id and l.ts <= {as_of} and (n.stop is null or l.id < n.stop) group by 1, 2""",
        "reply_length_bucket": f"select case when length({strip('text')}) <= 10 then 'short' when length({strip('text')}) >= 80 then 'long' else 'normal' end as bucket, count(*) as n from conversations where role = 'user' group by 1",
        "reply_delay_histogram": f"{six} select delay_minutes // 60 as hours, count(*) as n, cast(sum(delay_minutes) as bigint) as minutes from sent where replied group by 1",
        "repeat_type_lag": f"{six} select user_id, id, message_type from (select *, lag(message_type) over (partition by user_id order by ts, id) as before from sent) where before = message_type",
        "gate_reason_asof": f"{six}, {feats}, g as (select *, {most} as daily_max from f) select user_id, rate, samples, sent_today, unanswered, daily_max, {reason(str(as_of))} as reason from g",
        "gate_reason_by_slot": f"{every}, {slots} select * from by_slot",
        "daily_max_now": f"{six}, {feats} select user_id, freq as preferred_frequency, {most} as daily_max from f",
        "skip_reason_counts": f"{every}, {slots} select case when reason is null then 'SEND' else 'SKIP' end as decision, reason, count(*) as n from by_slot group by all",
        "weekly_stats": f"{six}, {feats} select user_id, sent_7d, rate, samples, {most} as daily_max from f",
        "activity_hours": f"with {log} select user_id, lpad(cast(ts % {DAY} // 3600 as varchar), 2, '0') as hour, count(*) as n from log where kind = 'user' and ts >= {week} group by 1, 2",
        "messages_between": f"with {log} select user_id, id, ts, kind from log where ts >= {today} and ts < {as_of + 1}",
        "recent_messages_topk": f"with {log} select user_id, id, ts, kind, cast(row_number() over (partition by user_id order by ts desc, id desc) as int) as n from log where ts <= {as_of} qualify n <= 20",
        "today_tail": f"with {log} select user_id, id, cast(row_number() over (partition by user_id order by ts desc, id desc) as int) as n from log where ts >= {today} and ts <= {as_of} qualify n <= 20",
        "last_message": f"with {log} select user_id, max(id) as id, max(ts) as ts, arg_max(kind, id) as kind from log where ts <= {as_of} group by 1",
        "recent_sends_types": f"""{six}, r as (select *, cast(row_number() over (partition by user_id order by ts desc, id desc) as int) as n from sent)
            select user_id, string_agg(message_type, ',' order by n desc) filter (n <= 2) as last_types, cast(count(*) as int) as n from r where n <= 5 group by 1""",
        "pending_sends": f"with {log}, {sends(21600, as_of + 7200)} select user_id, id from sent where replied is null",
        "messages_after": f"{six}, a as (select user_id, max(id) as after from sent group by 1) select user_id, count(*) as n from log join a using (user_id) where id > after group by 1",
        "settings_defaults": f"""with {settings} select user_id, case when user_id % 5 = 0 then 'normal' else freq end as preferred_frequency,
            case when user_id % 5 = 0 then 540 else h0 end as start, case when user_id % 5 = 0 then 1380 else h1 end as "end" from setting""",
        "episode_build": f"with {episode} select user_id, id, cast(date as varchar) as date, summary, cast(related_date as varchar) as related_date, resolved, importance, expires_at from episode",
        "active_episodes": f"with {episode} select user_id, id, expires_at from episode where expires_at > {episode_day}",
        "purge_counts": f"with {episode} select user_id, count(*) as purged from episode where expires_at <= {episode_day} group by 1",
        "episode_rank": f"""with {episode} select user_id, id, cast(row_number() over (partition by user_id order by resolved, case importance when 'high' then 0 when 'mid' then 1 else 2 end, date desc, id desc) as int) as n
            from episode where expires_at > {episode_day} qualify n <= 5""",
        "unresolved_near": f"with {episode} select user_id, id from episode where not resolved and abs(date_diff('day', date + 1, related_date)) <= 2",
        "episode_resolve": f"with {episode} select user_id, count(*) filter (resolved or (id % 3 = 0 and expires_at > {episode_day})) as resolved, count(*) as n from episode group by 1",
        "state_clamp": """select event_id, case when event_id % 7 = 0 then 3 when k < 1 then 3 else least(k, 14) end as days
            from (select event_id, cast(json_extract_string(props, '$.k') as bigint) - 5 as k from events)""",
        "hypothesis_levels": f"with {log}, {update} select user_id, statement, level, evidence, contradictions, cast(last_seen as varchar) as last_seen, sensitive, id from hyp",
        "hypothesis_rank": f"""with {log}, {update} select user_id, id, level, cast(row_number() over (partition by user_id order by case level when 'confirmed' then 0 when 'repeated' then 1 else 2 end, last_seen desc nulls last, id) as int) as n
            from hyp where not sensitive qualify n <= 8""",
        "contradicted_delete": f"with {log}, {update} select user_id, statement from hyp where contradictions > evidence",
        "hypothesis_fold": f"with {log}, {update} select user_id, statement, level, cast(evidence as int) as evidence, cast(contradictions as int) as contradictions, cast(last_seen as varchar) as last_seen, sensitive from hyp",
        "forgotten_filter": f"select doc_id from documents d where not exists (select 1 from benchmark b where {strip('b.text')} <> '' and (contains({strip('d.text')}, {strip('b.text')}) or contains({strip('b.text')}, {strip('d.text')})))",
        "memory_listing": f"""with {log}, {update}, {episode}
            select user_id, 1 as section, id as n, '- ' || statement as line from hyp where level <> 'mentioned'
            union all select user_id, 2, id, '- ' || summary || coalesce(' (' || strftime(related_date, '%m/%d') || ')', '') from episode where not resolved and expires_at > {episode_day}
            union all select user_id, 3, seq, '- 요즘: ' || statement from upd where stated""",
        "reflection_upsert": f"with {log} select user_id, cast(date '1970-01-01' + cast(ts // {DAY} as int) as varchar) as date, arg_max(kind, id) as kind, max(id) as seq from log group by 1, 2",
        "ordered_dedup": f"with {log} select user_id, message_type, min(id) as ordinal from log where message_type is not null group by 1, 2",
        "slot_calendar": f"""with {log}, d as (select cast(range as bigint) as day from range({start}, {end}, {DAY})), w as (select cast(range as bigint) as tk from range(0, {DAY}, 18000))
            select user_id, day + tk as ts from (select distinct user_id from log), d, w where day + tk >= {start + 5 * 3600} and day + tk < {end}""",
        "weekday_trigger": f"""with x as (select {start} + range * 3600 as before, {start} + (range + 7) * 3600 as now from range(0, {14 * 24}, 7)),
            y as (select *, now - now % 3600 as slot, now - now % {DAY} + 84600 as r1, now - now % {DAY} + 84600 - {DAY} as r0 from x),
            z as (select *, before < r0 and r0 <= now as c0, before < r1 and r1 <= now as c1 from y)
            select before, now, case when before < slot and slot <= now then now else 0 end as proactive, cast(c0 as int) + cast(c1 as int) as reflections,
              cast(c0 and (r0 // {DAY} + 3) % 7 = 6 as int) + cast(c1 and (r1 // {DAY} + 3) % 7 = 6 as int) as reviews from z""",
        "reflection_windows": f"""with {log}, w as (select (ts + 1800 - 1) // {DAY} as day from log union all select (ts + 1800) // {DAY} from log where (ts + 1800) % {DAY} = 0)
            select cast(date '1970-01-01' + cast(day as int) as varchar) as day, count(*) as n from w group by 1""",
        "shown_times": f"""with {log}, t as (select user_id, make_timestamp(max(ts) * 1000000) as t from log group by 1)
            select user_id, strftime(t, '%Y-%m-%d (') || substr('월화수목금토일', cast(isodow(t) as int), 1) || strftime(t, ') %H:%M') as shown from t""",
        "reflections_since": f"with {log} select user_id, cast(date '1970-01-01' + cast(ts // {DAY} as int) as varchar) as date, max(id) as seq from log where ts >= {week - week % DAY} group by 1, 2",
        "has_reflection": f"with {log} select user_id, bool_or(ts >= {today} and ts < {today + DAY}) as reflected from log group by 1",
        "reflection_events": f"""with {episode} select user_id, cast(row_number() over (partition by user_id, date order by id) - 1 as int) as id, cast(date as varchar) as date, summary, cast(related_date as varchar) as related_date, resolved, importance, expires_at from episode""",
        "reflection_resolved": "select cast(o_custkey as bigint) as user_id, cast(o_orderkey as bigint) as id from orders where o_orderkey % 2 = 0",
        "hypothesis_match": f"""with {log}, {update}, v as (select user_id, seq, case when seq % 3 = 0 then seq end as id, 's' || (cast(substr(statement, 2) as int) + seq % 2 * 15) as statement, obs from upd),
            t as (select user_id, statement, min(id) as id from hyp group by 1, 2)
            select v.user_id, v.seq, case when h.id is null and t.id is not null and obs = 'new' then 'support' else obs end as observation, coalesce(h.id, t.id) as hypothesis_id
            from v left join hyp h on h.user_id = v.user_id and h.id = v.id left join t on t.user_id = v.user_id and t.statement = v.statement""",
        "change_replay": f"""with {log}, c as (select user_id, cast(k % 10 as bigint) as key, id as seq, case when k % 5 < 2 then 'put' when k % 5 = 4 then 'delete' else 'patch' end as op, case when k % 7 <> 0 then kind end as kind, k from log where ts <= {as_of}),
            p as (select user_id, key, max(seq) as put from c where op = 'put' group by 1, 2),
            g as (select p.* from p left join (select user_id, key, max(seq) as del from c where op = 'delete' group by 1, 2) x using (user_id, key) where del is null or put > del),
            w as (select g.user_id, g.key, max(seq) as seq from g join c using (user_id, key) where op in ('put', 'patch') group by 1, 2)
            select g.user_id, g.key as id, a.kind, b.k from g join w on w.user_id = g.user_id and w.key = g.key join c a on a.user_id = g.user_id and a.seq = w.seq join c b on b.user_id = g.user_id and b.seq = g.put""",
        "user_message_times": f"with {log} select user_id, ts from log where kind = 'user' and ts >= {week}",
        "live_states": f"with {log} select user_id, row_number() over (partition by user_id order by ts desc, id desc) as n, id, 's' || k as statement from log where k % 17 = 0 and ts + {3 * DAY} > {as_of}",
        "settings_patch": f"""with {settings} select user_id, case when user_id % 5 = 0 then 'high' else freq end as preferred_frequency,
            case when user_id % 5 <> 0 then quiet end as do_not_disturb_until from setting""",
        "forget_commands": f"""with {episode} select user_id, 'episode' as kind, min(id) as id from episode where user_id % 10 = 0 group by 1
            union all select user_id, 'episode', id from episode where user_id % 10 = 1 and contains(summary, 'order F') and (expires_at is null or expires_at > {episode_day})""",
        "iso_times": f"with {log} select user_id, strftime(make_timestamp(max(ts) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+09:00' as at from log group by 1",
        "by_id": f"with {episode} select user_id, id, summary from episode where id % 100 = 1",
        "memory_described": f"""with {log}, {update}, {episode}, l as (select user_id, 1 as section, id as n, '- ' || statement as line from hyp where level <> 'mentioned'
            union all select user_id, 2, id, '- ' || summary || coalesce(' (' || strftime(related_date, '%m/%d') || ')', '') from episode where not resolved and expires_at > {episode_day}
            union all select user_id, 3, seq, '- 요즘: ' || statement from upd where stated)
            select u.user_id, coalesce('내가 기억하고 있는 건 이 정도야:' || chr(10) || string_agg(line, chr(10) order by section, n, line) || chr(10) || '지우고 싶은 게 있으면 말해줘.', '아직 따로 기억해 둔 건 없어.') as text
            from (select distinct user_id from log) u left join l using (user_id) group by 1""",
        "chat_effects": f"{turns}, {chat} select user_id, seq, step, effect, value from eff",
        "chat_frequency": f"{turns}, {chat} select user_id, arg_max(value, seq) as preferred_frequency from eff where effect = 'frequency' group by 1",
    }
