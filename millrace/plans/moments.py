"""Registered queries on what holds at a moment and on chained streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import fixtures as fx
from millrace.operators import timeline
from millrace.streaming import chained, lifetimes, reuse, run

_M = fx.MACHINES
#: Running digests of a snapshot, from the number in its event.
_RUNNING = ("k % 20", "(k + 7) % 20", "(k * 3) % 20")
#: What an event is on the streams: heartbeats with a list of grants, or an action on one of eight grants of a machine.
_ACTION = {"signup": "grant", "click": "renew", "purchase": "free", "view": "report", "error": "report"}


def _held(s, d):
    tasks = fx.grants(s, d).select("servant", "started_at", F.expr("started_at + make_dt_interval(cast(grant_id % 5 as int))").alias("ended_at"))
    asked = fx.requests(s, d).select("request_id", "submitted_at", F.expr(f"cast(request_id % {_M} as bigint)").alias("servant"))
    held = timeline.held_at(asked, tasks, ["servant"], at="submitted_at", start="started_at", end="ended_at", bucket=30 * 86_400)
    limits = fx.servants(s, d).selectExpr("registry_ord - 1 as servant", "max_tasks", "memory_available_gib")
    return timeline.admitted(held, limits, ["servant"]).select("request_id", "servant", "held", "admitted")


def _as_of(s, d):
    beats = fx.heartbeats(s, d)
    shots = beats.where("kind in ('view', 'error')").selectExpr("servant", "ts", "event_id as snapshot_id", f"array({', '.join(_RUNNING)}) as running")
    asked = beats.where("kind in ('click', 'purchase')").selectExpr("event_id as request_id", "servant", "ts", "k % 20 as digest")
    got = timeline.as_of(asked, shots, ["servant"], at="ts", order="snapshot_id", fresh="12 hours")
    return got.select("request_id", "servant", F.col("seen.snapshot_id").alias("snapshot_id"), F.coalesce(F.array_contains("seen.running", F.col("digest")), F.lit(False)).alias("reused"))


def _queue(s, d):
    waiters = fx.requests(s, d).select(F.col("request_id").alias("waiter_id"), F.col("submitted_at").alias("ts"), F.expr(f"cast(request_id % {_M} as bigint)").alias("servant"))
    grants = fx.grants(s, d).where("is_prefetch").select("grant_id", "servant", F.col("started_at").alias("ts"))
    return timeline.match_queues(waiters, grants, ["servant"], at="ts", lifetime="2 days", bucket=30 * 86_400).select("waiter_id", "servant", "grant_id")


def _events(s, d):
    return run.table_stream(s, d, "events").selectExpr(
        "cast(ts as timestamp) as ts", f"user_id % {_M} as servant", "event_id", "event_type as kind", "cast(get_json_object(props, '$.k') as bigint) as k")


def _ends(s, d):
    action = F.element_at(F.create_map(*[F.lit(x) for pair in _ACTION.items() for x in pair]), F.col("kind"))
    lease = F.expr("case when kind not in ('view', 'error') then k * 900000 when k < 10 then 0 else 48 * 3600000 end")
    rows = _events(s, d).select("servant", "ts", "event_id", action.alias("action"), (F.col("k") % 8).alias("grant_id"), lease.cast("long").alias("lease_ms"), F.expr("filter(sequence(0L, 7L), i -> getbit(k, cast(i as int)) = 1)").alias("running"))
    return run.available_now(chained.grant_ends(rows))


def _reused(s, d):
    """Answers whose watermark has come; the newest requests still wait for theirs."""
    requests = _events(s, d).where("kind in ('click', 'purchase')").selectExpr("event_id as request_id", "k % 20 as digest", "ts")
    reports = _events(s, d).where("kind in ('view', 'error')").selectExpr(
        "event_id as grant_id", "(k * 7) % 20 as digest", "ts as started_at", "ts + make_dt_interval(0, cast(k % 12 as int)) as ends_at",
        "explode(array(ts, ts + interval 10 minutes, ts + interval 20 minutes)) as seen")
    return run.available_now(reuse.in_flight(requests, reports)).select("request_id", "digest", "reused_grant", "outcome")

#: What an event does to a task, by its kind and whether its number is even.
_LIVES = {"signup": ("queue", "run"), "click": ("start", "share"), "view": ("alive", "alive"), "purchase": ("done", "fetch"), "error": ("free", "gone")}
_HOUR = 3_600_000
_ALIVE_H, _KEEP_H = 48, 36


def _lives(s, d):
    """Tasks of users: each user's events are the actions on one task after the other."""
    action = F.coalesce(*[F.when(F.col("kind") == x, F.when(F.col("k") % 2 == 0, even).otherwise(odd)) for x, (even, odd) in _LIVES.items()])
    rows = run.table_stream(s, d, "events").selectExpr("user_id as task_id", "cast(ts as timestamp) as ts", "event_id", "event_type as kind", "cast(get_json_object(props, '$.k') as bigint) as k")
    rows = rows.select("task_id", "ts", "event_id", action.alias("action"), F.expr(f"(k % 40) * {_HOUR}L").alias("start_ms"))
    return run.available_now(lifetimes.task_ends(rows, alive_ms=_ALIVE_H * _HOUR, keep_ms=_KEEP_H * _HOUR))


QUERIES = {
    "p21_admission_at": _held,
    "t8_asof_reuse": _as_of,
    "t6_grant_queue": _queue,
    "t2_grant_ends_stream": _ends,
    "j17_in_flight_stream": _reused,
    "t15_task_lives_stream": _lives,
}

_v = fx.with_views
_R = f"r as (select request_id, submitted_at, (request_id % {_M})::bigint as servant from requests)"
SQL = {
    "p21_admission_at": _v(f"""with {_R}, t as (select servant, started_at, started_at + to_days((grant_id % 5)::int) as ended_at from grants),
  h as (select r.*, (select count(*) from t where t.servant = r.servant and t.started_at <= r.submitted_at and r.submitted_at < t.ended_at) as held from r)
  select request_id, servant, held, coalesce((select held + 1 <= max_tasks and memory_available_gib >= 2 from servants where registry_ord - 1 = servant), false) as admitted from h""",
        "requests", "grants", "servants"),
    "t8_asof_reuse": _v(f"""with q as (select event_id as request_id, servant, ts, k % 20 as digest from heartbeats where kind in ('click', 'purchase')),
  a as (select q.*, (select max(struct_pack(ts := h.ts, id := h.event_id, running := [{', '.join(x.replace('k', 'h.k') for x in _RUNNING)}])) from heartbeats h
    where h.kind in ('view', 'error') and h.servant = q.servant and h.ts <= q.ts and h.ts >= q.ts - interval 12 hours) as seen from q)
  select request_id, servant, seen.id as snapshot_id, coalesce(list_contains(seen.running, digest), false) as reused from a""", "heartbeats"),
    "t6_grant_queue": "with recursive" + _v(f"""with {_R}, g as (select servant, grant_id, started_at as at, row_number() over (partition by servant order by started_at, grant_id) as place from grants where is_prefetch),
  w as (select request_id as waiter_id, servant, submitted_at as at, row_number() over (partition by servant order by submitted_at, request_id) as n,
    (select count(*) from g where g.servant = r.servant and g.at <= r.submitted_at) as there, (select count(*) from g where g.servant = r.servant and g.at + interval 2 days <= r.submitted_at) as over from r),
  p(servant, waiter_id, n, gone, place) as (select distinct servant, -1::bigint, 0::bigint, 0::bigint, null::bigint from w union all
    select w.servant, w.waiter_id, w.n, case when greatest(p.gone, w.over) < w.there then greatest(p.gone, w.over) + 1 else greatest(p.gone, w.over) end,
      case when greatest(p.gone, w.over) < w.there then greatest(p.gone, w.over) + 1 end from p join w on w.servant = p.servant and w.n = p.n + 1)
  select p.waiter_id, p.servant, g.grant_id from p left join g on g.servant = p.servant and g.place = p.place where p.n > 0""", "requests", "grants")[4:],
    # every row and change of a machine gets a place; a grant's renewals hold up to the first that comes too late
    "t2_grant_ends_stream": _v("""with b as (select servant, epoch_us(ts) as "at", event_id, k, k % 8 as grant_id, case kind when 'signup' then 'grant' when 'click' then 'renew' when 'purchase' then 'free' else 'report' end as action, k * 900000000 as lease from heartbeats),
  horizon as (select (max("at") // 1000 - 5) * 1000 as upto from b),
  n as (select *, lag("at") over w as before, lag(k) over w as k_before, lead("at") over w as after, lead(k) over w as k_after from b where action = 'report' window w as (partition by servant order by "at", event_id)),
  changes as (select servant, "at", event_id, 0 as rank, 'up' as action from n where k >= 10 and (before is null or k_before < 10 or "at" > before + 172800000000)
    union all select servant, case when after <= "at" + 172800000000 then after else "at" + 172800000000 end, case when after <= "at" + 172800000000 then event_after else 4611686018427387904 end, 2, 'down'
    from (select *, lead(event_id) over (partition by servant order by "at", event_id) as event_after from n) where k >= 10 and (after is null or after > "at" + 172800000000 or k_after < 10)),
  every as (select *, row_number() over (partition by servant order by "at", event_id, rank) as seq from (
    select servant, "at", event_id, 1 as rank, action, grant_id, k, lease from b union all select servant, "at", event_id, rank, action, null, null, null from changes) where "at" <= (select upto from horizon)),
  state as (select *, last_value(case when action in ('up', 'down') then action end ignore nulls) over (partition by servant order by seq) as machine from every),
  opened as (select servant, grant_id, "at" as granted_at, seq, "at" + lease as until from state where action = 'grant' and machine = 'up'),
  closers as (select servant, grant_id, seq, "at", case action when 'free' then 'freed' else 'replaced' end as outcome from state where action = 'free' or action = 'grant' and machine = 'up'),
  shut as (select o.*, (select min(struct_pack(seq := c.seq, "at" := c."at", outcome := c.outcome)) from (select servant, grant_id, seq, "at", outcome from closers union all
      select servant, x, seq, "at", 'orphaned' from state, range(8) t(x) where action = 'down') c where c.servant = o.servant and c.grant_id = o.grant_id and c.seq > o.seq) as stop from opened o),
  renewals as (select s.servant, s.grant_id, s.seq, e."at", e.seq as n, e."at" + e.lease as until, lag(e."at" + e.lease, 1, s.until) over (partition by s.servant, s.grant_id, s.seq order by e.seq) as needed
    from shut s join state e on e.servant = s.servant and e.grant_id = s.grant_id and e.action = 'renew' and e.seq > s.seq and (s.stop is null or e.seq < s.stop.seq)),
  good as (select servant, grant_id, seq, count(*) as renewals, max_by(until, n) as until from (select *, max(case when "at" > needed then 1 else 0 end) over (partition by servant, grant_id, seq order by n) as broken from renewals) where broken = 0 group by all),
  leased as (select s.servant, s.grant_id, s.granted_at, s.seq, s.stop, coalesce(g.until, s.until) as until, coalesce(g.renewals, 0) as renewals from shut s left join good g on g.servant = s.servant and g.grant_id = s.grant_id and g.seq = s.seq),
  ended as (select l.*, coalesce((select min(struct_pack(seq := e.seq, "at" := e."at", outcome := 'swept')) from state e where e.servant = l.servant and e.action = 'report' and e.seq > l.seq and e."at" > l.until
      and (l.stop is null or e.seq < l.stop.seq) and (e.k >> l.grant_id) & 1 = 0), stop) as fin from leased l)
  select servant, grant_id, granted_at, until as "at", 'zombie' as outcome, renewals from ended where until <= (select upto from horizon) and (fin is null or until < fin."at")
  union all select servant, grant_id, granted_at, fin."at", fin.outcome, renewals from ended where fin is not null""", "heartbeats"),
    # the rows of a task one after the other: what is held before a row is the state after the one ahead, unless its deadline has passed
    "t15_task_lives_stream": "with recursive" + f""" h as (select (max(epoch_us(ts)) // 1000 - 1) * 1000 as upto from events),
  e as (select user_id as task_id, epoch_us(ts) as "at", k % 40 * 3600000000 as start, row_number() over (partition by user_id order by ts, event_id) as n,
    case event_type {' '.join(f"when '{x}' then case when k % 2 = 0 then '{even}' else '{odd}' end" for x, (even, odd) in _LIVES.items())} end as action
    from (select *, json_extract_string(props, '$.k')::bigint as k from events) where epoch_us(ts) <= (select upto from h)),
  every as (select * from e union all select task_id, upto + 1, 0, max(n) + 1, 'end' from e, h group by task_id, upto),
  s(task_id, n, "at", born, phase, due, clients, closed, how, held_born, held_clients, late, late_how, late_born, late_clients) as (
    select distinct task_id, 0::bigint, 0::bigint, null::bigint, null::varchar, null::bigint, 0::bigint, null::bigint, null::varchar, null::bigint, null::bigint, null::bigint, null::varchar, null::bigint, null::bigint from every
    union all select task_id, n, "at",
      case when how is not null then null when open then "at" else b end,
      case when how is not null then null when open and action = 'queue' then 'queued' when open then 'running' when action = 'start' and p = 'queued' then 'running' when action = 'done' and p = 'running' then 'done' else p end,
      case when how is not null then null when open and action = 'queue' then "at" + start when open then null
        when action = 'start' and p = 'queued' or action = 'alive' and p = 'running' and u is not null then "at" + {_ALIVE_H * _HOUR * 1000} when action = 'done' and p = 'running' then "at" + {_KEEP_H * _HOUR * 1000} else u end,
      case when how is not null then 0 when open then 1 when action = 'share' and p <> 'queued' then c + 1 when action = 'free' and p <> 'queued' then c - 1 else c end,
      case when how is not null then "at" end, how, b, c,
      case when passed then due end, case when passed then case phase when 'queued' then 'not_started' when 'running' then 'silent' else 'dropped' end end, case when passed then born end, case when passed then clients end
    from (select *, p is null and action in ('queue', 'run') as open,
        case when action = 'gone' and p is not null then 'orphaned' when action = 'fetch' and p = 'done' then 'fetched' when action = 'free' and c = 1 and p = 'running' then 'killed' when action = 'free' and c = 1 and p = 'done' then 'freed' end as how
      from (select v.task_id, v.n, v."at", v.action, v.start, s.phase, s.due, s.born, s.clients, coalesce(s.due < v."at", false) as passed,
          case when s.due < v."at" then null else s.phase end as p, case when s.due < v."at" then null else s.due end as u, case when s.due < v."at" then null else s.born end as b, case when s.due < v."at" then 0 else s.clients end as c
        from s join every v on v.task_id = s.task_id and v.n = s.n + 1)))
  select task_id, late_born as born_at, late as "at", late_how as outcome, late_clients as clients from s where late is not null
  union all select task_id, held_born, closed, how, held_clients from s where how is not null""",
    "j17_in_flight_stream": _v("""with runs as (select event_id as grant_id, (k * 7) % 20 as digest, ts as started_at, ts + to_hours((k % 12)::int) as ends_at from heartbeats where kind in ('view', 'error')),
  q as (select event_id as request_id, k % 20 as digest, ts from heartbeats where kind in ('click', 'purchase')),
  a as (select q.*, (select max(struct_pack(s := started_at, g := grant_id)) from runs where runs.digest = q.digest and started_at <= q.ts and q.ts < ends_at) as run from q)
  select request_id, digest, run.g as reused_grant, case when run.g is null then 'actually_run' else 'reuse_existing' end as outcome from a where ts <= (select least((select max(ts) from q), (select max(started_at) from runs) + interval 20 minutes) - interval 13 hours)""", "heartbeats"),
}
