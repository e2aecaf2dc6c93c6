"""Registered queries on matching and leases, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace import fixtures as fx
from millrace.operators import leases, scheduling, timeline

_CAP = """case when total_memory_gib <> 0 and memory_available_gib < 10 then running_tasks
  else least(max_tasks, greatest(num_processors - greatest(current_load - running_tasks, 0), 0)) end"""
_USER, _SERVANT = ("token1", "token2"), ("token2", "token3", "token4")
NOW = "2024-01-01 00:00:00"


def _grants(s, d):
    return fx.grants(s, d)


def _reports(s, d):
    """Running reports: grants as their machines report them, some by a wrong machine and some not at all."""
    return _grants(s, d).where("grant_id % 3 <> 0").selectExpr("case when grant_id % 7 = 0 then (servant + 1) % 100 else servant end as servant", "grant_id")


_REPORTS = "select case when grant_id % 7 = 0 then (servant + 1) % 100 else servant end as servant, grant_id from grants where grant_id % 3 <> 0"

QUERIES = {
    "a1_cluster_rollup": lambda s, d: scheduling.cluster_rollup(fx.servants(s, d)),
    "p1_eligible": lambda s, d: scheduling.eligible(fx.servants(s, d), fx.requests(s, d).select("env", "min_version").distinct()).select("env", "min_version", "registry_ord"),
    "p2_free": lambda s, d: scheduling.free(fx.servants(s, d)).select("registry_ord", "running_tasks", "capacity_available"),
    "p3_environment": lambda s, d: fx.servants(s, d).where(F.array_contains("environments", "env1")).select("registry_ord"),
    "p4_capacity": lambda s, d: fx.servants(s, d).select("registry_ord", scheduling.capacity_available().alias("capacity_available")),
    "p5_same_host": lambda s, d: fx.requests(s, d).join(
        fx.servants(s, d).select("registry_ord", scheduling.host_of(F.col("observed_location")).alias("requestor_ip")), "requestor_ip"
    ).select("request_id", "registry_ord"),
    "p6_heartbeats": lambda s, d: scheduling.normalize_heartbeats(fx.servants(s, d), _USER, _SERVANT, 19).select(
        "registry_ord", "reject", "not_accepting_reason", "accepted_tasks", "num_processors", "priority"
    ),
    "p7_tokens": lambda s, d: fx.requests(s, d).where(F.col("token").isin(*_USER)).select("request_id", "token"),
    "p18_bounds": lambda s, d: fx.requests(s, d).where(F.col("wait_ms") <= scheduling.MAX_WAIT_MS).select("request_id", "wait_ms"),
    "w1_pick_servant": lambda s, d: scheduling.pick_servants(fx.requests(s, d), fx.servants(s, d)),
    "j3_unknown_tasks": lambda s, d: leases.unknown_tasks(_reports(s, d), _grants(s, d)),
    "j3_permitted_tasks": lambda s, d: leases.permitted_tasks(_reports(s, d), _grants(s, d)),
    "j4_orphans": lambda s, d: leases.orphans(_grants(s, d), fx.servants(s, d).where("max_tasks > 0").selectExpr("registry_ord as servant")).select("servant", "grant_id"),
    "j5_zombie_sweep": lambda s, d: leases.swept_zombies(_grants(s, d), _reports(s, d)).select("servant", "grant_id"),
    "j9_kill_expired": lambda s, d: _reports(s, d).join(_grants(s, d).where("started_at < timestamp_ntz'1996-01-01 00:00:00'"), "grant_id", "left_semi"),
    "a17_zombies_swept": lambda s, d: leases.swept_zombies(_grants(s, d), _reports(s, d)).agg(F.count_if(~F.col("is_prefetch")).alias("n_zombies")),
    "t1_lease_sessions": lambda s, d: leases.lease_sessions(fx.heartbeats(s, d), "6 hours").drop("session"),
    "t2_lease_expiry": lambda s, d: leases.expired(leases.lease_sessions(fx.heartbeats(s, d), "6 hours"), "2024-01-15 00:00:00").select("servant", "expires_at"),
    "t7_latest_snapshot": lambda s, d: leases.latest_snapshot(fx.heartbeats(s, d), "k", "kind"),
    "t18_renewals": lambda s, d: leases.renew(_reports(s, d).select("grant_id"), _grants(s, d)),
    "t19_departures": lambda s, d: fx.servants(s, d).where("next_heartbeat_in_ms = 0").select("registry_ord", F.lit(0).cast("bigint").alias("max_tasks")),
    "w4_cpu_load": lambda s, d: timeline.earlier(fx.heartbeats(s, d), ["servant"], at="ts", order="event_id", value="k", name="before", back=5).select(
        "servant", "event_id", (F.lit(16) - F.floor((F.col("k") - F.col("before")) / 5.0)).cast("bigint").alias("load")),
    "w6_token_rollout": lambda s, d: fx.heartbeats(s, d).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.max("event_id").alias("token")).select(
        "day", F.col("token").alias("next_token"), F.lag("token").over(W.orderBy("day")).alias("serving"), F.lag("token", 2).over(W.orderBy("day")).alias("previous")),
    "w7_history": lambda s, d: fx.heartbeats(s, d).withColumn("rn", F.row_number().over(W.partitionBy("servant").orderBy(F.desc("ts"), F.desc("event_id")))).where("rn <= 61").select("servant", "event_id"),
    "w8_grant_fifo": lambda s, d: timeline.numbered(
        _grants(s, d).where("started_at >= timestamp_ntz'1996-01-01 00:00:00'"), ["servant"], at="started_at", order="grant_id", name="place", bucket=30 * timeline.BUCKET
    ).select("servant", "grant_id", "place"),
    "f42_next_id": lambda s, d: scheduling.numbered(fx.servants(s, d).select("registry_ord"), "registry_ord"),
    "t5_batch_grants": lambda s, d: scheduling.batch_grants(fx.requests(s, d).selectExpr("request_id", "request_id % 4 as immediate", "request_id % 3 as prefetch", "request_id % 5 as free").where("immediate + prefetch > 0")),
    "t8_bounded_staleness": lambda s, d: leases.visible_snapshot(fx.heartbeats(s, d).select("servant", "event_id", "ts", (F.col("kind") != "error").alias("ok")), "20 hours").drop("ts"),
    "t17_references": lambda s, d: timeline.running_sum(
        fx.heartbeats(s, d), ["servant"], at="ts", order="event_id", value=F.when(F.col("k") % 2 == 0, 1).otherwise(-1), name="refs"
    ).select("servant", "event_id", "refs"),
    "m10_token_refresh": lambda s, d: timeline.running_last(
        fx.heartbeats(s, d), ["servant"], at="ts", order="event_id", value=F.when(F.col("k") % 3 == 0, F.col("k")), name="token"
    ).select("event_id", "token"),
}

_v = fx.with_views
_B = "order by ts, event_id"
SQL = {
    "a1_cluster_rollup": _v(f"""select count(*)::bigint as servants_up, sum(running_tasks)::bigint as running, sum(max_tasks)::bigint as capacity,
  sum(max_tasks - c)::bigint as capacity_unavailable, greatest(sum(max_tasks) - sum(running_tasks) - sum(max_tasks - c), 0)::bigint as capacity_available
  from (select *, {_CAP} as c from servants)""", "servants"),
    "p1_eligible": _v("""select distinct r.env, r.min_version, s.registry_ord from (select distinct env, min_version from requests) r
  join servants s on list_contains(s.environments, r.env) and s.version >= r.min_version and s.max_tasks <> 0""", "servants", "requests"),
    "p2_free": _v(f"select registry_ord, running_tasks, c as capacity_available from (select *, {_CAP} as c from servants) where running_tasks < c", "servants"),
    "p3_environment": _v("select registry_ord from servants where list_contains(environments, 'env1')", "servants"),
    "p4_capacity": _v(f"select registry_ord, {_CAP} as capacity_available from servants", "servants"),
    "p5_same_host": _v("select request_id, registry_ord from requests join servants on starts_with(observed_location, requestor_ip || ':')", "servants", "requests"),
    "p6_heartbeats": _v("""select registry_ord, case when token not in ('token1', 'token2', 'token3', 'token4') then 'access_denied' when version < 19 then 'version_too_old'
  when next_heartbeat_in_ms > 30000 then 'invalid_lease' end as reject,
  case when token not in ('token2', 'token3', 'token4') then 100 when observed_location <> reported_location then 4 else 0 end as not_accepting_reason,
  (case when observed_location <> reported_location or token not in ('token2', 'token3', 'token4') or next_heartbeat_in_ms = 0 then 0 else max_tasks end)::bigint as accepted_tasks,
  num_processors, priority from servants""", "servants"),
    "p7_tokens": _v("select request_id, token from requests where token in ('token1', 'token2')", "requests"),
    "p18_bounds": _v("select request_id, wait_ms from requests where wait_ms <= 10000", "requests"),
    "w1_pick_servant": _v(f"""select request_id, registry_ord from (select r.request_id, s.registry_ord, row_number() over (partition by r.request_id order by
    case when starts_with(s.observed_location, r.requestor_ip || ':') then 2 when s.priority = 1 and s.running_tasks * 2 < s.num_processors then 0 else 1 end,
    s.running_tasks::double / s.c, s.registry_ord) as rn
  from requests r join (select *, {_CAP} as c from servants) s on list_contains(s.environments, r.env) and s.version >= r.min_version and s.max_tasks <> 0 and s.running_tasks < s.c) where rn = 1""", "servants", "requests"),
    "j3_unknown_tasks": _v(f"""select servant, grant_id from ({_REPORTS}) r where not exists (select 1 from grants g where not g.zombie and g.servant = r.servant and g.grant_id = r.grant_id)""", "grants"),
    "j3_permitted_tasks": _v(f"""select servant, grant_id from ({_REPORTS}) r where exists (select 1 from grants g where not g.zombie and g.servant = r.servant and g.grant_id = r.grant_id)""", "grants"),
    "j4_orphans": _v("select servant, grant_id from grants where servant not in (select registry_ord from servants where max_tasks > 0)", "grants", "servants"),
    "j5_zombie_sweep": _v(f"""with rep as ({_REPORTS}) select servant, grant_id from grants g where zombie and servant in (select servant from rep)
  and not exists (select 1 from rep r where r.servant = g.servant and r.grant_id = g.grant_id)""", "grants"),
    "j9_kill_expired": _v(f"select r.servant, r.grant_id from ({_REPORTS}) r where r.grant_id in (select grant_id from grants where started_at < timestamp '1996-01-01')", "grants"),
    "a17_zombies_swept": _v(f"""with rep as ({_REPORTS}) select count(*) filter (not is_prefetch) as n_zombies from grants g where zombie and servant in (select servant from rep)
  and not exists (select 1 from rep r where r.servant = g.servant and r.grant_id = g.grant_id)""", "grants"),
    "t1_lease_sessions": _v(f"""with m as (select *, case when ts > lag(ts) over w + interval 6 hours then 1 else 0 end as new from heartbeats window w as (partition by servant {_B})),
  n as (select *, sum(new) over (partition by servant {_B}) as session from m)
  select servant, min(ts) as discovered_at, max(ts) + interval 6 hours as expires_at, count(*) as beats from n group by servant, session""", "heartbeats"),
    "t2_lease_expiry": _v(f"""with m as (select *, case when ts > lag(ts) over w + interval 6 hours then 1 else 0 end as new from heartbeats window w as (partition by servant {_B})),
  n as (select *, sum(new) over (partition by servant {_B}) as session from m),
  e as (select servant, max(ts) + interval 6 hours as expires_at from n group by servant, session) select * from e where expires_at < timestamp '2024-01-15'""", "heartbeats"),
    "t7_latest_snapshot": _v("select servant, ts, k, kind from (select *, row_number() over (partition by servant order by ts desc, event_id desc) as rn from heartbeats) where rn = 1", "heartbeats"),
    "t18_renewals": _v(f"select r.grant_id, r.grant_id in (select grant_id from grants where not zombie) as renewed from ({_REPORTS}) r", "grants"),
    "t19_departures": _v("select registry_ord, 0::bigint as max_tasks from servants where next_heartbeat_in_ms = 0", "servants"),
    "w4_cpu_load": _v(f"select servant, event_id, (16 - floor((k - lag(k, 5) over (partition by servant {_B})) / 5.0))::bigint as load from heartbeats", "heartbeats"),
    "w6_token_rollout": _v("""with t as (select date_trunc('day', ts)::timestamp as day, max(event_id) as token from heartbeats group by 1)
  select day, token as next_token, lag(token) over (order by day) as serving, lag(token, 2) over (order by day) as previous from t""", "heartbeats"),
    "w7_history": _v("select servant, event_id from (select *, row_number() over (partition by servant order by ts desc, event_id desc) as rn from heartbeats) where rn <= 61", "heartbeats"),
    "w8_grant_fifo": _v("select servant, grant_id, row_number() over (partition by servant order by started_at, grant_id) as place from grants where started_at >= timestamp '1996-01-01'", "grants"),
    "f42_next_id": _v("select registry_ord, row_number() over (order by registry_ord) as id from servants", "servants"),
    "t5_batch_grants": _v("""with b as (select request_id, request_id % 4 as im, request_id % 3 as pre, request_id % 5 as free from requests),
  i as (select request_id, i as slot, false as is_prefetch, i <= free as granted, i = 1 or i - 1 <= free as tried, i = 1 as may_wait from b, range(1, 4) r(i) where i <= im),
  p as (select request_id, im + i as slot, true as is_prefetch, i <= greatest(free - im, 0) as granted, i = 1 or i - 1 <= greatest(free - im, 0) as tried,
  i = 1 and (im = 0 or free = 0) as may_wait from b, range(1, 3) r(i) where i <= pre) select * from i union all select * from p""", "requests"),
    "t8_bounded_staleness": _v("""select servant, event_id, kind <> 'error' as ok, (select max(o.ts) from heartbeats o where o.kind <> 'error' and o.servant = h.servant and (o.ts, o.event_id) <= (h.ts, h.event_id)
  and o.ts >= h.ts - interval 20 hours) as snapshot_at from heartbeats h""", "heartbeats"),
    "t17_references": _v(f"select servant, event_id, (sum(case when k % 2 = 0 then 1 else -1 end) over (partition by servant {_B} rows unbounded preceding))::bigint as refs from heartbeats", "heartbeats"),
    "m10_token_refresh": _v(f"""select event_id, last_value(case when k % 3 = 0 then k end ignore nulls) over (partition by servant {_B} rows between unbounded preceding and current row) as token from heartbeats""", "heartbeats"),
}
