"""Registered queries on the cache, placement and tasks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import fixtures as fx
from millrace.functions import framing, text
from millrace.operators import cache, placement, tasks

LIMIT = 1_000_000


def _entries(s, d):
    return cache.latest_entries(fx.cache_entries(s, d))


def _nodes(s, d):
    return fx.servants(s, d).where("registry_ord < 12").selectExpr("concat('shard', registry_ord) as node", "1 + registry_ord % 5 as weight")


def _placed(s, d):
    keys = _entries(s, d).select("key", "size", "last_used")
    return placement.assign(keys, placement.ring(_nodes(s, d)), framing.ring_hash(F.col("key")))


def _wanted(s, d):
    return fx.cache_entries(s, d).selectExpr("case when seq % 4 = 0 then concat('miss-', seq) else key end as key", "seq")


def _l1(s, d):
    return _entries(s, d).where("last_used % 3 = 0")


def _outcomes(s, d):
    cached = fx.tasks(s, d).where("task_id % 9 = 0").selectExpr("cache_key as key")
    return tasks.outcomes(fx.tasks(s, d), cached, fx.grants(s, d).where("not zombie"))


def _quota(s, d):
    state = F.when(F.col("kind").isin("view", "click"), "waiting").when(F.col("kind").isin("signup", "purchase"), "granted")
    return fx.heartbeats(s, d).where("event_id % 16 = 1").select("servant", "k", state.alias("state"), (F.col("kind") == "view").alias("heavy"))


def _routes(s, d):
    q = fx.tasks(s, d).select("task_id", tasks.routing(F.col("exit_code"), F.col("requestor") % 20, F.col("task_id") % 7).alias("route"))
    return q


_LATEST = "entries as (select key, arg_max(size, (last_used, seq)) as size, max(last_used) as last_used, count(*) - 1 as overwrites from cache_entries group by key)"
_H = "('0x' || substr(md5({}), 1, 8))::bigint"
_RING = f"""nodes as (select 'shard' || registry_ord as node, 1 + registry_ord % 5 as weight from servants where registry_ord < 12),
points as (select {_H.format("node || '#VN' || i")} as hi, min(node) as node from (select node, unnest(range(0, weight * 100)) as i from nodes) group by 1),
probes as (select *, {_H.format("key")} as h from entries),
placed as (select p.key, p.size, p.last_used, coalesce((select arg_min(node, hi) from points where hi >= h), (select arg_min(node, hi) from points)) as node from probes p)"""
_PATH = f"""paths as (select *, node || '/' || lower(to_hex({_H.format("'dir:' || key")} % 16)) || '/' || lower(to_hex({_H.format("'dir:' || key")} // 16 % 16)) || '/' || url_encode(key) as path from placed)"""
_WANTED = "wanted as (select case when seq % 4 = 0 then 'miss-' || seq else key end as key, seq from cache_entries)"
_OUT = """cached as (select distinct cache_key as key from tasks where task_id % 9 = 0),
busy as (select digest, max(grant_id) as g from grants where not zombie group by digest),
outc as (select t.*, case when cache_control = 1 and c.key is not null then 'hit_cache' when b.g is not null then 'reuse_existing' else 'actually_run' end as outcome, b.g
  from tasks t left join cached c on t.cache_key = c.key left join busy b on t.digest = b.digest)"""
_BEFORE = "coalesce(sum(size) over (order by last_used{}, key rows between unbounded preceding and 1 preceding), 0)"


def _with_path(df):
    return df.withColumn("path", placement.entry_path())


QUERIES = {
    "j1_two_level_get": lambda s, d: cache.two_level_get(_wanted(s, d), _l1(s, d), _entries(s, d)),
    "j2_inflight_reuse": lambda s, d: _outcomes(s, d).where("reused_grant is not null").select("task_id", "reused_grant"),
    "j7_environment_path": lambda s, d: fx.requests(s, d).join(
        fx.servants(s, d).select(F.explode("environments").alias("env"), "registry_ord").groupBy("env").agg(F.min("registry_ord").alias("provider")), "env").select("request_id", "provider"),
    "j8_file_digest": lambda s, d: fx.cache_entries(s, d).alias("a").join(
        fx.cache_entries(s, d).where("seq % 2 = 0").select("key", "size", "last_used", F.col("seq").alias("known")), ["key", "size", "last_used"]).select("seq", "known"),
    "j11_consistent_hash": lambda s, d: _placed(s, d).select("key", "node"),
    "j12_key_prefilter": lambda s, d: _wanted(s, d).join(_entries(s, d).select("key"), "key", "left_semi").select("seq"),
    "j16_misplaced": lambda s, d: placement.misplaced(_with_path(_placed(s, d)).select("key", F.col("path").alias("expected"),
        F.when(F.col("size") % 5 == 0, F.concat(F.lit("old/"), "key")).otherwise(F.col("path")).alias("path"))),
    "j17_outcome": lambda s, d: _outcomes(s, d).select("task_id", "outcome"),
    "a2_directory_usage": lambda s, d: _with_path(_placed(s, d)).groupBy(text.directory_name(F.col("path")).alias("directory")).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes")),
    "a3_shard_rollup": lambda s, d: _placed(s, d).rollup("node").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes")),
    "a4_hit_counters": lambda s, d: cache.two_level_get(_wanted(s, d), _l1(s, d), _entries(s, d)).agg(
        F.count_if(F.col("level") == 1).alias("l1_hits"), F.count_if(F.col("level") == 2).alias("l2_hits"), F.count_if(F.col("level").isNull()).alias("misses"), F.count_if("fill").alias("fills")),
    "a5_object_totals": lambda s, d: _entries(s, d).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes")),
    "a7_outcome_counters": lambda s, d: _outcomes(s, d).groupBy("outcome").agg(F.count("*").alias("n")),
    "a8_tasks_by_state": lambda s, d: tasks.dump_by_state(fx.tasks(s, d)),
    "a8_task_dump": lambda s, d: tasks.dump(fx.tasks(s, d).selectExpr("task_id", "state", "requestor as task_grant_id", "started_at as start_deadline", "started_at + interval 1 day as ready_at",
        "concat('host', requestor % 7) as servant_location", "started_at + interval 2 day as dispatched_at", "requestor * 3 as servant_task_id", "started_at + interval 3 day as completed_at", "exit_code")),
    "a10_last_wins": lambda s, d: fx.tasks(s, d).groupBy("digest").agg(F.max_by("task_id", F.struct("started_at", "task_id")).alias("task_id")),
    "a11_first_wins": lambda s, d: fx.tasks(s, d).groupBy("digest").agg(F.min_by("task_id", F.struct("started_at", "task_id")).alias("task_id")),
    "a12_total_size": lambda s, d: fx.cache_entries(s, d).groupBy("tenant").agg(F.sum("size").alias("bytes")),
    "a15_quota_dump": lambda s, d: tasks.quota_dump(_quota(s, d).withColumnRenamed("k", "pid"), F.col("servant") % 8 + 2, 2).withColumn("pids", F.array_join(F.transform("pids", lambda x: F.lpad(x.cast("string"), 3, "0")), ",")),
    "m6_file_digest_upsert": lambda s, d: fx.cache_entries(s, d).groupBy("tenant", "size").agg(F.max_by("key", "seq").alias("key")),
    "w2_purge_oldest": lambda s, d: cache.purge_oldest(_entries(s, d), LIMIT).select("key", "size"),
    "w3_retain_newest": lambda s, d: cache.retain_newest(_entries(s, d), LIMIT).select("key", "keep"),
    "w5_virtual_nodes": lambda s, d: placement.ring(_nodes(s, d)),
    "o2_newest": lambda s, d: _entries(s, d).orderBy(F.desc("last_used"), "key").select("key", "last_used"),
    "o6_batches": lambda s, d: _entries(s, d).groupBy(F.substring("key", 7, 2).alias("prefix")).agg(F.count("*").alias("n")).select("prefix", F.ceil(F.col("n") / 1000).cast("bigint").alias("batches")),
    "o7_new_keys": lambda s, d: fx.heartbeats(s, d).selectExpr("concat('key-', event_id) as key", "ts").transform(lambda x: cache.new_keys(x, "2024-01-10 00:00:00", 86_400)),
    "u1_all_keys": lambda s, d: _l1(s, d).select("key").union(_entries(s, d).select("key")),
    "u3_gone_and_found": lambda s, d: _l1(s, d).select("key").subtract(_entries(s, d).where("size % 2 = 0").select("key")),
    "u5_compensated": lambda s, d: _l1(s, d).select("key").union(_wanted(s, d).where("seq % 4 = 0").select("key")).distinct(),
    "t9_incremental_fetch": lambda s, d: fx.heartbeats(s, d).selectExpr("concat('key-', event_id) as key", "ts").transform(lambda x: cache.new_keys(x, "2024-01-05 12:00:00", 3_600)).agg(F.count("*").alias("n")),
    "t12_touch": lambda s, d: cache.touched(_entries(s, d), _wanted(s, d).select("key", (F.col("seq") * 977 % 2592000).alias("ts"))).select("key", "last_used", "overwrites"),
    "f24_placement_path": lambda s, d: _with_path(_placed(s, d)).select("key", "path"),
    "f26_object_key": lambda s, d: _entries(s, d).select("key", framing.object_key("cache", F.col("key")).alias("object_key")),
    "p17_write_gate": lambda s, d: fx.tasks(s, d).where("cache_key is not null and exit_code = 0").select("task_id"),
    "p22_routing": _routes,
    "m1_first_waiter": lambda s, d: tasks.first_waiter(fx.heartbeats(s, d).selectExpr("k as task_id", "ts", "event_id as wait_id")),
    "m2_cache_control": lambda s, d: fx.tasks(s, d).selectExpr("task_id", "cache_control = 1 as reads", "cache_control <> 0 as writes"),
    "m5_completion": lambda s, d: fx.tasks(s, d).select("task_id", tasks.completion(F.col("exit_code"), F.lit("out"), F.lit(""), F.when(F.col("task_id") % 5 == 0, F.lit("lost output"))).alias("c")).selectExpr("task_id", "c.exit_code", "c.stdout", "c.stderr"),
    "m8_key_snapshot": lambda s, d: _entries(s, d).select("key"),
    "m9_directories": lambda s, d: placement.directories(_nodes(s, d)),
    "t15_timers": lambda s, d: fx.tasks(s, d).selectExpr("task_id", "state <> 'Done' and started_at < timestamp_ntz'1996-06-01 00:00:00' as aborted", "state = 'Done' and started_at < timestamp_ntz'1997-01-01 00:00:00' as cleaned"),
}

_v = fx.with_views
_e = lambda body, *more: _v(f"with {', '.join([_LATEST, *more])} {body}", "cache_entries", "servants")
_t = lambda body: _v(f"with {_OUT} {body}", "tasks", "grants")
_GET = "got as (select w.key, w.seq, case when e.last_used % 3 = 0 then 1 when e.key is not null then 2 end as level, e.size, e.key is not null and e.last_used % 3 <> 0 as fill from wanted w left join entries e on w.key = e.key)"
SQL = {
    "j1_two_level_get": _e("select * from got", _WANTED, _GET),
    "j2_inflight_reuse": _t("select task_id, g as reused_grant from outc where outcome = 'reuse_existing'"),
    "j7_environment_path": _v("with p as (select env, min(registry_ord) as provider from (select unnest(environments) as env, registry_ord from servants) group by env) select request_id, provider from requests join p using (env)", "servants", "requests"),
    "j8_file_digest": _v("select a.seq, b.seq as known from cache_entries a join cache_entries b on a.key = b.key and a.size = b.size and a.last_used = b.last_used where b.seq % 2 = 0", "cache_entries"),
    "j11_consistent_hash": _e("select key, node from placed", _RING),
    "j12_key_prefilter": _e("select seq from wanted where key in (select key from entries)", _WANTED),
    "j16_misplaced": _e("select key, path as expected, 'old/' || key as path, 'move' as action from paths where size % 5 = 0", _RING, _PATH),
    "j17_outcome": _t("select task_id, outcome from outc"),
    "a2_directory_usage": _e("select regexp_replace(path, '/[^/]*$', '') as directory, count(*) as entries, sum(size)::bigint as bytes from paths group by 1", _RING, _PATH),
    "a3_shard_rollup": _e("select node, count(*) as entries, sum(size)::bigint as bytes from placed group by rollup(node)", _RING),
    "a4_hit_counters": _e("select count(*) filter (level = 1) as l1_hits, count(*) filter (level = 2) as l2_hits, count(*) filter (level is null) as misses, count(*) filter (fill) as fills from got", _WANTED, _GET),
    "a5_object_totals": _e("select count(*) as entries, sum(size)::bigint as bytes from entries"),
    "a7_outcome_counters": _t("select outcome, count(*) as n from outc group by 1"),
    "a8_tasks_by_state": _v("""select state, count(*) as n, count(exit_code) filter (state = 'Done') as n_exit, coalesce(sum(exit_code) filter (state = 'Done'), 0)::bigint as sum_exit,
  min(task_id) as first_task, max(started_at) as last_started from tasks group by state""", "tasks"),
    "a8_task_dump": _v("""with f as (select *, (case state when 'Pending' then 0 when 'Dispatched' then 2 else 3 end) as reached from tasks)
  select task_id, case reached when 0 then 'pending_tasks' when 2 then 'dispatched_tasks' else 'completed_tasks' end as section,
  case reached when 0 then 'PENDING' when 2 then 'DISPATCHED' else 'DONE' end as state, requestor as task_grant_id, started_at::timestamp as start_deadline,
  case when reached >= 1 then started_at::timestamp + interval 1 day end as ready_at, case when reached >= 1 then 'host' || requestor % 7 end as servant_location,
  case when reached >= 2 then started_at::timestamp + interval 2 day end as dispatched_at, case when reached >= 2 then requestor * 3 end as servant_task_id,
  case when reached = 3 then started_at::timestamp + interval 3 day end as completed_at, case when reached = 3 then exit_code end as exit_code from f""", "tasks"),
    "a10_last_wins": _v("select digest, arg_max(task_id, (started_at, task_id)) as task_id from tasks group by 1", "tasks"),
    "a11_first_wins": _v("select digest, arg_min(task_id, (started_at, task_id)) as task_id from tasks group by 1", "tasks"),
    "a12_total_size": _v("select tenant, sum(size)::bigint as bytes from cache_entries group by 1", "cache_entries"),
    "a15_quota_dump": _v("""select servant, count(*) filter (kind = 'view') as heavyweight_waiters, count(*) filter (kind = 'click') as lightweight_waiters,
  count(distinct case when kind in ('signup', 'purchase') then k end) as running_tasks, servant % 8 + 2 as max_tasks, 2 as lightweight_task_overprovisioning,
  coalesce(string_agg(distinct lpad(k::varchar, 3, '0'), ',' order by lpad(k::varchar, 3, '0')) filter (kind in ('signup', 'purchase')), '') as pids
  from heartbeats where event_id % 16 = 1 group by servant""", "heartbeats"),
    "m6_file_digest_upsert": _v("select tenant, size, arg_max(key, seq) as key from cache_entries group by 1, 2", "cache_entries"),
    "w2_purge_oldest": _e(f"select key, size from (select *, {_BEFORE.format('')} as before, sum(size) over () as total from entries) where total::double - before >= 0.95::double * {LIMIT}"),
    "w3_retain_newest": _e(f"select key, {_BEFORE.format(' desc')} < {LIMIT} as keep from entries"),
    "w5_virtual_nodes": _e("""select node, coalesce(lag(hi) over (order by hi), -1) as lo, hi from points union all
  select (select arg_min(node, hi) from points), (select max(hi) from points), 4294967296""", _RING),
    "o2_newest": _e("select key, last_used from entries order by last_used desc, key"),
    "o6_batches": _e("select substr(key, 7, 2) as prefix, ceil(count(*) / 1000.0)::bigint as batches from entries group by 1"),
    "o7_new_keys": _v("select 'key-' || event_id as key, ts from heartbeats where ts >= timestamp '2024-01-10' - interval 86405 seconds", "heartbeats"),
    "u1_all_keys": _e("select key from entries where last_used % 3 = 0 union all select key from entries"),
    "u3_gone_and_found": _e("select key from entries where last_used % 3 = 0 except select key from entries where size % 2 = 0"),
    "u5_compensated": _e("select key from entries where last_used % 3 = 0 union select key from wanted where seq % 4 = 0", _WANTED),
    "t9_incremental_fetch": _v("select count(*) as n from heartbeats where ts >= timestamp '2024-01-05 12:00:00' - interval 3605 seconds", "heartbeats"),
    "t12_touch": _e("""select e.key, case when max(w.seq * 977 % 2592000) > e.last_used then max(w.seq * 977 % 2592000) else e.last_used end as last_used, e.overwrites
  from entries e left join wanted w on w.key = e.key group by e.key, e.last_used, e.overwrites""", _WANTED),
    "f24_placement_path": _e("select key, path from paths", _RING, _PATH),
    "f26_object_key": _e(f"select key, 'cache/' || ({_H.format('key')} % 128) || '/' || key as object_key from entries"),
    "p17_write_gate": _v("select task_id from tasks where cache_key is not null and exit_code = 0", "tasks"),
    "p22_routing": _v("""select task_id, case when (exit_code < 0 or exit_code = 127) and requestor % 20 <= 10 then 'local' when (exit_code < 0 or exit_code = 127) and task_id % 7 < 5 then 'retry'
  when exit_code < 0 or exit_code = 127 then 'local' when exit_code <> 0 then 'local_rerun' else 'accept' end as route from tasks""", "tasks"),
    "m1_first_waiter": _v("select k as task_id, arg_min(event_id, (ts, event_id)) as wait_id from heartbeats group by 1", "heartbeats"),
    "m2_cache_control": _v("select task_id, cache_control = 1 as reads, cache_control <> 0 as writes from tasks", "tasks"),
    "m5_completion": _v("""select task_id, case when task_id % 5 = 0 then -1 else exit_code end as exit_code, case when task_id % 5 = 0 then '' else 'out' end as stdout,
  case when task_id % 5 = 0 then 'lost output' else '' end as stderr from tasks""", "tasks"),
    "m8_key_snapshot": _e("select key from entries"),
    "m9_directories": _v("select 'shard' || registry_ord || '/' || lower(to_hex(a)) || '/' || lower(to_hex(b)) as directory from servants, range(16) r(a), range(16) q(b) where registry_ord < 12", "servants"),
    "t15_timers": _v("select task_id, state <> 'Done' and started_at < timestamp '1996-06-01' as aborted, state = 'Done' and started_at < timestamp '1997-01-01' as cleaned from tasks", "tasks"),
}
