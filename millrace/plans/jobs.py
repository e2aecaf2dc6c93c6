"""Registered queries on executed jobs, their files and their machines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import fixtures as fx
from millrace.functions import machines
from millrace.operators import cache, jobs
from millrace.plans.cache import _e, _entries, _wanted, _WANTED

ROOT, PREFIX = "/tmp/jobs", "usr/src/output"
_NOW, _LATER = "1996-06-01 00:00:00", "2024-01-15 00:00:00"


def _files(s, d):
    """Files of jobs, one for each turn: most named as agreed, some by the system, some elsewhere; their paths lie in their content."""
    suffix = F.expr("element_at(array(concat('.', turn, '.o'), concat('.', turn, '.gcno'), concat('/sub/', turn, '.su')), cast(1 + turn % 3 as int))")
    workspace = F.concat(F.lit(f"{ROOT}/"), F.col("conv_id"), F.lit("/"))
    rows = fx.table(s, d, "conversations").select("conv_id", "turn", "text", suffix.alias("suffix"), workspace.alias("workspace"))
    name = F.when(F.expr("turn % 7 = 6"), F.concat(F.lit("core."), "turn")).otherwise(F.concat(F.lit(PREFIX), "suffix"))
    path = F.when(F.expr("turn % 9 = 8"), F.concat(F.lit("/var/tmp/"), "conv_id", F.lit("/x"))).otherwise(F.concat("workspace", name))
    content = F.concat(*[c.cast("binary") for c in (
        F.col("text"), F.concat("workspace", F.lit(PREFIX), "suffix"), F.when(F.expr("turn % 4 <> 1"), F.unhex(F.lit("00"))).otherwise(F.lit("").cast("binary")), F.lit("tail"))])
    return rows.select(path.alias("path"), content.alias("content"))


def _collected(s, d):
    return jobs.collected(_files(s, d), ROOT)


def _results(s, d):
    return fx.table(s, d, "conversations").select("conv_id").distinct().selectExpr("cast(conv_id as string) as job", "conv_id % 5 - 1 as exit_code")


def _sent(s, d):
    return jobs.out_of_band(_collected(s, d), _results(s, d), PREFIX, F.concat(F.lit(f"{ROOT}/"), "job"))


def _rebuilt(s, d):
    results = _results(s, d).join(jobs.packed(_sent(s, d)), "job", "left")
    broken = F.when(F.col("job").cast("long") % 6 == 0, F.expr("left(extra, length(extra) - 3)")).otherwise(F.col("extra"))
    came = _collected(s, d).where(F.col("name").startswith(PREFIX)).select("job", F.substr("name", F.lit(len(PREFIX) + 1)).alias("suffix"))
    return jobs.rebuilt(results.withColumn("extra", broken), came).withColumn("n_patches", F.size("patches").cast("bigint")).drop("patches")


def _reports(s, d):
    running = F.expr("transform(filter(sequence(0L, 7L), i -> getbit(k, cast(i as int)) = 1), i -> struct(servant * 8 + i as grant_id, concat('digest', i) as digest))")
    return fx.heartbeats(s, d).select("servant", "ts", "event_id", running.alias("running"))


def _runs(s, d):
    began = "cast(started_at as timestamp_ntz)"
    return fx.grants(s, d).selectExpr(
        "servant", "grant_id as task_id", f"{began} as started_at",
        f"if(grant_id % 97 = 0, null, {began} + make_dt_interval(cast(grant_id % 40 as int))) as completed_at", "grant_id % 5 - 1 as exit_code")


def _machines(s, d):
    return fx.servants(s, d).where(f"registry_ord < {fx.MACHINES}").selectExpr("registry_ord as servant", "max_tasks")


def _reclaimed(s, d):
    beats = fx.heartbeats(s, d).withColumnRenamed("k", "pid")
    holders = beats.where("kind in ('signup', 'purchase') and event_id % 4 = 1").groupBy("servant", "pid").agg(F.min("ts").alias("since"))
    letter = F.expr("element_at(array('R', 'S', 'Z', 'x', 'D', 'X'), cast(1 + (pid + event_id) % 6 as int))")
    return jobs.reclaimed(holders, beats.where("event_id % 4 = 3").select("servant", "pid", "ts", letter.alias("state")))


def _asked(s, d):
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq % 100000)")
    taken = F.expr("if(seq % 11 = 0, null, asked_at - make_dt_interval(0, 0, cast(seq % 20 as int)))")
    return cache.worth_asking(_wanted(s, d).withColumn("asked_at", at).withColumn("filter_at", taken), _entries(s, d).select("key")).select("seq", "ask")


def _system(s, d):
    memory = F.expr("""concat('MemTotal:       ', total_memory_gib * 1048576, ' kB\\nMemFree: none\\n', if(registry_ord % 4 <> 0, concat('MemAvailable:   ', memory_available_gib * 1048576, ' kB\\n'), ''),
      'HugePages_Total:  3\\nBuffers: 5 kB\\nBuffers:\\t', registry_ord, ' kB\\nSwapTotal: -1')""")
    stat = F.expr("concat('cpu  ', registry_ord, ' 2 3 ', num_processors * 1000 * (registry_ord % 3), ' 7\\ncpu0 1 2 3 4 5')")
    load = F.expr("concat(current_load, '.', lpad(registry_ord % 100, 2, '0'), ' 0.50 0.40 1/100 5')")
    got = fx.servants(s, d).select("registry_ord", machines.memory_report(memory).alias("m"), machines.idle_seconds(stat).alias("idle"), machines.load_last_minute(load).alias("load"))
    return got.select("registry_ord", "m.*", "idle", "load")


QUERIES = {
    "s20_output_files": lambda s, d: jobs.manifest(_collected(s, d)).withColumn("names", F.array_join("names", "|")),
    "m4_output_suffix": lambda s, d: _sent(s, d).select("job", "suffix", "error", F.explode_outer("places").alias("p")).select("job", "suffix", "error", "p.*"),
    "m3_rebuild_output": _rebuilt,
    "a9_running_tasks": lambda s, d: jobs.running_tasks(_reports(s, d), F.expr(f"timestamp_ntz'{_LATER}'"), "2 days"),
    "a14_executor_dump": lambda s, d: jobs.engine_dump(_machines(s, d), _runs(s, d), F.expr(f"timestamp_ntz'{_NOW}'"), "30 days"),
    "a14_alive_tasks": lambda s, d: jobs.alive_tasks(_runs(s, d), F.expr(f"timestamp_ntz'{_NOW}'"), "30 days"),
    "m15_reclaimed_holders": _reclaimed,
    "j12_worth_asking": _asked,
    "s10_memory_info": _system,
    "s12_cpu_quota": lambda s, d: fx.table(s, d, "part").select("p_partkey", machines.quota_processors(
        F.expr("case p_partkey % 5 when 0 then null when 1 then -1 else p_size * 25000 end"), F.expr("if(p_partkey % 7 = 0, 0, 100000)"), F.lit(8)).alias("v")),
}

_v = fx.with_views
_FILES = f"""files as (select conv_id, turn, text, '{ROOT}/' || conv_id || '/{PREFIX}' as head, conv_id % 5 - 1 as exit_code, turn % 7 <> 6 as sound,
  case turn % 3 when 0 then '.' || turn || '.o' when 1 then '.' || turn || '.gcno' else '/sub/' || turn || '.su' end as suffix from conversations where turn % 9 <> 8)"""
_RUNS = """runs as (select servant, grant_id as task_id, started_at::timestamp as started_at, grant_id % 5 - 1 as exit_code,
  case when grant_id % 97 <> 0 then started_at::timestamp + to_days((grant_id % 40)::int) end as completed_at from grants),
begun as (select *, coalesce(completed_at, timestamp '9999-01-01') as ended from runs where started_at <= timestamp '{0}')""".format(_NOW)
SQL = {
    "s20_output_files": f"""with {_FILES}, n as (select *, case when sound then '{PREFIX}' || suffix else 'core.' || turn end as name from files)
  select conv_id::varchar as job, count(*) as files, sum(strlen(text) + strlen(head) + strlen(suffix) + 4 + (turn % 4 <> 1)::int)::bigint as bytes,
  string_agg(name, '|' order by name) as names from n group by conv_id""",
    "m4_output_suffix": f"""with {_FILES}, p as (select *, sound and turn % 4 <> 1 and text is not null as placed from files where exit_code = 0)
  select conv_id::varchar as job, case when sound then suffix end as suffix, case when not sound then 'unexpected file core.' || turn end as error,
  case when placed then strlen(text)::bigint end as position, case when placed then (strlen(head) + strlen(suffix))::bigint end as total_size,
  case when placed then strlen(suffix)::bigint end as suffix_to_keep from p""",
    "m3_rebuild_output": f"""with {_FILES}, j as (select distinct conv_id, conv_id % 5 - 1 as exit_code from conversations),
  k as (select *, exit_code = 0 and (conv_id % 6 = 0 or conv_id not in (select conv_id from files where sound)) as bad from j)
  select k.conv_id::varchar as job, k.exit_code, case when bad then 'malformed message' end as error, f.suffix,
  case when f.suffix is not null then (k.exit_code = 0 and f.turn % 4 <> 1 and f.text is not null)::bigint end as n_patches
  from k left join files f on f.conv_id = k.conv_id and f.sound and k.exit_code >= 0 and not bad""",
    "a9_running_tasks": _v(f"""with r as (select *, row_number() over (partition by servant order by ts desc, event_id desc) as place from heartbeats where ts <= timestamp '{_LATER}')
  select servant, servant * 8 + i as grant_id, 'digest' || i as digest from r, range(8) q(i) where place = 1 and ((k >> i) & 1) = 1 and ts + interval 2 days > timestamp '{_LATER}'""", "heartbeats"),
    "a14_executor_dump": _v(f"""with {_RUNS}, m as (select registry_ord as servant, max_tasks from servants where registry_ord < {fx.MACHINES}), w as (select servant from m union select servant from begun)
  select w.servant, (select max(max_tasks) from m where m.servant = w.servant) as max_tasks, (select count(*) from begun b where b.servant = w.servant and ended > timestamp '{_NOW}') as running_tasks,
  (select count(*) from begun b where b.servant = w.servant and ended > timestamp '{_NOW}' - interval 30 days) as alive_tasks, (select count(*) from begun b where b.servant = w.servant) as tasks_run_ever from w""", "grants", "servants"),
    "a14_alive_tasks": _v(f"""with {_RUNS} select servant, task_id, started_at, case when ended > timestamp '{_NOW}' then 'RUNNING' else 'DONE' end as state,
  case when ended <= timestamp '{_NOW}' then completed_at end as completed_at, case when ended <= timestamp '{_NOW}' then exit_code end as exit_code
  from begun where ended > timestamp '{_NOW}' - interval 30 days""", "grants"),
    "m15_reclaimed_holders": _v("""with h as (select servant, k, min(ts) as since from heartbeats where kind in ('signup', 'purchase') and event_id % 4 = 1 group by 1, 2),
  p as (select servant, k, ts, (['R', 'S', 'Z', 'x', 'D', 'X'])[1 + (k + event_id) % 6] as state from heartbeats where event_id % 4 = 3),
  l as (select *, row_number() over (partition by servant, k order by ts desc, state desc) as place from p),
  g as (select h.servant, h.k as pid, l.state, case when l.ts > h.since then l.ts else h.since end as moment from h left join l on l.servant = h.servant and l.k = h.k and l.place = 1)
  select servant, pid, state, make_timestamp((epoch_us(moment) + 999999) // 1000000 * 1000000) as reclaimed_at from g where state is null or upper(state) = 'X' or state = 'Z'""", "heartbeats"),
    "j12_worth_asking": _e("select seq, seq % 11 = 0 or seq % 20 >= 10 or key in (select key from entries) as ask from wanted", _WANTED),
    "s10_memory_info": _v("""select registry_ord, total_memory_gib * 1048576 as mem_total, 0::bigint as mem_free, case when registry_ord % 4 = 0 then 0 else memory_available_gib * 1048576 end as mem_available,
  registry_ord as buffers, 0::bigint as cached, -1::bigint as swap_total, 0::bigint as swap_free, case when registry_ord % 3 <> 0 then num_processors * 10.0::double * (registry_ord % 3) end as idle,
  current_load + (registry_ord % 100 > 0)::int as load from servants""", "servants"),
    "s12_cpu_quota": "select p_partkey, case when p_partkey % 5 > 1 and p_partkey % 7 > 0 then least(8, p_size // 4)::bigint end as v from part",
}
