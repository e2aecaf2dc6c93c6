"""Registered queries on codecs, streams and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import fixtures as fx
from millrace.functions import codecs
from millrace.sources import listing
from millrace.streaming import leases, run

_BEATS = [f"user_id % {fx.MACHINES} as servant", "event_id", "event_type as kind", "cast(get_json_object(props, '$.k') as bigint) as k"]


_ACTIONS = ("signup", "grant", "view", "grant", "click", "renew", "purchase", "free", "error", "report")


def _stream(s, d):
    return run.table_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).selectExpr("ts", *_BEATS)


def _t1(s, d):
    got = run.available_now(leases.lease_stream(_stream(s, d).select("servant", "ts", "event_id"), 6 * 3600))
    return got.select("servant", F.col("discovered_at").cast("timestamp_ntz").alias("discovered_at"), F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), "beats")


def _actions(s, d):
    """Heartbeats as actions on task leases of eight grants a machine: the event's kind says which, its amount how long."""
    running = F.expr("filter(sequence(0L, 7L), i -> getbit(k, cast(i as int)) = 1)")
    return _stream(s, d).select(
        "servant", "ts", "event_id", F.element_at(F.create_map(*[F.lit(x) for x in _ACTIONS]), F.col("kind")).alias("action"), (F.col("k") % 8).alias("grant_id"), (F.col("k") * 900_000).alias("lease_ms"), running.alias("running"))


def _task_leases(s, d):
    got = run.available_now(leases.task_lease_stream(_actions(s, d)))
    return got.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _windows(s, d):
    got = run.available_now(leases.windowed_counts(_stream(s, d)))
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "kind", "n", "total")


def _entry(s, d):
    c = fx.table(s, d, "conversations").select("conv_id", "turn", codecs.pack_entry(F.col("turn"), F.col("text").cast("binary"), F.col("role").cast("binary"), F.lit("x").cast("binary")).alias("b"))
    broken = F.when(F.col("turn") % 5 == 4, F.substring("b", F.lit(1), F.octet_length("b") - 1)).otherwise(F.col("b"))
    return c.select("conv_id", "turn", codecs.unpack_entry(broken).alias("e")).select("conv_id", "turn", F.sha2("e.stdout", 256).alias("stdout"), F.col("e.stderr").cast("string").alias("stderr"))


QUERIES = {
    "f29_cache_entry": _entry,
    "w9_path_locations": lambda s, d: fx.table(s, d, "part").selectExpr("p_partkey as id", "cast(concat(p_name, '/ws/x', p_brand, unhex('00'), '/ws/y', unhex('00'), '/ws/open') as binary) as b").select(
        "id", F.explode(codecs.find_path_locations("/ws/")(F.col("b"))).alias("l")).select("id", "l.position", "l.total_size", "l.suffix_to_keep"),
    "t1_lease_stream": _t1,
    "t2_task_lease_stream": _task_leases,
    "t3_windowed_stream": _windows,
    "s1_listing": lambda s, d: listing.enumerated(s, d).where("name like '%.parquet'").select("name", (F.col("size") > 0).alias("filled")),
    "s2_tree": lambda s, d: listing.tree(s, d).select(listing.relative(F.col("path"), d).alias("path"), "size"),
    "m16_file_times": lambda s, d: listing.tree(s, d).select(listing.relative(F.col("path"), d).alias("path"), "size", "modified"),
    "s6_merged_listing": lambda s, d: fx.cache_entries(s, d).where("last_used % 2 = 0").select("key").unionByName(fx.cache_entries(s, d).where("last_used % 2 = 1").select("key")),
    "s13_compiler_dirs": lambda s, d: listing.compiler_dirs(fx.command_lines(s, d).selectExpr("concat('/usr/', id % 5) as directory"), fx.command_lines(s, d).selectExpr("concat('/opt/rh/devtoolset-', id % 7, '/root') as directory")),
}

_v = fx.with_views
_M = """m as (select *, case when ts > lag(ts) over w + interval 6 hours then 1 else 0 end as new from heartbeats window w as (partition by servant order by ts, event_id)),
n as (select *, sum(new) over (partition by servant order by ts, event_id) as session from m),
e as (select servant, session, min(ts) as discovered_at, max(ts) + interval 6 hours as expires_at, count(*) as beats from n group by 1, 2)"""
SQL = {
    "f29_cache_entry": "select conv_id, turn, case when turn % 5 <> 4 then sha256(text) end as stdout, case when turn % 5 <> 4 then role end as stderr from conversations",
    "w9_path_locations": """select p_partkey as id, strlen(p_name) as position, 5 + strlen(p_brand) as total_size, 1 + strlen(p_brand) as suffix_to_keep from part
  union all select p_partkey, strlen(p_name) + 6 + strlen(p_brand), 5, 1 from part""",
    "t1_lease_stream": _v(f"""with {_M} select servant, discovered_at, expires_at, beats from e where (servant, session) not in (select servant, max(session) from e group by 1)
  or expires_at < (select max(ts) from heartbeats)""", "heartbeats"),
    "s1_listing": "select unnest(string_split('region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations', ' ')) || '.parquet' as name, true as filled",
    "s6_merged_listing": _v("select key from cache_entries", "cache_entries"),
    "s13_compiler_dirs": """select directory, min(rank)::int as rank from (select '/usr/' || p_partkey % 5 as directory, 0 as rank from part
  union all select '/opt/rh/devtoolset-' || p_partkey % 7 || '/root/bin', 1 from part union all select '/opt/rh/devtoolset-' || i || '/root/bin', 2 from range(1, 100) r(i)) group by 1""",
}
