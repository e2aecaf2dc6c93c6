"""Registered queries for the remaining behaviours, and extensions (``x_``) that go beyond them: stock relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace import fixtures as fx
from millrace.operators import placement
from millrace.plans import cache
from millrace.sources import listing

_t = fx.table


def _ring(s, d):
    return placement.ring(cache._nodes(s, d))


def _admission(s, d):
    return fx.servants(s, d).selectExpr("registry_ord", "running_tasks + 1 <= max_tasks and memory_available_gib >= 2 as admitted")


def _sources(s, d):
    hosts = fx.servants(s, d)
    a = hosts.where("registry_ord % 3 = 0").select(F.col("environments")[0].alias("env"), "registry_ord", F.lit(0).alias("rank"))
    b = hosts.where("registry_ord % 3 <> 0").select(F.col("environments")[1].alias("env"), "registry_ord", F.lit(1).alias("rank"))
    return a.union(b).groupBy("env").agg(F.min(F.struct("rank", "registry_ord")).alias("first")).select("env", "first.rank", "first.registry_ord")


_STRAY, _OLD = "size % 11 = 0", "size % 7 = 0"


def _files(s, d):
    """The files of a cache: most where they belong, some in an old place, some too deep."""
    path = F.when(F.expr(_STRAY), F.concat("path", F.lit(".tmp/x"))).when(F.expr(_OLD), F.concat(F.lit("old/0/0/"), F.element_at(F.split("path", "/"), -1))).otherwise(F.col("path"))
    return cache._with_path(cache._placed(s, d)).select(path.alias("path"), "size")


def _zombies(s, d):
    w = W.partitionBy("servant", "k").orderBy("ts", "event_id")
    beats = fx.heartbeats(s, d).withColumn("next", F.lead("ts").over(w))
    return beats.select("event_id", (F.coalesce(F.col("next"), F.expr("timestamp_ntz'2024-02-01 00:00:00'")) > F.col("ts") + F.expr("interval 3 days")).alias("becomes_zombie"))


def _tot():
    return F.sum(F.round("l_quantity").cast("bigint")).alias("q")


QUERIES = {
    "o1_ring_order": lambda s, d: placement.places(_ring(s, d)),
    "u2_merged_listings": lambda s, d: fx.cache_entries(s, d).where("seq % 3 = 0").select("key", "size").union(fx.cache_entries(s, d).where("seq % 3 <> 0").select("key", "size")),
    "u4_first_environment": _sources,
    "s3_stray_files": lambda s, d: listing.stray(_files(s, d).withColumn("path", F.concat(F.lit("/data/cache/"), "path")), "/data/cache").select("path"),
    "s9_startup_load": lambda s, d: placement.startup_load(_files(s, d), cache._nodes(s, d)).select("path", "key", "expected", "action"),
    "p21_admission": _admission,
    "t2_zombie_leases": _zombies,
    "t6_prefetch": lambda s, d: fx.requests(s, d).groupBy("env", F.to_date("submitted_at").alias("day")).agg(F.count("*").alias("immediate"), F.lit(1).cast("bigint").alias("prefetch")),
    "x_join_inner": lambda s, d: _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n")),
    "x_join_outer": lambda s, d: _t(s, d, "customer").join(_t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "full").agg(F.count("c_custkey").alias("c"), F.count("o_orderkey").alias("o")),
    "x_join_semi": lambda s, d: _t(s, d, "customer").join(_t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey"),
    "x_join_anti": lambda s, d: _t(s, d, "customer").join(_t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey"),
    "x_rollup": lambda s, d: _t(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(_tot()),
    "x_cube": lambda s, d: _t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(_tot()),
    "x_grouping_sets": lambda s, d: _t(s, d, "lineitem").groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")], []], "l_returnflag", "l_linestatus").agg(_tot()),
    "x_count_distinct": lambda s, d: _t(s, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts")),
    "x_ranks": lambda s, d: _t(s, d, "orders").select("o_orderkey", *[f.over(W.partitionBy("o_custkey").orderBy("o_orderdate")).cast("bigint").alias(n) for f, n in ((F.rank(), "r"), (F.dense_rank(), "d"))]),
    "x_frames": lambda s, d: _t(s, d, "orders").select("o_orderkey", F.count("*").over(W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 1)).alias("near"), F.first("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("first")),
    "x_set_operations": lambda s, d: _t(s, d, "orders").select("o_custkey").intersect(_t(s, d, "customer").where("c_acctbal > 0").select("c_custkey")).subtract(_t(s, d, "customer").where("c_nationkey = 3").select("c_custkey")),
    "x_top_k": lambda s, d: _t(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(20),
    "x_tumbling_window": lambda s, d: _t(s, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n"),
    "x_session_window": lambda s, d: _t(s, d, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), "n"),
    "x_top_share": lambda s, d: _t(s, d, "lineitem").groupBy("l_suppkey").agg(_tot()).orderBy(F.desc("q"), "l_suppkey").limit(10).select("l_suppkey", "q"),
    "x_json_maps": lambda s, d: _t(s, d, "events").select("event_id", F.map_values(F.from_json("props", "map<string,bigint>"))[0].alias("k")),
    "x_approximate": lambda s, d: _t(s, d, "lineitem").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median")),
}

_v = fx.with_views
_q = "sum(round(l_quantity)::bigint)::bigint as q"
SQL = {
    "o1_ring_order": _v(f"""with {cache._LATEST}, {cache._RING}, r as (select node, hi from points union all select (select arg_min(node, hi) from points), 4294967296)
  select node, hi, row_number() over (order by hi, node) as place from r""", "cache_entries", "servants"),
    "u2_merged_listings": _v("select key, size from cache_entries", "cache_entries"),
    "u4_first_environment": _v("""with a as (select environments[1] as env, registry_ord, 0 as rank from servants where registry_ord % 3 = 0
  union all select environments[2], registry_ord, 1 from servants where registry_ord % 3 <> 0) select env, min(rank)::int as rank, arg_min(registry_ord, (rank, registry_ord)) as registry_ord from a group by env""", "servants"),
    "s3_stray_files": cache._e(f"select '/data/cache/' || path || '.tmp/x' as path from paths where {_STRAY}", cache._RING, cache._PATH),
    "s9_startup_load": cache._e(f"""select case when {_STRAY} then path || '.tmp/x' when {_OLD} then 'old/0/0/' || url_encode(key) else path end as path, case when not {_STRAY} then key end as key,
  case when not {_STRAY} then path end as expected, case when {_STRAY} then 'stray' when {_OLD} then 'move' else 'load' end as action from paths""", cache._RING, cache._PATH),
    "p21_admission": _v("select registry_ord, running_tasks + 1 <= max_tasks and memory_available_gib >= 2 as admitted from servants", "servants"),
    "t2_zombie_leases": _v("""select event_id, coalesce(lead(ts) over (partition by servant, k order by ts, event_id), timestamp '2024-02-01') > ts + interval 3 days as becomes_zombie from heartbeats""", "heartbeats"),
    "t6_prefetch": _v("select env, submitted_at::date as day, count(*) as immediate, 1::bigint as prefetch from requests group by 1, 2", "requests"),
    "x_join_inner": "select c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey group by 1",
    "x_join_outer": "select count(c_custkey) as c, count(o_orderkey) as o from customer full join orders on o_custkey = c_custkey",
    "x_join_semi": "select c_custkey from customer where c_custkey in (select o_custkey from orders)",
    "x_join_anti": "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
    "x_rollup": f"select l_returnflag, l_linestatus, {_q} from lineitem group by rollup(l_returnflag, l_linestatus)",
    "x_cube": f"select l_returnflag, l_linestatus, {_q} from lineitem group by cube(l_returnflag, l_linestatus)",
    "x_grouping_sets": f"select l_returnflag, l_linestatus, {_q} from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())",
    "x_count_distinct": "select l_returnflag, count(distinct l_partkey) as parts from lineitem group by 1",
    "x_ranks": "select o_orderkey, rank() over w as r, dense_rank() over w as d from orders window w as (partition by o_custkey order by o_orderdate)",
    "x_frames": """select o_orderkey, count(*) over (partition by o_custkey order by o_orderkey rows between 2 preceding and 1 following) as near,
  first_value(o_orderkey) over (partition by o_custkey order by o_orderkey) as first from orders""",
    "x_set_operations": "(select o_custkey from orders intersect select c_custkey from customer where c_acctbal > 0) except select c_custkey from customer where c_nationkey = 3",
    "x_top_k": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
    "x_tumbling_window": "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n from events group by 1, 2",
    "x_session_window": """with m as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hours then 1 else 0 end as new from events),
  n as (select *, sum(new) over (partition by user_id order by ts) as g from m) select user_id, min(ts) as began, count(*) as n from n group by user_id, g""",
    "x_top_share": f"select l_suppkey, {_q} from lineitem group by 1 order by q desc, l_suppkey limit 10",
    "x_json_maps": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
}
