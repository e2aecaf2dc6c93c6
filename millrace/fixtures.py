"""Domain tables derived from the driver's star schema, for the registered queries and their tests.

``SQL`` holds the same views as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of machines that requests, grants and heartbeats are dealt over.
MACHINES = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def servants(spark: SparkSession, d: str) -> DataFrame:
    """Executor hosts: one row per supplier."""
    return table(spark, d, "supplier").selectExpr(
        "s_suppkey as registry_ord",
        "concat('10.0.', s_suppkey div 256, '.', s_suppkey % 256, ':8335') as observed_location",
        "case when s_suppkey % 13 = 0 then '192.168.0.1:8335' else concat('10.0.', s_suppkey div 256, '.', s_suppkey % 256, ':8335') end as reported_location",
        "cast(8 * (1 + s_nationkey % 4) as bigint) as num_processors",
        "cast(case when s_suppkey % 11 = 0 then 0 else (8 * (1 + s_nationkey % 4) * 40) div 100 end as bigint) as max_tasks",
        "cast(s_nationkey as bigint) as current_load",
        "cast(case when s_suppkey % 5 = 0 then 1 else 2 end as int) as priority",
        "18 + s_suppkey % 3 as version",
        "cast(case when s_suppkey % 7 = 0 then 0 else 64 end as bigint) as total_memory_gib",
        "cast(floor(abs(s_acctbal)) as bigint) % 64 as memory_available_gib",
        "array(concat('env', s_suppkey % 5), concat('env', (s_suppkey + 2) % 5)) as environments",
        "s_suppkey % 4 as running_tasks",
        "concat('token', s_suppkey % 6) as token",
        "cast((s_suppkey % 40) * 1000 as bigint) as next_heartbeat_in_ms",
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Task requests: one row per order."""
    n = MACHINES
    return table(spark, d, "orders").selectExpr(
        "o_orderkey as request_id",
        f"concat('10.0.', (o_custkey % {n}) div 256, '.', (o_custkey % {n}) % 256) as requestor_ip",
        "concat('env', cast(substr(o_orderpriority, 1, 1) as int) - 1) as env",
        "18 + o_orderkey % 3 as min_version",
        "o_orderdate as submitted_at",
        "concat('token', o_custkey % 5) as token",
        "cast((o_custkey % 15) * 1000 as bigint) as wait_ms",
    )


def grants(spark: SparkSession, d: str) -> DataFrame:
    """Task grants: one row per distinct line item key."""
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 1000000 + l_partkey * 8 + l_linenumber as grant_id", f"l_suppkey % {MACHINES} as servant", "l_shipdate as started_at",
        "l_returnflag = 'R' as zombie", "l_linestatus = 'F' as is_prefetch", "concat('digest', l_partkey % 500) as digest",
    ).groupBy("grant_id", "servant").agg(
        F.min("started_at").alias("started_at"), F.max("zombie").alias("zombie"), F.max("is_prefetch").alias("is_prefetch"), F.min("digest").alias("digest")
    )


def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """Heartbeats: one row per event; ``grant_id`` is a grant that it reports as running, often of another machine."""
    return table(spark, d, "events").selectExpr(
        f"user_id % {MACHINES} as servant", "ts", "cast(get_json_object(props, '$.k') as bigint) as k", "event_type as kind", "event_id",
        "value",
    )


def cache_entries(spark: SparkSession, d: str) -> DataFrame:
    """Cache entries: one row per document; equal texts share a key."""
    return table(spark, d, "documents").selectExpr(
        "concat('entry-', sha2(text, 256)) as key", "n_chars as size",
        "cast(conv(substr(md5(cast(doc_id as string)), 1, 8), 16, 10) as bigint) % 2592000 as last_used", "doc_id as seq", "source as tenant",
    )


def command_lines(spark: SparkSession, d: str) -> DataFrame:
    """Compiler command lines built from parts."""
    piece = lambda cond, *words: F.when(F.expr(cond), F.array(*[F.expr(w) for w in words])).otherwise(F.array().cast("array<string>"))
    argv = F.concat(
        piece("p_partkey % 4 <> 0", "'-c'"), piece("p_partkey % 5 = 0", "'-x'", "'c++'"), piece("p_partkey % 23 = 0", "'-x'", "'assembler'"),
        piece("true", "'-std=c++11'"), piece("p_partkey % 3 <> 0", "'-I'", "concat('/usr/include/', lower(substr(p_brand, 7, 2)))"),
        piece("p_partkey % 9 = 0", "'-D__TIME__=0'", "'-D__DATE__=0'", "'-D__TIMESTAMP__=0'"), piece("p_partkey % 8 = 0", "'-MMD'", "'-MF'", "concat('dep', p_partkey, '.d')"),
        piece("p_partkey % 17 = 0", "'-'"), piece("p_partkey % 11 = 0", "'-E'"), piece("p_partkey % 19 = 0", "'-dumpversion'"),
        piece("p_partkey % 3 <> 1", "'-o'", "concat('out/', p_partkey, '.o')"),
        piece("true", "concat('src/', p_name, p_partkey, element_at(array('.cc', '.c', '.S', '.cpp', '.cxx', '.s'), cast(1 + p_size % 6 as int)))"),
        piece("p_partkey % 13 = 0", "'extra file.cc'"),
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), argv.alias("argv"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Submitted tasks with their digest and cache control."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey as task_id", "concat('digest', o_custkey % 700) as digest", "concat('entry-', o_custkey % 900) as cache_key",
        "cast(o_orderkey % 3 as int) as cache_control",
        "case o_orderstatus when 'O' then 'Pending' when 'F' then 'Done' else 'Dispatched' end as state",
        "cast(o_totalprice as bigint) % 5 - 1 as exit_code", "o_orderdate as started_at", "o_custkey as requestor",
    )


_S = "'10.0.' || (s_suppkey // 256) || '.' || (s_suppkey % 256) || ':8335'"


def _piece(cond: str, *words: str) -> str:
    return f"case when {cond} then [{', '.join(words)}] else []::varchar[] end"


SQL = {
    "servants": f"""select s_suppkey as registry_ord, {_S} as observed_location,
  case when s_suppkey % 13 = 0 then '192.168.0.1:8335' else {_S} end as reported_location,
  (8 * (1 + s_nationkey % 4))::bigint as num_processors,
  (case when s_suppkey % 11 = 0 then 0 else (8 * (1 + s_nationkey % 4) * 40) // 100 end)::bigint as max_tasks,
  s_nationkey::bigint as current_load, (case when s_suppkey % 5 = 0 then 1 else 2 end)::int as priority, 18 + s_suppkey % 3 as version,
  (case when s_suppkey % 7 = 0 then 0 else 64 end)::bigint as total_memory_gib, floor(abs(s_acctbal))::bigint % 64 as memory_available_gib,
  ['env' || (s_suppkey % 5), 'env' || ((s_suppkey + 2) % 5)] as environments, s_suppkey % 4 as running_tasks,
  'token' || (s_suppkey % 6) as token, ((s_suppkey % 40) * 1000)::bigint as next_heartbeat_in_ms from supplier""",
    "requests": f"""select o_orderkey as request_id, '10.0.' || ((o_custkey % {MACHINES}) // 256) || '.' || ((o_custkey % {MACHINES}) % 256) as requestor_ip,
  'env' || (substr(o_orderpriority, 1, 1)::int - 1) as env, 18 + o_orderkey % 3 as min_version, o_orderdate as submitted_at,
  'token' || (o_custkey % 5) as token, ((o_custkey % 15) * 1000)::bigint as wait_ms from orders""",
    "grants": f"""select grant_id, servant, min(started_at) as started_at, bool_or(zombie) as zombie, bool_or(is_prefetch) as is_prefetch, min(digest) as digest
  from (select l_orderkey * 1000000 + l_partkey * 8 + l_linenumber as grant_id, l_suppkey % {MACHINES} as servant, l_shipdate as started_at,
  l_returnflag = 'R' as zombie, l_linestatus = 'F' as is_prefetch, 'digest' || (l_partkey % 500) as digest from lineitem) group by all""",
    "heartbeats": f"""select user_id % {MACHINES} as servant, ts, json_extract_string(props, '$.k')::bigint as k, event_type as kind, event_id, value from events""",
    "cache_entries": """select 'entry-' || sha256(text) as key, n_chars as size,
  ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 2592000 as last_used, doc_id as seq, source as tenant from documents""",
    "command_lines": "select p_partkey as id, list_concat("
    + ", ".join([
        _piece("p_partkey % 4 <> 0", "'-c'"), _piece("p_partkey % 5 = 0", "'-x'", "'c++'"), _piece("p_partkey % 23 = 0", "'-x'", "'assembler'"),
        "['-std=c++11']", _piece("p_partkey % 3 <> 0", "'-I'", "'/usr/include/' || lower(substr(p_brand, 7, 2))"),
        _piece("p_partkey % 9 = 0", "'-D__TIME__=0'", "'-D__DATE__=0'", "'-D__TIMESTAMP__=0'"), _piece("p_partkey % 8 = 0", "'-MMD'", "'-MF'", "'dep' || p_partkey || '.d'"),
        _piece("p_partkey % 17 = 0", "'-'"), _piece("p_partkey % 11 = 0", "'-E'"), _piece("p_partkey % 19 = 0", "'-dumpversion'"),
        _piece("p_partkey % 3 <> 1", "'-o'", "'out/' || p_partkey || '.o'"),
        "['src/' || p_name || p_partkey || (['.cc', '.c', '.S', '.cpp', '.cxx', '.s'])[1 + p_size % 6]]", _piece("p_partkey % 13 = 0", "'extra file.cc'"),
    ]) + ") as argv from part",
    "tasks": """select o_orderkey as task_id, 'digest' || (o_custkey % 700) as digest, 'entry-' || (o_custkey % 900) as cache_key,
  (o_orderkey % 3)::int as cache_control, case o_orderstatus when 'O' then 'Pending' when 'F' then 'Done' else 'Dispatched' end as state,
  trunc(o_totalprice)::bigint % 5 - 1 as exit_code, o_orderdate as started_at, o_custkey as requestor from orders""",
}


def with_views(body: str, *names: str) -> str:
    """``body`` after the named views as common table expressions; a body that begins with more of them continues the list."""
    views = ",\n".join(f"{n} as ({SQL[n]})" for n in names)
    body = body.strip()
    return f"with {views},\n{body[5:]}" if body.startswith("with ") else f"with {views}\n{body}"
