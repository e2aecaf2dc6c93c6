"""Registered queries on a cache's files, its versioned index and messages; files are written from the given tables to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import fixtures as fx
from millrace.functions import messages
from millrace.operators.versions import VersionedIndex
from millrace.sources import cache_tree
from millrace.streaming import run

#: Milliseconds that the log of the query on it is kept.
_KEPT = 10 * 86_400_000


def _tree(s, d):
    """Every distinct text as an entry of a cache tree, read back by the prefix of its key."""
    cache_tree.register(s)
    root = f"{run.shared_dir(s)}/cache-{uuid.uuid4().hex}"
    entries = fx.table(s, d, "documents").select(F.concat(F.lit("entry-"), F.sha2("text", 256)).alias("key"), F.col("text").cast("binary").alias("value")).dropDuplicates(["key"])
    entries.write.format("millrace_cache").option("path", root).mode("append").save()
    found = s.read.format("millrace_cache").option("path", root).load().where("key like 'entry-a%'")
    return found.select("key", "size", F.sha2("value", 256).alias("value_sha"))


def _log(s, d):
    """The keys of a cache's log as a first fetch gives them: a segment for each hour, as far back as the log is kept."""
    cache_tree.register(s)
    root = f"{run.shared_dir(s)}/log-{uuid.uuid4().hex}"
    hours = fx.cache_entries(s, d).groupBy(F.floor(F.col("last_used") / 3600).alias("hour")).agg(F.max("last_used").alias("at"), F.collect_set("key").alias("keys"))
    hours.foreach(lambda r: cache_tree.log_keys(root, sorted(r["keys"]), r["at"] * 1000))
    return run.available_now(s.readStream.format("millrace_key_log").option("path", root).option("kept", _KEPT).load())


def _index(s, d):
    """Four weeks of puts, gets and purges as four versions, the second one compacted; the index as the third one left it."""
    index = VersionedIndex(s, f"{run.shared_dir(s)}/index-{uuid.uuid4().hex}")
    changes = fx.table(s, d, "events").selectExpr(
        "concat('entry-', user_id) as key", "case event_type when 'error' then 'purge' when 'view' then 'get' when 'click' then 'get' else 'put' end as op",
        "cast(get_json_object(props, '$.k') as bigint) as size", "unix_micros(cast(ts as timestamp)) as ts", "event_id as seq", "cast((day(ts) - 1) / 8 as int) as week")
    for week in range(4):
        version = index.apply(changes.where(F.col("week") == week).drop("week"))
        if version == 2:
            index.compact()
    return index.snapshot(3)


_FILE = T.StructType([T.StructField("suffix", T.StringType()), T.StructField("size", T.LongType()), T.StructField("patched", T.BooleanType())])
_TASK = T.StructType([
    T.StructField("task_id", T.LongType()), T.StructField("cache_control", T.IntegerType(), metadata={"enum": {"DISALLOW": 0, "ALLOW": 1, "REFILL": 2}}),
    T.StructField("source_path", T.StringType()), T.StructField("files", T.ArrayType(_FILE)), T.StructField("compiler", T.StructType([T.StructField("digest", T.StringType())])),
])


def _messages(s, d):
    """Orders as task messages, and what reading them back gives."""
    file = lambda suffix, when: F.struct(F.lit(suffix).alias("suffix"), F.when(F.expr(when), F.col("o_custkey")).alias("size"), F.lit(None).cast("boolean").alias("patched"))
    task = F.struct(
        F.col("o_orderkey").alias("task_id"), F.expr("cast(nullif(o_orderkey % 3, 0) as int)").alias("cache_control"), F.expr("if(o_orderkey % 5 = 0, null, o_orderpriority)").alias("source_path"),
        F.when(F.expr("o_orderkey % 4 > 0"), F.array(file(".o", "true"), file(".gcno", "o_custkey % 2 = 0"))).alias("files"),
        F.when(F.expr("o_orderkey % 7 > 0"), F.struct(F.expr("nullif(o_orderstatus, 'F')").alias("digest"))).alias("compiler"))
    shown = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), messages.to_message(task, _TASK).alias("message"))
    # a reader of a later version, with a field that it does not know, and a message that broke in every eleventh
    sent = F.when(F.col("id") % 11 == 0, F.expr("left(message, length(message) - 1)")).otherwise(F.concat(F.lit('{"later":[1,{}],'), F.expr("substr(message, 2)")))
    back = messages.from_message(sent, _TASK)
    return shown.withColumn("m", back).select("id", "message", "m.task_id", "m.cache_control", "m.source_path", F.aggregate("m.files", F.lit(0).cast("long"), lambda a, f: a + f["size"]).alias("bytes"), "m.compiler.digest")


QUERIES = {"s8_cache_source": _tree, "t9_key_log_stream": _log, "t12_index_snapshot": _index, "f32_messages": _messages}

SQL = {
    "s8_cache_source": "select distinct 'entry-' || sha256(text) as key, strlen(text) as size, sha256(text) as value_sha from documents where sha256(text) like 'a%'",
    "t9_key_log_stream": fx.with_views(f"""with t as (select key, max(last_used) over (partition by last_used // 3600) * 1000 as at_ms from cache_entries)
  select distinct key, at_ms, true as full from t where at_ms >= (select max(at_ms) from t) - {_KEPT}""", "cache_entries").replace("as full", 'as "full"'),
    "t12_index_snapshot": """with c as (select 'entry-' || user_id as key, case event_type when 'error' then 'purge' when 'view' then 'get' when 'click' then 'get' else 'put' end as op,
    json_extract_string(props, '$.k')::bigint as size, epoch_us(ts) as t, event_id from events where day(ts) <= 24),
  p as (select *, count(*) filter (op = 'purge') over (partition by key order by t, event_id) as life from c),
  f as (select key, life, min(t) filter (op = 'put') as first_put, arg_max(size, t) filter (op = 'put') as size, count(*) filter (op = 'put') - 1 as overwrites from p group by 1, 2)
  select f.key, f.size, (select max(p.t) from p where p.key = f.key and p.life = f.life and p.op <> 'purge' and p.t >= f.first_put) as last_used, overwrites
  from f where first_put is not null and (key, life) in (select key, max(life) from p group by 1)""",
    "f32_messages": """with o as (select o_orderkey as id, o_orderkey % 3 as cc, case when o_orderkey % 5 = 0 then '' else o_orderpriority end as path, o_custkey as size, if(o_custkey % 2 = 0, o_custkey, 0) as size2,
    o_orderkey % 4 > 0 as has, o_orderkey % 7 > 0 as comp, if(o_orderstatus = 'F', '', o_orderstatus) as digest from orders)
  select id, '{"task_id":"' || id || '","cache_control":' || cc || ',"source_path":"' || path || '","files":[' || if(has, '{"suffix":".o","size":"' || size || '","patched":false},{"suffix":".gcno","size":"' || size2 || '","patched":false}', '')
    || ']' || if(comp, ',"compiler":{"digest":"' || digest || '"}', '') || '}' as message,
    if(id % 11 = 0, null, id) as task_id, if(id % 11 = 0, null, cc)::int as cache_control, if(id % 11 = 0, null, path) as source_path, if(id % 11 = 0, null, if(has, size + size2, 0)) as bytes, if(id % 11 = 0 or not comp, null, digest) as digest from o""",
}
