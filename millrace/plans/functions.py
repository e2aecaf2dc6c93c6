"""Registered queries on scalar functions and command lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import fixtures as fx
from millrace.functions import arguments, framing, machines, text
from millrace.operators import tasks

_OPTS = "[" + ", ".join(f"'{o}'" for o in arguments.ONE_VALUE) + "]"
# A word is an option's value if the unbroken run of value-taking options before it has an odd length.
_PARSE = f"""w as (select id, argv, unnest(argv) as a, generate_subscripts(argv, 1) as i from command_lines),
t as (select *, list_contains({_OPTS}, a) as takes from w),
r as (select *, i - 1 - coalesce(max(case when not takes then i end) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0) as before from t),
q as (select *, before % 2 = 1 as is_value from r),
p as (select *, case when is_value then 'v' when starts_with(a, '-') then 'o' else 'f' end as kind, coalesce(lead(is_value) over (partition by id order by i), false) as has_value,
  lead(a) over (partition by id order by i) as next from q),
cl as (select id, count(*) filter (kind = 'o') as n_options, list(a order by i) filter (kind = 'f') as files,
  bool_or(kind = 'o' and a = '-c') as c, bool_or(kind = 'o' and a = '-') as dash, bool_or(kind = 'o' and a in ('-dumpversion', '-dumpmachine', '-E')) as light,
  arg_min(next, i) filter (kind = 'o' and a = '-x') as x, arg_min(next, i) filter (kind = 'o' and a = '-o') as o,
  arg_min(next, i) filter (kind = 'o' and starts_with(a, '-I')) as inc from p group by id)"""
_DROP = "a in ('-MMD', '-MF', '-MD', '-MT', '-MP', '-o', '-Wmissing-include-dirs') or regexp_matches(a, '^(-Wp,-MMD|-Wp,-MF|-Wp,-MD|-Wp,-MP|-I|-include|-isystem)')"
_KEEP = f"""d as (select *, case when kind = 'o' then {_DROP} else lag(case when kind = 'o' then {_DROP} end) over (partition by id order by i) end as gone from p),
kept as (select id, coalesce(list(a order by i) filter (kind <> 'f' and not gone), []) as words from d group by id)"""
_ESC = r"""replace(replace(replace(replace(regexp_replace({}, '([ ><!"#$&()*,:;?@\[\\\]`{{}}])', '\\\1', 'g'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), chr(8), '\b')"""


def _cl(s, d):
    return fx.command_lines(s, d).withColumn("p", arguments.parse(F.col("argv")))


def _src(s, d):
    return fx.table(s, d, "documents").selectExpr("doc_id as id", "text", "lang", "concat('-x', lang) as args")


def _docs(expr, alias="v"):
    return lambda s, d: fx.table(s, d, "documents").select("doc_id", expr().alias(alias))


def _pages(expr, alias="v"):
    return lambda s, d: fx.table(s, d, "pages").select("page_id", expr().alias(alias))


def _parts(s, d):
    return fx.table(s, d, "part").selectExpr(
        "p_partkey as id", "p_size", "p_brand", "p_name", "concat(p_partkey, element_at(array('', 'B', 'K', 'M', 'G', 'A', 'KB'), cast(1 + p_partkey % 7 as int))) as size_text",
        "concat(p_size, 'K,/data/', p_partkey, ':', p_size, 'G,/cache/', p_size) as dirs", "concat('out/', p_partkey, '.o') as destination",
        "element_at(array('.o', '.gcno', '.su'), cast(1 + p_partkey % 3 as int)) as suffix",
        "element_at(array('1', 'y', 'YES', 'True', 'no', '0', ''), cast(1 + p_partkey % 7 as int)) as flag",
        "concat(element_at(array('/opt/gcc', '/usr/bin/x', '/opt/rh/t', '/home/u'), cast(1 + p_partkey % 4 as int)), case when p_size % 3 = 0 then '/lib' else '/bin' end, '/g++') as compiler",
        "cast(p_partkey * 20000000 as bigint) as bytes", "cast(p_size as bigint) as cores", "cast(p_partkey % 12 as bigint) * 1073741824 as shm")


_PARTS = """parts as (select p_partkey as id, p_size, p_brand, p_name, p_partkey || (['', 'B', 'K', 'M', 'G', 'A', 'KB'])[1 + p_partkey % 7] as size_text,
 p_size || 'K,/data/' || p_partkey || ':' || p_size || 'G,/cache/' || p_size as dirs, 'out/' || p_partkey || '.o' as destination,
 (['.o', '.gcno', '.su'])[1 + p_partkey % 3] as suffix, (['1', 'y', 'YES', 'True', 'no', '0', ''])[1 + p_partkey % 7] as flag,
 (['/opt/gcc', '/usr/bin/x', '/opt/rh/t', '/home/u'])[1 + p_partkey % 4] || case when p_size % 3 = 0 then '/lib' else '/bin' end || '/g++' as compiler,
 (p_partkey * 20000000)::bigint as bytes, p_size::bigint as cores, (p_partkey % 12)::bigint * 1073741824 as shm from part)"""

QUERIES = {
    "f1_split_parts": _pages(lambda: F.array_join(text.split_parts(F.col("url"), "/"), "|")),
    "f2_split_tokens": lambda s, d: _parts(s, d).select("id", F.size(text.split_tokens(F.concat("dirs", F.lit(",")))).alias("v")),
    "f3_join": lambda s, d: fx.command_lines(s, d).select("id", F.array_join("argv", " ").alias("v")),
    "f4_affixes": _pages(lambda: F.col("url").startswith("https:") & F.col("url").endswith("top")),
    "f5_paths": lambda s, d: fx.table(s, d, "pages").select("page_id", text.base_name(F.col("url")).alias("base"), text.directory_name(F.col("url")).alias("directory")),
    "f7_shell_escape": lambda s, d: fx.table(s, d, "conversations").select("conv_id", "turn", text.shell_escape(F.col("text")).alias("v")),
    "f8_parse": lambda s, d: _cl(s, d).select("id", F.size("p.options").cast("bigint").alias("n_options"), F.array_join("p.files", "|").alias("files")),
    "f9_lookup": lambda s, d: _cl(s, d).select("id", F.get(arguments.lookup(F.col("p.options"), "-I", True)["args"], F.lit(0)).alias("v")),
    "f10_rewrite": lambda s, d: _cl(s, d).select("id", F.array_join(arguments.rewrite(F.col("p"), arguments.REMOTE_DROP, arguments.REMOTE_DROP_PREFIXES, ("-fpreprocessed", "-x", "c++", "-"), False), " ").alias("v")),
    "f12_output_path": lambda s, d: _cl(s, d).select("id", arguments.output_path(F.col("p")).alias("v")),
    "f13_command_line": lambda s, d: fx.command_lines(s, d).select("id", text.command_line(F.col("argv"), F.lit("g++")).alias("v")),
    "f14_parse_size": lambda s, d: _parts(s, d).select("id", text.parse_size(F.col("size_text")).alias("v")),
    "f15_cache_dirs": lambda s, d: _parts(s, d).select("id", F.explode(text.parse_cache_dirs(F.col("dirs"))).alias("c")).select("id", "c.size", "c.path"),
    "f16_directory_weight": lambda s, d: _parts(s, d).select("id", text.directory_weight(F.col("bytes")).alias("v")),
    "f17_iso_time": lambda s, d: fx.heartbeats(s, d).select("event_id", text.parse_iso_time(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 5 == 0, ".12Z").otherwise(".123Z"))).cast("timestamp_ntz").alias("v")),
    "f18_time_format": lambda s, d: fx.heartbeats(s, d).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("v")),
    "f19_bool": lambda s, d: _parts(s, d).select("id", text.parse_bool(F.col("flag")).alias("v")),
    "f20_task_digest": lambda s, d: _src(s, d).select("id", framing.task_digest(F.col("lang"), F.col("args"), F.col("text")).alias("v")),
    "f21_cache_key": lambda s, d: _src(s, d).select("id", framing.cache_key(F.col("lang"), F.col("args"), F.col("text")).alias("v")),
    "f23_subdirectories": lambda s, d: fx.cache_entries(s, d).select("seq", framing.subdirectories(framing.ring_hash(F.col("key"))).alias("h")).select("seq", "h.d0", "h.d1"),
    "f25_percent_encoding": lambda s, d: fx.table(s, d, "conversations").select("conv_id", "turn", text.percent_encode(F.col("text")).alias("v"), (text.percent_decode(text.percent_encode(F.col("text"))) == F.col("text")).alias("same")),
    "f27_encode_chunks": lambda s, d: fx.table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", F.sha2(framing.encode_chunks(F.col("t.text")), 256).alias("v")),
    "f28_decode_chunks": lambda s, d: fx.table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")).select(
        "conv_id", F.posexplode(framing.decode_chunks(framing.encode_chunks(F.col("t.text")).cast("binary"))).alias("i", "b")).select("conv_id", F.col("i").cast("bigint").alias("i"), F.sha2("b", 256).alias("v")),
    "f30_checksum": lambda s, d: fx.table(s, d, "documents").select("doc_id", framing.add_checksum(F.coalesce("text", F.lit("")).cast("binary")).alias("b")).select(
        "doc_id", F.sha2(framing.checked_body(F.when(F.col("doc_id") % 5 == 0, F.concat("b", F.lit("x").cast("binary"))).when(F.col("doc_id") % 5 == 1, F.substring("b", F.lit(1), F.lit(60))).otherwise(F.col("b"))), 256).alias("v")),
    "f32_json": lambda s, d: fx.servants(s, d).select("registry_ord", F.to_json(F.struct(F.col("max_tasks").cast("string").alias("max_tasks"), F.col("priority"), F.when(F.col("registry_ord") % 2 == 0, F.col("observed_location")).alias("location")), {"ignoreNullFields": "false"}).alias("v")),
    "f33_apply_patch": lambda s, d: fx.table(s, d, "part").selectExpr("p_partkey as id", "concat('head', rpad('/long/workspace', 40, 'A'), p_name, unhex('00'), 'tail') as data", "cast(length(p_name) as int) as keep").select(
        "id", F.hex(framing.apply_patch(F.col("data").cast("binary"), F.expr("array(named_struct('position', 4, 'total_size', 40 + keep, 'suffix_to_keep', keep))"), F.concat(F.lit("/w/"), F.col("id").cast("string")))).alias("v")),
    "f34_expected_path": lambda s, d: _parts(s, d).select("id", text.expected_path(F.when(F.col("id") % 2 == 0, F.col("destination")).otherwise(F.concat(F.lit("/abs/"), "destination")), F.lit("/work")).alias("v")),
    "f35_linemarkers": lambda s, d: _parts(s, d).select("id", text.neutral_linemarkers(F.concat(F.lit("# 12 \""), "compiler", F.lit("/include/a.h\" 1")), text.compiler_root(F.col("compiler"), F.lit(False))).alias("v")),
    "f36_padded_workspace": lambda s, d: _parts(s, d).select("id", F.md5(text.padded_workspace(F.concat(F.lit("/dev/shm/"), F.col("id").cast("string")))).alias("v")),
    "f37_result_name": lambda s, d: _parts(s, d).select("id", text.result_name(F.col("suffix"), F.col("destination")).alias("v")),
    "f38_fetch_interval": lambda s, d: fx.servants(s, d).select("registry_ord", (F.lit(600) + framing.ring_hash(F.col("observed_location")) % 120).alias("v")),
    "f39_executor_limit": lambda s, d: fx.table(s, d, "part").select("p_partkey", machines.executor_limit(F.expr("if(p_size % 9 = 0, p_size, -1)"), F.expr("p_brand like '%1'"), F.col("p_size") * 2, F.expr("p_partkey % 6 = 0")).alias("v")),
    "f40_local_limit": lambda s, d: fx.table(s, d, "part").select("p_partkey", machines.local_limits(F.expr("if(p_size % 9 = 0, p_size, 0)"), F.expr("nullif(p_partkey % 40, 0)"), F.col("p_size"), 0.5).alias("v")).select("p_partkey", "v.*"),
    "f41_temp_dir": lambda s, d: fx.table(s, d, "part").select("p_partkey", machines.temp_dir(F.expr("if(p_brand like '%2', '', p_name)"), F.expr("cast(p_retailprice * 8000000 as bigint)")).alias("v")),
    "f43_content_hash": _docs(lambda: F.sha2("text", 256)),
    "s11_cgroup": lambda s, d: fx.table(s, d, "part").select("p_partkey", machines.in_cgroup(F.expr("array(concat('9:', if(p_size % 2 = 0, 'pids', 'cpu,cpuacct'), ':', if(p_size % 3 = 0, '/', '/docker/a:b')), if(p_partkey % 10 = 0, '0::/init.scope', '4:memory:/user.slice'), 'x')")).alias("v")),
    "s21_keyed_buffers": lambda s, d: fx.table(s, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.concat("role", F.col("turn").cast("string")), F.octet_length("text"))))).alias("m")).select("conv_id", F.explode("m").alias("name", "bytes")),
    "p8_distributable": lambda s, d: _cl(s, d).select("id", F.coalesce(arguments.distributable(F.col("p")), F.lit(False)).alias("v")),
    "p9_lightweight": lambda s, d: _cl(s, d).select("id", arguments.lightweight(F.col("p")).alias("v")),
    "p10_small_input": lambda s, d: fx.table(s, d, "documents").where(F.octet_length("text") < 8192).select("doc_id"),
    "p11_cacheable": lambda s, d: fx.command_lines(s, d).select("id", arguments.cacheable(F.col("argv"), F.concat(F.lit("int main() { return "), F.when(F.col("id") % 4 == 0, "__TIMESTAMP__").when(F.col("id") % 4 == 1, "__DATE__").when(F.col("id") % 4 == 2, "TIME").otherwise("0"), F.lit("; }"))).alias("v")),
    "p12_submit_validation": lambda s, d: fx.table(s, d, "orders").select("o_orderkey", machines.submit_error(
        F.expr("if(o_custkey % 13 = 0, 1, o_custkey + 1)"), F.expr("if(o_orderkey % 11 = 0, '', o_orderpriority)"), F.expr("if(o_orderkey % 17 = 0, null, o_orderstatus)"), F.expr("o_orderkey % 4"), F.expr("if(o_orderkey % 5 = 0, '', 'd')")).alias("v")),
    "p13_no_wrappers": lambda s, d: fx.table(s, d, "part").select("p_partkey", F.concat(F.lit("/usr/bin/"), F.expr("element_at(array('g++', 'ccache', 'distcc', 'gcc-icecc', 'ccache-g++', 'clang'), cast(1 + p_size % 6 as int))")).alias("path")).where(
        ~machines.is_wrapper(F.col("path"))),
    "p14_executable": lambda s, d: fx.table(s, d, "part").select("p_partkey", machines.executable(
        F.expr("cast(p_partkey % 512 as int)"), F.expr("p_size % 3"), F.expr("p_size % 5"), F.lit(1), F.array(F.lit(2), F.lit(4))).alias("v")),
    "p15_language": lambda s, d: _cl(s, d).select("id", arguments.language(F.col("p")).alias("v")),
    "p16_compiler_root": lambda s, d: _parts(s, d).select("id", text.compiler_root(F.col("compiler"), F.col("id") % 10 == 0).alias("v")),
    "p19_filter_request": lambda s, d: _parts(s, d).selectExpr("id", "id % 50 <= p_size as v"),
    "p20_alive": lambda s, d: _parts(s, d).selectExpr("id", "element_at(array('R', 'S', 'Z', 'x', 'D', 'X'), cast(1 + id % 6 as int)) not in ('Z', 'x', 'X') as v"),
    "a13_all_any": lambda s, d: fx.command_lines(s, d).select("id", F.forall("argv", lambda a: a != "").alias("every"), F.exists("argv", lambda a: a == "-E").alias("some")),
    "a16_digest_dump": lambda s, d: fx.cache_entries(s, d).groupBy("key").agg(F.max_by(F.struct("seq", "size"), "seq").alias("last")).select("key", F.to_json("last").alias("v")),
    "j6_compilers_changed": lambda s, d: fx.servants(s, d).where("registry_ord % 3 <> 0").select("registry_ord").withColumn("old", F.lit(True)).join(
        fx.servants(s, d).where("registry_ord % 4 <> 0").select("registry_ord").withColumn("new", F.lit(True)), "registry_ord", "full").where("old is null or new is null").select("registry_ord", F.when(F.col("old").isNull(), "found").otherwise("gone").alias("change")),
    "j10_patches": lambda s, d: tasks.with_patches(fx.tasks(s, d).where("task_id % 3 = 0").selectExpr("task_id", "concat('.', task_id % 4) as suffix"),
        fx.tasks(s, d).where("task_id % 2 = 0").selectExpr("task_id", "concat('.', task_id % 8) as suffix", "task_id % 100 as position")),
    "j14_process_task": lambda s, d: fx.tasks(s, d).selectExpr("requestor as pid", "task_id").join(fx.heartbeats(s, d).selectExpr("k as pid").distinct(), "pid").select("pid", "task_id"),
    "j15_positional": lambda s, d: fx.tasks(s, d).select("requestor", F.floor(F.col("task_id") / 64).alias("call"), "task_id").groupBy("requestor", "call").agg(F.sort_array(F.collect_list("task_id")).alias("ids")).select(
        F.explode(F.arrays_zip("ids", F.transform("ids", lambda x: x % 3 == 0).alias("ok"))).alias("z")).select(F.col("z.ids").alias("task_id"), F.col("z.ok").alias("ok")),  # a call names 64 tasks at most
    "o3_sorted_names": lambda s, d: fx.servants(s, d).select("registry_ord", F.array_join(F.sort_array("environments"), ",").alias("v")),
    "o5_first_match": lambda s, d: fx.command_lines(s, d).select("id", F.get(F.filter("argv", lambda a: a.startswith("-D")), F.lit(0)).alias("v")),
}

_v = fx.with_views
_c = lambda cols: _v(f"with {_PARSE} select id, {cols} from cl", "command_lines")
_p = lambda cols, more="": f"with {_PARTS} select id, {cols} from parts {more}"
_root = "(case when {0} or regexp_matches(compiler, '^(/usr/bin/|/opt/rh/)') or not ends_with(compiler, '/bin/g++') then '' else compiler[:length(compiler) - 8] end)"
_SIZE = "regexp_extract({0}, '^([0-9]+)[GMKB]?$', 1)"
_bytes = lambda x: f"try_cast(regexp_extract({x}, '^([0-9]{{1,18}})[GMKB]?$', 1) as bigint) * case right({x}, 1) when 'G' then 1073741824 when 'M' then 1048576 when 'K' then 1024 else 1 end"
SQL = {
    "f1_split_parts": "select page_id, array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), '|') as v from pages",
    "f2_split_tokens": _p("len(string_split(dirs || ',', ','))::int as v"),
    "f3_join": _v("select id, array_to_string(argv, ' ') as v from command_lines", "command_lines"),
    "f4_affixes": "select page_id, starts_with(url, 'https:') and ends_with(url, 'top') as v from pages",
    "f5_paths": "select page_id, regexp_extract(url, '([^/]*)$', 1) as base, regexp_replace(url, '/[^/]*$', '') as directory from pages",
    "f7_shell_escape": f"select conv_id, turn, {_ESC.format('text')} as v from conversations",
    "f8_parse": _c("n_options::bigint as n_options, array_to_string(coalesce(files, []), '|') as files"),
    "f9_lookup": _c("inc as v"),
    "f10_rewrite": _v(f"with {_PARSE}, {_KEEP} select id, array_to_string(list_concat(words, ['-fpreprocessed', '-x', 'c++', '-']), ' ') as v from kept", "command_lines"),
    "f12_output_path": _c("coalesce(o, regexp_replace(regexp_extract(files[1], '([^/]*)$', 1), '\\.[^.]*$', '') || '.o') as v"),
    "f13_command_line": _v(f"select id, 'g++ ' || array_to_string(list_transform(argv, lambda x: {_ESC.format('x')}), ' ') as v from command_lines", "command_lines"),
    "f14_parse_size": _p(_bytes("size_text") + " as v"),
    "f15_cache_dirs": f"with {_PARTS} select id, {_bytes('string_split(x, chr(44))[1]')} as size, string_split(x, ',')[2] as path from (select id, unnest(string_split(dirs, ':')) as x from parts)",
    "f16_directory_weight": _p("greatest(bytes >> 27, 1)::bigint as v"),
    "f17_iso_time": _v("select event_id, case when event_id % 5 <> 0 then date_trunc('second', ts) end::timestamp as v from heartbeats", "heartbeats"),
    "f18_time_format": _v("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as v from heartbeats", "heartbeats"),
    "f19_bool": _p("flag = '1' or lower(flag) in ('y', 'yes', 'true') as v"),
    "f20_task_digest": "select doc_id as id, sha256('cxx2' || chr(31) || lang || chr(31) || '-x' || lang || chr(31) || text) as v from documents",
    "f21_cache_key": "select doc_id as id, 'cxx2-entry-' || sha256('using-extra-info' || chr(31) || lang || chr(31) || '-x' || lang || chr(31) || text) as v from documents",
    "f23_subdirectories": _v("select seq, h % 16 as d0, h // 16 % 16 as d1 from (select seq, ('0x' || substr(md5(key), 1, 8))::bigint as h from cache_entries)", "cache_entries"),
    "f25_percent_encoding": "select conv_id, turn, replace(replace(url_encode(text), '*', '*'), '~', '%7E') as v, true as same from conversations",
    "f27_encode_chunks": "select conv_id, sha256(string_agg(strlen(text)::varchar, ',' order by turn, text) || chr(13) || chr(10) || string_agg(text, '' order by turn, text)) as v from conversations group by 1",
    "f28_decode_chunks": "select conv_id, row_number() over (partition by conv_id order by turn, text) - 1 as i, sha256(text) as v from conversations",
    "f30_checksum": "select doc_id, case when doc_id % 5 > 1 then sha256(coalesce(text, '')) end as v from documents",
    "f32_json": _v("""select registry_ord, '{"max_tasks":"' || max_tasks || '","priority":' || priority || ',"location":' || case when registry_ord % 2 = 0 then '"' || observed_location || '"' else 'null' end || '}' as v from servants""", "servants"),
    "f33_apply_patch": """select id, hex(encode('head/w/' || id || p_name) || repeat('\\x00'::blob, 40 - 3 - length(id::varchar)) || '\\x00'::blob || encode('tail')) as v from (select p_partkey as id, p_name from part)""",
    "f34_expected_path": _p("case when id % 2 = 0 then '/work/' else '/abs/' end || 'out/' || id as v"),
    "f35_linemarkers": _p(f"""'# 12 "' || case when {_root.format('false')} <> '' then '/opt/compiler-root' || compiler[length({_root.format('false')}) + 1:] else compiler end || '/include/a.h" 1' as v"""),
    "f36_padded_workspace": _p("md5(rpad('/dev/shm/' || id || '/', 4066, 'A')) as v"),
    "f37_result_name": _p("case when suffix = '.o' then destination else 'out/' || id || suffix end as v"),
    "f38_fetch_interval": _v("select registry_ord, 600 + ('0x' || substr(md5(observed_location), 1, 8))::bigint % 120 as v from servants", "servants"),
    "f39_executor_limit": """select p_partkey, (case when p_size % 9 = 0 then p_size when ends_with(p_brand, '1') then p_size * 190 // 100 when p_partkey % 6 = 0 or p_size <= 8 then 0 else p_size * 80 // 100 end)::bigint as v from part""",
    "f40_local_limit": """with h as (select p_partkey, (case when p_size % 9 = 0 and p_size > 0 then p_size when p_partkey % 40 > 0 and p_partkey % 40 < p_size then greatest(p_partkey % 40 // 2, 1) else greatest(p_size // 2, 1) end)::bigint as heavy from part)
  select p_partkey, heavy, heavy + heavy // 2 as light from h""",
    "f41_temp_dir": """select p_partkey, case when ends_with(p_brand, '2') then '' when trunc(p_retailprice * 8000000) < 10737418240 then '/tmp' else '/dev/shm' end as v from part""",
    "f43_content_hash": "select doc_id, sha256(text) as v from documents",
    "s11_cgroup": "select p_partkey, p_partkey % 10 = 0 or (p_size % 2 = 1 and p_size % 3 > 0) as v from part",
    "s21_keyed_buffers": "select distinct conv_id, role || turn as name, strlen(text)::int as bytes from conversations",
    "p8_distributable": _c("c and coalesce(x in ('c', 'c++'), true) and not dash and len(coalesce(files, [])) = 1 and not regexp_matches(files[1], '\\.[sS]$') as v"),
    "p9_lightweight": _c("light as v"),
    "p10_small_input": "select doc_id from documents where strlen(text) < 8192",
    "p11_cacheable": _v("select id, id % 4 > 1 or (len(list_filter(argv, lambda a: starts_with(a, '-D__TIME__='))) > 0 and len(list_filter(argv, lambda a: starts_with(a, '-D__DATE__='))) > 0 and len(list_filter(argv, lambda a: starts_with(a, '-D__TIMESTAMP__='))) > 0) as v from command_lines", "command_lines"),
    "p12_submit_validation": """select o_orderkey, ['bad pid', 'no source path', 'no arguments', 'bad cache control', 'no digest'][list_position([o_custkey % 13 = 0 or o_custkey = 0, o_orderkey % 11 = 0, o_orderkey % 17 = 0, o_orderkey % 4 = 3,
    o_orderkey % 4 > 0 and o_orderkey % 5 = 0], true)] as v from orders""",
    "p13_no_wrappers": "select p_partkey, '/usr/bin/' || ['g++', '', '', '', 'ccache-g++', 'clang'][1 + p_size % 6] as path from part where p_size % 6 in (0, 4, 5)",
    "p14_executable": "select p_partkey, (p_partkey // 64 % 2 = 1 and p_size % 3 = 1) or (p_partkey // 8 % 2 = 1 and p_size % 5 in (2, 4)) or p_partkey % 2 = 1 as v from part",
    "p15_language": _c("coalesce(x, case when regexp_matches(files[1], '\\.(cc|cpp|cxx)$') then 'c++' when ends_with(files[1], '.c') then 'c' end) as v"),
    "p16_compiler_root": _p(_root.format("id % 10 = 0") + " as v"),
    "p19_filter_request": _p("id % 50 <= p_size as v"),
    "p20_alive": _p("(['R', 'S', 'Z', 'x', 'D', 'X'])[1 + id % 6] not in ('Z', 'x', 'X') as v"),
    "a13_all_any": _v("select id, not list_contains(argv, '') as every, list_contains(argv, '-E') as some from command_lines", "command_lines"),
    "a16_digest_dump": _v("select key, '{\"seq\":' || max(seq) || ',\"size\":' || arg_max(size, seq) || '}' as v from cache_entries group by 1", "cache_entries"),
    "j6_compilers_changed": _v("select registry_ord, case when registry_ord % 3 = 0 then 'found' else 'gone' end as change from servants where (registry_ord % 3 = 0) <> (registry_ord % 4 = 0)", "servants"),
    "j10_patches": _v("""select task_id, '.' || task_id % 4 as suffix, case when task_id % 2 = 0 and task_id % 8 = task_id % 4 then task_id % 100 else 0 end as position, null::varchar as error
  from tasks where task_id % 3 = 0 union all select task_id, '.' || task_id % 8, task_id % 100, 'patch without a file' from tasks
  where task_id % 2 = 0 and not (task_id % 3 = 0 and task_id % 8 = task_id % 4)""", "tasks"),
    "j14_process_task": _v("select requestor as pid, task_id from tasks where requestor in (select k from heartbeats)", "tasks", "heartbeats"),
    "j15_positional": _v("select task_id, task_id % 3 = 0 as ok from tasks", "tasks"),
    "o3_sorted_names": _v("select registry_ord, array_to_string(list_sort(environments), ',') as v from servants", "servants"),
    "o5_first_match": _v("select id, list_filter(argv, lambda a: starts_with(a, '-D'))[1] as v from command_lines", "command_lines"),
}
