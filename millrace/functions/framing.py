"""Framing and addressing: digests, keys, multi-chunk messages, patches and placement hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator between the parts of a digest, so that ("ab", "c") differs from ("a", "bc").
SEPARATOR = "\x1f"


def task_digest(compiler: Column, arguments: Column, source: Column) -> Column:
    """Identity of a compilation, SHA-256 over a domain tag and its parts."""
    return F.sha2(F.concat_ws(SEPARATOR, F.lit("cxx2"), compiler, arguments, source), 256)


def cache_key(compiler: Column, arguments: Column, source: Column) -> Column:
    """Key of the result in the cache."""
    return F.concat(F.lit("cxx2-entry-"), F.sha2(F.concat_ws(SEPARATOR, F.lit("using-extra-info"), compiler, arguments, source), 256))


def ring_hash(s: Column) -> Column:
    """32 bits of MD5 as a non-negative number."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def subdirectories(h: Column, fan_out: int = 16) -> Column:
    """Two directory levels from a hash, low digit first."""
    return F.struct((h % fan_out).alias("d0"), (F.floor(h / fan_out) % fan_out).cast("bigint").alias("d1"))


def object_key(directory: str, key: Column, prefixes: int = 128) -> Column:
    return F.concat(F.lit(directory + "/"), (ring_hash(key) % prefixes).cast("string"), F.lit("/"), key)


def encode_chunks(parts: Column) -> Column:
    """``len,len\\r\\n`` and the bytes of all parts; empty for no parts."""
    sizes = F.array_join(F.transform(parts, lambda p: F.octet_length(p).cast("string")), ",")
    return F.when(F.size(parts) == 0, F.lit("")).otherwise(F.concat(sizes, F.lit("\r\n"), F.array_join(parts, "")))


def decode_chunks(message: Column, allow_empty: bool = True) -> Column:
    """Parts of a multi-chunk message as array<binary>; null if the header or the total length is wrong."""
    header = F.substring_index(message.cast("string"), "\r\n", 1)
    sizes = F.transform(F.split(header, ","), lambda x: x.try_cast("bigint"))
    good = message.cast("string").contains("\r\n") & header.rlike("^[0-9]{1,10}(,[0-9]{1,10})*$")
    good = good & (F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))) + F.octet_length(header) + 2 == F.octet_length(message))
    if not allow_empty:
        good = good & F.forall(sizes, lambda x: x > 0)
    start = lambda i: (F.octet_length(header) + 3 + F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x)).cast("int")
    parts = F.transform(sizes, lambda x, i: F.substring(message.cast("binary"), start(i), x.cast("int")))
    return F.when(message == F.lit("").cast("binary"), F.array().cast("array<binary>")).when(good, parts)


def apply_patch(data: Column, locations: Column, path: Column) -> Column:
    """``data`` with ``path`` written at each (position, total_size, suffix_to_keep); null if it does not fit."""

    def one(d: Column, at: Column) -> Column:
        room, keep, new = at["total_size"], at["suffix_to_keep"], F.octet_length(path)
        tail = F.substring(d, at["position"] + room - keep + 1, keep)
        body = F.concat(path.cast("binary"), tail, F.unhex(F.repeat(F.lit("00"), room - keep - new)))
        end = F.substring(d, at["position"] + room + 1, F.octet_length(d))
        return F.concat(F.substring(d, F.lit(1), at["position"]), body, end)

    fits = F.forall(locations, lambda at: F.octet_length(path) <= at["total_size"] - at["suffix_to_keep"])
    return F.when(fits, F.aggregate(locations, data, one))


def add_checksum(body: Column) -> Column:
    """A body with its SHA-256, in hex, before it."""
    return F.concat(F.sha2(body, 256).cast("binary"), body)


def checked_body(data: Column) -> Column:
    """The body after its checksum; null if it is too short or does not match."""
    body = F.substring(data, F.lit(65), F.octet_length(data))
    return F.when((F.octet_length(data) >= 64) & (F.substring(data, F.lit(1), F.lit(64)) == F.sha2(body, 256).cast("binary")), body)
