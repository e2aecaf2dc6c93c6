"""Codecs and searches that built-in functions cannot express, as Arrow UDFs over batches of rows."""

from __future__ import annotations

import hashlib
import json
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import PATH_MAX

_ENTRY = T.StructType([T.StructField("exit_code", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("stdout", "stderr", "files"))])
_LOCATIONS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("position", "total_size", "suffix_to_keep")]))
_HEADER = struct.Struct("<III")


def encode_entry(exit_code: int, stdout: bytes, stderr: bytes, files: bytes) -> bytes:
    """Header of three little-endian sizes, metadata with a digest of the body, and the body."""
    body = stdout + stderr + files
    meta = json.dumps({"exit_code": exit_code, "stdout": len(stdout), "stderr": len(stderr), "sha256": hashlib.sha256(body).hexdigest()}).encode()
    return _HEADER.pack(1, len(meta), len(body)) + meta + body


def decode_entry(blob: bytes | None) -> dict | None:
    """The entry's fields; None if it is short, long or its digest differs."""
    if blob is None or len(blob) < _HEADER.size:
        return None
    version, n_meta, n_body = _HEADER.unpack_from(blob)
    if version != 1 or len(blob) != _HEADER.size + n_meta + n_body:
        return None
    try:
        meta = json.loads(blob[_HEADER.size : _HEADER.size + n_meta])
        body = blob[_HEADER.size + n_meta :]
        if hashlib.sha256(body).hexdigest() != meta["sha256"]:
            return None
        a, b = meta["stdout"], meta["stdout"] + meta["stderr"]
        return {"exit_code": meta["exit_code"], "stdout": body[:a], "stderr": body[a:b], "files": body[b:]}
    except (ValueError, KeyError, TypeError):
        return None


@F.pandas_udf(T.BinaryType())
def pack_entry(code: pd.Series, out: pd.Series, err: pd.Series, files: pd.Series) -> pd.Series:
    return pd.Series([encode_entry(int(c), bytes(o), bytes(e), bytes(f)) for c, o, e, f in zip(code, out, err, files)])


@F.pandas_udf(_ENTRY)
def unpack_entry(blob: pd.Series) -> pd.DataFrame:
    rows = [decode_entry(None if b is None else bytes(b)) or {"exit_code": None, "stdout": None, "stderr": None, "files": None} for b in blob]
    return pd.DataFrame(rows, columns=["exit_code", "stdout", "stderr", "files"]).astype({"exit_code": "Int32"})


def path_locations(data: bytes, prefix: bytes) -> list[dict]:
    """Non-overlapping places of ``prefix`` up to the next zero byte; an overlong or open one is passed over."""
    found, at = [], data.find(prefix)
    while at >= 0:
        end = data.find(b"\0", at)
        if end < 0:
            break
        if end - at <= PATH_MAX:
            found.append({"position": at, "total_size": end - at, "suffix_to_keep": end - at - len(prefix)})
        at = data.find(prefix, end)
    return found


def find_path_locations(prefix: str):
    """UDF for ``path_locations`` of a fixed prefix."""

    @F.pandas_udf(_LOCATIONS)
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else path_locations(bytes(x), prefix.encode()))

    return find


@F.pandas_udf(_LOCATIONS)
def locations_of(content: pd.Series, prefix: pd.Series) -> pd.Series:
    """``path_locations`` of a prefix that differs by row; none in a null content or for a null or empty prefix."""
    return pd.Series([[] if c is None or not p else path_locations(bytes(c), p.encode()) for c, p in zip(content, prefix)], dtype=object)
