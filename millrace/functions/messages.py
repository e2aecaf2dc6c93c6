"""Messages as JSON and back, for any schema: expressions made from a ``StructType``.

Fields that are not set are printed with their default, 64-bit integers as strings, enumerations as integers, bytes in
base64; a nested message that is not set is left out.  Enumerations are integer fields with the metadata ``enum``, a
dictionary of names to numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = {T.IntegerType: 0, T.ShortType: 0, T.ByteType: 0, T.DoubleType: 0.0, T.FloatType: 0.0}


def _shown(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_shown(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.coalesce(value, F.array().cast(kind)), lambda x: _shown(x, kind.elementType))
    if isinstance(kind, T.MapType):
        named = F.transform_values(F.coalesce(value, F.create_map().cast(kind)), lambda _, x: _shown(x, kind.valueType))
        return F.transform_keys(named, lambda k, _: k.cast("string"))
    if isinstance(kind, T.LongType):
        return F.coalesce(value, F.lit(0)).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.coalesce(F.base64(value), F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(value, F.lit(""))
    if type(kind) in _NUMBERS:
        return F.coalesce(value, F.lit(_NUMBERS[type(kind)]).cast(kind))
    raise TypeError(f"no message field of type {kind}")


def to_message(value: Column, schema: T.StructType) -> Column:
    """JSON of a struct column of that schema; null for null."""
    return F.when(value.isNotNull(), F.to_json(_shown(value, schema), {"ignoreNullFields": "true"}))


def _wire(kind: T.DataType) -> T.DataType:
    """What the text is read as: scalars as strings, as numbers may come with or without quotes."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _wire(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_wire(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), _wire(kind.valueType))
    return T.StringType()


def _read(text: Column, kind: T.DataType, names: dict[str, int] | None = None) -> tuple[Column, Column]:
    """The value of what was read, with defaults, and whether it is no value of that type."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, *_read(text[f.name], f.dataType, f.metadata.get("enum"))) for f in kind]
        value = F.when(text.isNotNull(), F.struct(*[v.alias(n) for n, v, _ in parts]))
        return value, text.isNotNull() & reduce(lambda a, b: a | b, [b for *_, b in parts], F.lit(False))
    if isinstance(kind, T.ArrayType):
        some = F.coalesce(text, F.array().cast(_wire(kind)))
        return F.transform(some, lambda x: _read(x, kind.elementType)[0]), F.exists(some, lambda x: x.isNull() | _read(x, kind.elementType)[1])
    if isinstance(kind, T.MapType):
        some = F.coalesce(text, F.create_map().cast(_wire(kind)))
        keys = F.transform_keys(some, lambda k, _: k.try_cast(kind.keyType))
        bad = F.exists(F.map_entries(some), lambda e: e["value"].isNull() | e["key"].try_cast(kind.keyType).isNull() | _read(e["value"], kind.valueType)[1])
        return F.transform_values(keys, lambda _, x: _read(x, kind.valueType)[0]), bad
    if isinstance(kind, T.BinaryType):
        value = F.try_to_binary(text, F.lit("base64"))
        return F.coalesce(value, F.lit(b"")), text.isNotNull() & value.isNull()
    if isinstance(kind, T.StringType):
        return F.coalesce(text, F.lit("")), F.lit(False)
    value = text.try_cast(kind)
    if names:
        value = F.coalesce(value, F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), text).cast(kind))
    default = F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(0).cast(kind)
    return F.coalesce(value, default), text.isNotNull() & value.isNull()


def from_message(text: Column, schema: T.StructType) -> Column:
    """Struct of that schema; null if the text is no such message. Unknown fields are passed over, missing ones have defaults.

    Numbers may come with quotes, enumerations by name or number; a nested message that is missing is null."""
    wire = F.from_json(F.when(F.trim(text).startswith("{"), text), _wire(schema))
    value, bad = _read(wire, schema)
    whole = F.try_parse_json(text).isNotNull()
    return F.when(whole & ~bad, value)
