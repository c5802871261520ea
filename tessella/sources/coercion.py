"""Reading data whose stored types differ from the table's: which pairs are allowed, and the conversion.

A partition written with an older schema is read under the table's schema.
Only conversions that keep a value's meaning are allowed; a value that does
not fit its new type becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEXT = (T.StringType, T.VarcharType)


class CoercionError(TypeError):
    """A pair of types that no rule covers; the message has the column's path."""


def allowed(source: T.DataType, target: T.DataType) -> bool:
    """Whether a stored value of `source` may be read as `target`."""
    if source == target:
        return True
    if isinstance(source, _TEXT):
        return isinstance(target, (*_TEXT, *_INTEGERS))
    if isinstance(source, _INTEGERS):
        wider = isinstance(target, _INTEGERS) and _INTEGERS.index(type(target)) >= _INTEGERS.index(type(source))
        return wider or isinstance(target, (*_TEXT, T.DecimalType, T.FloatType, T.DoubleType))
    if isinstance(source, (T.FloatType, T.DoubleType)):
        return isinstance(target, (T.FloatType, T.DoubleType, T.DecimalType))
    if isinstance(source, T.DecimalType):
        return isinstance(target, (T.DecimalType, T.FloatType, T.DoubleType))
    if isinstance(source, T.ArrayType) and isinstance(target, T.ArrayType):
        return allowed(source.elementType, target.elementType)
    if isinstance(source, T.MapType) and isinstance(target, T.MapType):
        return allowed(source.keyType, target.keyType) and allowed(source.valueType, target.valueType)
    if isinstance(source, T.StructType) and isinstance(target, T.StructType):
        return all(a.name.lower() == b.name.lower() and allowed(a.dataType, b.dataType) for a, b in zip(source.fields, target.fields))
    return False


def convert(c: Column, source: T.DataType, target: T.DataType, path: str = "value") -> Column:
    """c, of type `source`, as `target`.  Raises CoercionError where the pair is not allowed."""
    if source == target:
        return c
    if not allowed(source, target):
        raise CoercionError(f"{path}: {source.simpleString()} cannot be read as {target.simpleString()}")
    if isinstance(target, T.VarcharType):
        return F.substring(c.cast("string"), 1, target.length)
    if isinstance(target, T.StringType):
        return c.cast("string")
    if isinstance(target, T.ArrayType):
        return F.transform(c, lambda x: convert(x, source.elementType, target.elementType, f"{path}[]"))
    if isinstance(target, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.struct(convert(e["key"], source.keyType, target.keyType, f"{path}.key").alias("key"), convert(e["value"], source.valueType, target.valueType, f"{path}.value").alias("value")),
        )
        return F.map_from_entries(entries)
    if isinstance(target, T.StructType):
        have = dict(enumerate(source.fields))
        parts = [
            (convert(c[have[k].name], have[k].dataType, f.dataType, f"{path}.{f.name}") if k in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for k, f in enumerate(target.fields)
        ]
        return F.when(c.isNotNull(), F.struct(*parts))
    return c.try_cast(target)


def coerce_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df under the table's schema: its columns by name, each converted, absent ones null, others left out."""
    have = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for f in schema.fields:
        got = have.get(f.name.lower())
        out.append((convert(F.col(f"`{got.name}`"), got.dataType, f.dataType, f.name) if got else F.lit(None).cast(f.dataType)).alias(f.name))
    return df.select(*out)
