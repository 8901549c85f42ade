"""Broadcast only what is proven small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Size a dimension may have before it stops being broadcast: a row limit and a
# byte limit on the estimated size. Dictionaries in this library (alphabet,
# allele vocabulary, per-sample codes) have tens to thousands of rows; beyond
# the bound the join falls back to a shuffle join, where AQE's skew handling
# splits a hot key.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
DEFAULT_MAX_BROADCAST_BYTES = 256 << 20
CONF_KEY = "epiframe.broadcast.maxRows"
CONF_BYTES = "epiframe.broadcast.maxBytes"

# Assumed widths of variable-size values when estimating a row's size.
_STRING_BYTES, _ARRAY_ELEMENTS = 32, 32


def approx_type_bytes(dt: T.DataType) -> int:
    if isinstance(dt, (T.ByteType, T.BooleanType)):
        return 1
    if isinstance(dt, T.ShortType):
        return 2
    if isinstance(dt, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return _STRING_BYTES
    if isinstance(dt, T.ArrayType):
        return 16 + _ARRAY_ELEMENTS * approx_type_bytes(dt.elementType)
    if isinstance(dt, T.MapType):
        return 16 + _ARRAY_ELEMENTS * (approx_type_bytes(dt.keyType) + approx_type_bytes(dt.valueType))
    if isinstance(dt, T.StructType):
        return sum(approx_type_bytes(f.dataType) for f in dt.fields)
    return 8


def approx_row_bytes(df: DataFrame) -> int:
    return 16 + sum(approx_type_bytes(f.dataType) for f in df.schema.fields)


def max_broadcast_rows(df: DataFrame) -> int:
    """Row bound for broadcasting ``df``: the row limit, lowered so that the
    estimated size stays under the byte limit."""
    conf = df.sparkSession.conf
    rows = int(conf.get(CONF_KEY, None) or DEFAULT_MAX_BROADCAST_ROWS)
    limit = int(conf.get(CONF_BYTES, None) or DEFAULT_MAX_BROADCAST_BYTES)
    return max(1, min(rows, limit // approx_row_bytes(df)))


def _value_bytes(c: Column, dt: T.DataType) -> Column:
    """Bytes of one value, measured where its size varies."""
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0))
    if isinstance(dt, (T.ArrayType, T.MapType)):
        per = approx_type_bytes(dt) // _ARRAY_ELEMENTS + 1
        return F.coalesce(F.size(c), F.lit(0)).cast("long") * per + 16
    if isinstance(dt, T.StructType):
        return sum((_value_bytes(c[f.name], f.dataType) for f in dt.fields), F.lit(16).cast("long"))
    return F.lit(approx_type_bytes(dt)).cast("long")


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a dimension, in one job over it; bytes from the data."""
    size = sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def sized_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Return ``broadcast(df)`` when its rows and its measured bytes are within the
    bounds, else ``df``.

    One small job over the dimension measures it; nothing is cached, and the large
    side is not touched. Above a bound the planner (with AQE) chooses the join.
    """
    conf = df.sparkSession.conf
    rows = max_rows if max_rows is not None else int(conf.get(CONF_KEY, None) or DEFAULT_MAX_BROADCAST_ROWS)
    limit = int(conf.get(CONF_BYTES, None) or DEFAULT_MAX_BROADCAST_BYTES)
    n, size = measure(df)
    return F.broadcast(df) if n <= rows and size <= limit else df
