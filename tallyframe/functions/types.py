"""Spark types and the kinds of values that profiles tell apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("integral", "fractional", "boolean", "string", "object", "tensor")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integral"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "fractional"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, T.ArrayType) and (isinstance(dtype.elementType, T.ArrayType) and kind_of(dtype.elementType) == "tensor" or kind_of(dtype.elementType) in ("integral", "fractional")):
        return "tensor"
    return "object"


def declared_kind(dtype: T.DataType) -> str:
    """The kind that chooses a column's metrics: booleans count as integral, tensors and objects as any."""
    return {"boolean": "integral", "tensor": "any", "object": "any"}.get(kind := kind_of(dtype), kind)


def is_nan(c: Column, dtype: T.DataType) -> Column:
    return F.isnan(c) if isinstance(dtype, (T.FloatType, T.DoubleType)) else F.lit(False)


def as_number(c: Column, dtype: T.DataType, parse: bool = False) -> Column | None:
    """The value as a double without NaN; booleans are 1 and 0; None for what has no number. parse: read numbers in strings."""
    if parse and kind_of(dtype) == "string":
        return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    if kind_of(dtype) not in ("integral", "fractional", "boolean"):
        return None
    x = c.cast("double")
    return F.when(~is_nan(c, dtype), x) if isinstance(dtype, (T.FloatType, T.DoubleType)) else x


def as_item(c: Column, dtype: T.DataType, limit: int = 128) -> Column | None:
    """The value as an item of frequent-item counts."""
    kind = kind_of(dtype)
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False")
    if kind in ("integral", "fractional"):
        return F.when(~is_nan(c, dtype), c.cast("string"))
    return F.substring(c, 1, limit) if kind == "string" else None
