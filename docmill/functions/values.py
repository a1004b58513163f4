"""Literals, value classes, truthiness and ordering."""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T

from docmill.errors import DocumentError, bad_value

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

#: Type aliases and their codes.
TYPE_CODES = {
    "double": 1,
    "string": 2,
    "object": 3,
    "array": 4,
    "binData": 5,
    "objectId": 7,
    "bool": 8,
    "date": 9,
    "null": 10,
    "regex": 11,
    "int": 16,
    "timestamp": 17,
    "long": 18,
    "decimal": 19,
    "minKey": -1,
    "maxKey": 127,
}
#: Classes in the order in which values of different types sort.
CLASS_ORDER = ("null", "number", "string", "object", "array", "binary", "bool", "date", "regex")


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def value_class(kind: T.DataType) -> str:
    """The comparison class of a column's type."""
    if is_number(kind):
        return "number"
    for cls, name in (
        (T.StringType, "string"),
        (T.StructType, "object"),
        (T.MapType, "object"),
        (T.ArrayType, "array"),
        (T.BinaryType, "binary"),
        (T.BooleanType, "bool"),
        (T.TimestampType, "date"),
        (T.TimestampNTZType, "date"),
        (T.DateType, "date"),
        (T.NullType, "null"),
    ):
        if isinstance(kind, cls):
            return name
    return "any"


def alias_of(kind: T.DataType) -> str:
    """The type alias that values of a column's type have."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(kind, T.LongType):
        return "long"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if is_number(kind):
        return "int"
    return {"binary": "binData"}.get(value_class(kind), value_class(kind))


def literal_class(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float, decimal.Decimal)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (bytes, bytearray)):
        return "binary"
    if isinstance(value, (dt.datetime, dt.date)):
        return "date"
    if isinstance(value, re.Pattern):
        return "regex"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, (list, tuple)):
        return "array"
    raise bad_value(f"cannot use a value of type {type(value).__name__}")


def literal(value: object) -> Column:
    """A Python value as a Column: dicts are structs, lists arrays."""
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()]) if value else F.struct()
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    if isinstance(value, int) and not isinstance(value, bool):
        if not -(2**63) <= value < 2**63:
            return F.lit(decimal.Decimal(value))
        return F.lit(value).cast("int" if -(2**31) <= value < 2**31 else "long")
    literal_class(value)
    return F.lit(value)


def truthy(column: Column, kind: T.DataType) -> Column:
    """False, zero, null and missing are false; everything else is true."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    if is_number(kind):
        return F.coalesce(column != 0, F.lit(False))
    return column.isNotNull()


def equal(column: Column, kind: T.DataType, value: object) -> Column | None:
    """column = literal, compared in the column's own type; None if no value of the type can be equal."""
    cls, own = literal_class(value), value_class(kind)
    if own == "any":
        return variant_compare(column, "eq", value)
    if cls != own:
        return None
    if cls == "number" and isinstance(kind, WHOLE) and isinstance(value, float):
        return column == F.lit(int(value)) if value.is_integer() else None
    if cls == "object":
        if not isinstance(kind, T.StructType) or [f.name for f in kind.fields] != list(value):
            return None
        parts = []
        for f in kind.fields:
            part = column.getField(f.name).isNull() if value[f.name] is None else equal(column.getField(f.name), f.dataType, value[f.name])
            if part is None:
                return None
            parts.append(part)
        return all_of(parts) & column.isNotNull()
    if cls == "array":
        parts = [F.size(column) == len(value)]
        for i, v in enumerate(value):
            part = F.get(column, F.lit(i)).isNull() if v is None else equal(F.get(column, F.lit(i)), kind.elementType, v)
            if part is None:
                return None
            parts.append(part)
        return all_of(parts)
    return column == literal(value)


def variant_compare(column: Column, op: str, value: object) -> Column:
    """A dynamic value against a literal of one class: values of other classes don't match."""
    cls = literal_class(value)
    cast = {"number": "double", "string": "string", "bool": "boolean", "date": "timestamp"}.get(cls)
    if cast is None:
        raise DocumentError(238, f"comparing a dynamic value with {cls}")
    alias = F.schema_of_variant(column)
    fits = {"number": alias.rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT)$"), "string": alias == "STRING", "bool": alias == "BOOLEAN", "date": alias.rlike("^(TIMESTAMP|DATE).*")}[cls]
    typed = F.when(fits, F.try_variant_get(column, "$", cast))
    return compare(typed, op, F.lit(value).cast(cast))


def compare(a: Column, op: str, b: Column) -> Column:
    return {"eq": lambda: a == b, "gt": lambda: a > b, "gte": lambda: a >= b, "lt": lambda: a < b, "lte": lambda: a <= b}[op]()


def all_of(parts: Iterable[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return F.lit(True) if out is None else out


def any_of(parts: Iterable[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out | p
    return F.lit(False) if out is None else out


def descending_last(column: Column, direction: int) -> Column:
    """Sort order of one key: nulls are lowest."""
    return column.asc_nulls_first() if direction > 0 else column.desc_nulls_last()


def sort_value(column: Column, kind: T.DataType, direction: int) -> Column:
    """What a document sorts by: an array by its least element going up, its greatest going down."""
    if isinstance(kind, T.ArrayType):
        return F.array_min(column) if direction > 0 else F.array_max(column)
    if isinstance(kind, T.VariantType):
        number = F.try_variant_get(column, "$", "double")
        text = F.try_variant_get(column, "$", "string")
        return F.struct(F.when(column.isNull(), 0).when(number.isNotNull(), 1).otherwise(2).alias("class"), number.alias("number"), text.alias("text"))
    return column


def sort_direction(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value not in (1, -1):
        raise DocumentError(15975, f"$sort key ordering must be 1 (for ascending) or -1 (for descending), not {value!r}")
    return int(value)
