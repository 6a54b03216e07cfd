"""Expressions on single cells and rows: text forms, fingerprints, tolerant comparison, types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the row-hash format.
SEPARATOR = "||"
NULL_TEXT = "\x01NULL\x01"

#: Cells that differ by no more than this are equal where either is a float or a double.
TOLERANCE = 1e-9

_NESTED = (T.ArrayType, T.MapType, T.StructType)
_NUMERIC = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """A column by its plain name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(has_map(f.dataType) for f in kind)


def comparable(value: Column, kind: T.DataType) -> Column:
    """A form that can be grouped, hashed and ordered: maps become sorted entries, at any depth."""
    if not has_map(kind):
        return value
    if isinstance(kind, T.MapType):
        entry = lambda x: F.struct(x["key"].alias("key"), comparable(x["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(value), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*[comparable(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))


def as_text(value: Column, kind: T.DataType) -> Column:
    return F.to_json(comparable(value, kind)) if isinstance(kind, _NESTED) else value.cast("string")


def row_hash(df: DataFrame, columns: Sequence[str], strict: bool = False) -> Column:
    """sha2 over the columns in the order of their names.

    The plain format joins texts by SEPARATOR, with NULL_TEXT for nulls, so that other systems can make the same hash. The
    strict one puts each text's length before it, so that no two different rows share a text.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    texts = [as_text(col(c), kinds[c]) for c in sorted(columns)]
    if strict:
        parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts]
        return F.sha2(F.concat(F.lit(""), *parts), 256)
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(t, F.lit(NULL_TEXT)) for t in texts]), 256)


def trimmed(value: Column) -> Column:
    """Without any Unicode white space at both ends (``trim`` takes off spaces only)."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def key_text(keys: Sequence[str], joiner: str = "|") -> Column:
    return F.concat_ws(joiner, *[F.coalesce(col(k).cast("string"), F.lit("NULL")) for k in keys])


def key_pairs(keys: Sequence[str]) -> Column:
    """k=v, k=v"""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(col(k).cast("string"), F.lit("NULL"))) for k in keys])


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share)


def is_ordered(kind: T.DataType) -> bool:
    """Whether least and greatest values are compared. Intervals, texts, booleans, binaries and nested values have none here."""
    return isinstance(kind, _ORDERED)


def compatible(a: T.DataType, b: T.DataType) -> bool:
    """Equal, or both of the common numeric types, or both texts: a file's inferred types can't be held to more."""
    return a == b or (isinstance(a, _NUMERIC) and isinstance(b, _NUMERIC)) or (isinstance(a, T.StringType) and isinstance(b, T.StringType))


def differs(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType, tolerance: float = TOLERANCE) -> Column:
    """Whether two cells differ, never null.

    One null differs from any value. Floats and doubles may be apart by ``tolerance``; integers and decimals must be equal (within a
    ``tolerance`` above the default, they too may be apart); a date against a timestamp compares days; two timestamps compare
    exactly; other pairs of types compare as texts.
    """
    floating = (T.FloatType, T.DoubleType)
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, *floating)
    stamps = (T.TimestampType, T.TimestampNTZType)
    if isinstance(kind_a, numeric) and isinstance(kind_b, numeric):
        if isinstance(kind_a, floating) or isinstance(kind_b, floating) or tolerance > TOLERANCE:
            x, y = a.cast("double"), b.cast("double")
            both = F.when(F.isnan(x) | F.isnan(y), ~x.eqNullSafe(y)).otherwise(F.when(x == y, F.lit(False)).otherwise(F.abs(x - y) > tolerance))
        else:
            both = a != b
    elif isinstance(kind_a, T.DateType) and isinstance(kind_b, stamps) or isinstance(kind_a, stamps) and isinstance(kind_b, T.DateType):
        both = F.to_date(a) != F.to_date(b)
    elif kind_a == kind_b and not has_map(kind_a):
        both = a != b
    else:
        both = as_text(a, kind_a) != as_text(b, kind_b)
    return F.when(a.isNull() & b.isNull(), F.lit(False)).when(a.isNull() | b.isNull(), F.lit(True)).otherwise(both)
