"""What is done to both sides before they are compared. Nulls stay null, and only texts are touched."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.functions.cells import col, trimmed


def drop_ignored(df: DataFrame, ignore: Iterable[str]) -> DataFrame:
    dropped = {x.lower() for x in ignore}
    return df.select(*[col(c) for c in df.columns if c.lower() not in dropped])


def clean_texts(df: DataFrame, trim: bool = True, lower: bool = False) -> DataFrame:
    def cleaned(f: T.StructField):
        value = col(f.name)
        if isinstance(f.dataType, T.StringType):
            value = trimmed(value) if trim else value
            value = F.lower(value) if lower else value
        return value.alias(f.name)

    return df.select(*[cleaned(f) for f in df.schema])
