"""Exact statistics of columns, as one long table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parity.functions.cells import col, comparable, is_ordered


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_count): one pass."""
    names = list(columns or df.columns)
    one = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{k}") for k, c in enumerate(names)])
    return _long(one, [(c, {"null_count": F.col(f"n{k}")}) for k, c in enumerate(names)])


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, distinct_count), exact, nulls not counted.

    A query of its own for each column: each reads only that column and combines before it shuffles, where
    one statement for all columns would first multiply the rows by the number of columns.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    each = [
        df.select(comparable(col(c), kinds[c]).alias("v")).agg(F.count_distinct("v").alias("distinct_count")).select(F.lit(c).alias("column"), "distinct_count")
        for c in (columns or df.columns)
    ]
    return reduce(DataFrame.unionByName, each)


def min_max(df: DataFrame, columns: Sequence[str] | None = None, as_text: bool = True) -> DataFrame:
    """(column, min_value, max_value) of the columns that have an order; null for the others."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = list(columns or df.columns)
    ordered = [(k, c) for k, c in enumerate(names) if is_ordered(kinds[c])]
    one = df.agg(F.lit(0).alias("_"), *[x for k, c in ordered for x in (F.min(col(c)).alias(f"a{k}"), F.max(col(c)).alias(f"b{k}"))])
    of = {c: k for k, c in ordered}
    pick = lambda side, c: F.col(f"{side}{of[c]}").cast("string") if c in of else F.lit(None).cast("string")
    return _long(one, [(c, {"min_value": pick("a", c), "max_value": pick("b", c)}) for c in names])


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_count, distinct_count, min_value, max_value): one pass for nulls and extremes, one narrow pass a column for distincts."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = list(columns or df.columns)
    aggs: list[Column] = []
    for k, c in enumerate(names):
        aggs.append(F.count_if(col(c).isNull()).alias(f"n{k}"))
        if is_ordered(kinds[c]):
            aggs += [F.min(col(c)).alias(f"a{k}"), F.max(col(c)).alias(f"b{k}")]
    one = df.agg(*aggs)
    none = F.lit(None).cast("string")
    cells = [
        (c, {"null_count": F.col(f"n{k}"), "min_value": F.col(f"a{k}").cast("string") if is_ordered(kinds[c]) else none, "max_value": F.col(f"b{k}").cast("string") if is_ordered(kinds[c]) else none})
        for k, c in enumerate(names)
    ]
    return _long(one, cells).join(distinct_counts(df, names), "column").select("column", "null_count", "distinct_count", "min_value", "max_value")


def _long(one: DataFrame, cells: list[tuple[str, dict[str, Column]]]) -> DataFrame:
    """A one-row table as a row for each column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in values.items()]) for c, values in cells])
    return one.select(F.explode(rows).alias("x")).select("x.*")
