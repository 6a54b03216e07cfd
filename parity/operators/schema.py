"""Columns of two tables: sets, order, types, nullability. Works on schemas alone; nothing is read."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parity.functions.cells import compatible


@dataclass
class ColumnSets:
    """common: (source name, target name), in the order of their names; missing and extra as they are compared."""

    common: list[tuple[str, str]]
    missing: list[str]
    extra: list[str]


def fold(name: str, case_sensitive: bool) -> str:
    return name if case_sensitive else name.lower()


def column_sets(source: Iterable[str], target: Iterable[str], ignore: Iterable[str] = (), case_sensitive: bool = False) -> ColumnSets:
    """Ignoring never looks at case. Where case doesn't matter and a side spells a name twice, the first counts."""
    dropped = {x.lower() for x in ignore}

    def by_key(names: Iterable[str]) -> dict[str, str]:
        found: dict[str, str] = {}
        for n in names:
            if n.lower() not in dropped:
                found.setdefault(fold(n, case_sensitive), n)
        return found

    s, t = by_key(source), by_key(target)
    return ColumnSets([(s[k], t[k]) for k in sorted(s.keys() & t.keys())], sorted(s.keys() - t.keys()), sorted(t.keys() - s.keys()))


def order_of_common(source: Iterable[str], target: Iterable[str], sets: ColumnSets) -> tuple[list[str], list[str]]:
    """The common columns of each side in that side's order, in lower case."""
    s, t = {a for a, _ in sets.common}, {b for _, b in sets.common}
    return [x.lower() for x in source if x in s], [x.lower() for x in target if x in t]


def describe(df: DataFrame) -> list[tuple[str, str, bool, int]]:
    return [(f.name, f.dataType.simpleString(), f.nullable, k) for k, f in enumerate(df.schema)]


def schema_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """column_name, data_type, is_nullable, ordinal_position"""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, k) for k, f in enumerate(schema)]
    return spark.createDataFrame(rows, "column_name string, data_type string, is_nullable boolean, ordinal_position int")


def type_differences(source: DataFrame, target: DataFrame, sets: ColumnSets) -> list[dict]:
    """Common columns whose types aren't compatible."""
    out = []
    for a, b in sets.common:
        x, y = source.schema[a].dataType, target.schema[b].dataType
        if not compatible(x, y):
            out.append({"column": a, "source_type": x.simpleString(), "target_type": y.simpleString()})
    return out
