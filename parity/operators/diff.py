"""Differences between two tables by key or by whole row.

Both sides are stacked and grouped by key, which is one shuffle with combining before it, instead of a join: nulls
in keys are equal to each other, repeated keys are counted rather than multiplied, and a hot key weighs as one row a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.functions.cells import TOLERANCE, col, comparable, differs, row_hash

MATCH, MISMATCH, MISSING_IN_TARGET, MISSING_IN_SOURCE = "MATCH", "MISMATCH", "MISSING_IN_TARGET", "MISSING_IN_SOURCE"


def require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} has no column {', '.join(absent)}")


def _keyed(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    kinds = {f.name: f.dataType for f in df.schema}
    return [comparable(col(k), kinds[k]).alias(k) for k in keys]


def _cols(names: Sequence[str]) -> list[Column]:
    return [col(n) for n in names]


def keys_only_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks; nulls are equal."""
    return a.select(*_keyed(a, keys)).subtract(b.select(*_keyed(b, keys)))


def _status(in_source: Column, in_target: Column, same: Column) -> Column:
    return F.when(~in_target, MISSING_IN_TARGET).when(~in_source, MISSING_IN_SOURCE).when(same, MATCH).otherwise(MISMATCH)


#: Parts of 21 bits of two 64-bit hashes: their sums over the rows of a key are exact for 2^42 rows.
_PARTS = [(seed, shift) for seed in (0, 1) for shift in (0, 21, 42)]


def _rows_sum(flag: int, digest: Column) -> list[Column]:
    """The parts of a row's hashes, negative on the target's side: over a key all sums are 0 if both sides have the same rows."""
    sign = 1 - 2 * flag
    return [(F.shiftrightunsigned(F.xxhash64(F.lit(seed), digest), shift).bitwiseAND(F.lit((1 << 21) - 1)) * sign).alias(f"__{seed}{shift}") for seed, shift in _PARTS]


_SUMS = [f"__{seed}{shift}" for seed, shift in _PARTS]


def _same_rows() -> Column:
    return reduce(lambda x, y: x & y, [F.col(c) == 0 for c in _SUMS], F.col("source_rows") == F.col("target_rows"))


def classify(source: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str], null_safe: bool = True) -> DataFrame:
    """(keys, source_rows, target_rows, status) for every key of either side.

    A key matches if both sides have the same rows of it, each as often. Rows are compared by sums of two 64-bit hashes of their strict
    row hash, source less target, which fit in fixed buffers, so that all of it is one hash aggregation. Without ``null_safe`` a key
    with a null is never a MISMATCH.
    """
    require(source, [*keys, *values], "the source")
    require(target, [*keys, *values], "the target")

    def side(df: DataFrame, flag: int) -> DataFrame:
        h = row_hash(df, values, strict=True) if values else F.lit("")
        return df.select(*_keyed(df, keys), h.alias("__h")).select(*_cols(keys), F.lit(1 - flag).alias("__s"), F.lit(flag).alias("__t"), *_rows_sum(flag, F.col("__h")))

    grouped = (
        side(source, 0).unionByName(side(target, 1)).groupBy(*_cols(keys))
        .agg(F.sum("__s").alias("source_rows"), F.sum("__t").alias("target_rows"), *[F.sum(c).alias(c) for c in _SUMS])
    )
    same = _same_rows()
    if not null_safe:
        same = same | reduce(lambda x, y: x | y, [col(k).isNull() for k in keys])
    return grouped.select(*_cols(keys), "source_rows", "target_rows", _status(F.col("source_rows") > 0, F.col("target_rows") > 0, same).alias("status"))


def classify_hashes(source: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str], strict: bool = False) -> DataFrame:
    """(keys, source_hash, target_hash, status) with the row hashes of both sides. Of a repeated key the greatest hash is shown; its status
    is by all its rows, as in ``classify``."""
    sides = []
    for flag, df in enumerate((source, target)):
        rows = df.select(*_keyed(df, keys), row_hash(df, values, strict).alias("__h"))
        shown = [(F.col("__h") if flag == g else F.lit(None).cast("string")).alias(n) for g, n in enumerate(("source_hash", "target_hash"))]
        sides.append(rows.select(*_cols(keys), *shown, F.lit(1 - flag).alias("__s"), F.lit(flag).alias("__t"), *_rows_sum(flag, F.col("__h"))))
    both = sides[0].unionByName(sides[1]).groupBy(*_cols(keys)).agg(
        F.max("source_hash").alias("source_hash"), F.max("target_hash").alias("target_hash"),
        F.sum("__s").alias("source_rows"), F.sum("__t").alias("target_rows"), *[F.sum(c).alias(c) for c in _SUMS],
    )
    return both.select(*_cols(keys), "source_hash", "target_hash", _status(F.col("source_rows") > 0, F.col("target_rows") > 0, _same_rows()).alias("status"))


def survey_frame(classified: DataFrame, keys: Sequence[str], samples: dict[str, tuple[Column, int]]) -> DataFrame:
    """Totals by status, and for each named condition the first keys (so many at most) for which it holds. Both parts read one exchange."""
    kinds = {f.name: f.dataType for f in classified.schema}
    twice = [F.col(f"{side}_rows") > 1 for side in ("source", "target")]
    held = [F.coalesce(F.sum(F.when(t, F.col(f"{side}_rows"))), F.lit(0)) for t, side in zip(twice, ("source", "target"))]
    numbers = [F.count(F.lit(1)), F.sum("source_rows"), F.sum("target_rows"), *map(F.count_if, twice), *held]
    names = ["n", "source_rows", "target_rows", "source_repeated", "target_repeated", "source_repeated_rows", "target_repeated_rows"]
    totals = classified.groupBy("status").agg(*[x.cast("long").alias(n) for x, n in zip(numbers, names)])
    totals = totals.select(F.lit(None).cast("string").alias("__of"), F.lit(0).alias("__at"), *[F.lit(None).cast(kinds[k]).alias(k) for k in keys], "status", *names)
    if samples:
        of = F.explode(F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, (condition, _) in samples.items()])))
        first = Window.partitionBy("__of").orderBy(*_cols(keys))
        most = max(n for _, n in samples.values())
        limit = reduce(lambda rest, x: F.when(F.col("__of") == x[0], x[1][1]).otherwise(rest), samples.items(), F.lit(0))
        rows = classified.select("*", of.alias("__of")).withColumn("__at", F.row_number().over(first)).where(F.col("__at") <= most).where(F.col("__at") <= limit)
        own = [F.lit(1).cast("long").alias("n"), "source_rows", "target_rows", *[F.lit(None).cast("long").alias(n) for n in names[3:]]]
        totals = totals.unionByName(rows.select("__of", "__at", *_cols(keys), "status", *own))
    return totals


def survey(classified: DataFrame, keys: Sequence[str], samples: dict[str, tuple[Column, int]]) -> tuple[dict[str, Row], dict[str, list[Row]]]:
    """``survey_frame`` in one job: totals by status, and the samples by name. What reaches the driver is four rows and the samples."""
    found: dict[str, list[Row]] = {name: [] for name in samples}
    by: dict[str, Row] = {}
    for r in sorted(survey_frame(classified, keys, samples).collect(), key=lambda r: r["__at"]):
        if r["__of"] is None:
            by[r["status"]] = r
        else:
            found[r["__of"]].append(r)
    return by, found


def key_frame(classified: DataFrame, keys: Sequence[str], rows: Sequence[Row]) -> DataFrame:
    """The keys of surveyed rows as a local table."""
    schema = T.StructType([T.StructField(k, classified.schema[k].dataType) for k in keys])
    return classified.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in rows], schema)


def status_counts(classified: DataFrame) -> DataFrame:
    """(status, n): four rows at most."""
    return classified.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def mismatch_summary(classified: DataFrame) -> DataFrame:
    """(total_keys, mismatch_count, mismatch_percentage) over the union of keys; 0 where there is none."""
    bad = F.count_if(F.col("status") != MATCH)
    n = F.count(F.lit(1))
    return classified.agg(n.alias("total_keys"), bad.alias("mismatch_count"), F.when(n > 0, 100.0 * bad / n).otherwise(0.0).alias("mismatch_percentage"))


def sample(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by key."""
    return df.orderBy(*_cols(keys)).limit(n)


def rows_for_keys(df: DataFrame, some: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``some``, nulls equal. Spark broadcasts ``some`` where its size allows."""
    asked = some.select(*[c.alias(f"__k{k}") for k, c in enumerate(_cols(keys))]).distinct()
    on = reduce(lambda x, y: x & y, [c.eqNullSafe(F.col(f"__k{k}")) for k, c in enumerate(_keyed_plain(df, keys))])
    return df.join(asked, on, "left_semi")


def _keyed_plain(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    kinds = {f.name: f.dataType for f in df.schema}
    return [comparable(col(k), kinds[k]) for k in keys]


def changed_rows(source: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Keys that both sides have, with different rows."""
    return classify(source, target, keys, values, null_safe).where(F.col("status") == MISMATCH).select(*_cols(keys))


def _differing_pairs(stacked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, __s, __t): of repeated keys, rows that one side has more often than the other, paired in the order of their hashes.

    Ranks are made of a row's place within 256 ranges of hashes and the rows of the ranges before, so a hot key is many small groups.
    """
    side = F.when(F.col("__s").isNotNull(), 0).otherwise(1)
    each = stacked.withColumn("__hash", F.coalesce("__s.hash", "__t.hash")).withColumn("__f", side)
    net = each.groupBy(*_cols(keys), "__hash").agg(
        F.sum(F.lit(1) - 2 * F.col("__f")).alias("__n"), *[F.max_by(n, f"{n}.hash").alias(n) for n in ("__s", "__t")]
    ).where("__n <> 0")
    left = net.withColumn("__f", F.when(F.col("__n") > 0, 0).otherwise(1)).withColumn("__range", F.substring("__hash", 1, 2))
    names = [f"__k{k}" for k in range(len(keys))]
    ranges = left.groupBy(*_cols(keys), "__f", "__range").agg(F.sum(F.abs("__n")).alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(*_cols(keys), "__f").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.select(*[c.alias(n) for c, n in zip(_cols(keys), names)], F.col("__f").alias("__kf"), F.col("__range").alias("__kr"), F.coalesce(before, F.lit(0)).alias("__before"))
    on = [c.eqNullSafe(F.col(n)) for c, n in zip(_cols(keys), names)] + [F.col("__f") == F.col("__kf"), F.col("__range") == F.col("__kr")]
    inside = Window.partitionBy(*_cols(keys), "__f", "__range").orderBy("__hash").rowsBetween(Window.unboundedPreceding, -1)
    ranked = left.withColumn("__in", F.coalesce(F.sum(F.abs("__n")).over(inside), F.lit(0))).join(offsets, reduce(lambda x, y: x & y, on))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__n")))
    placed = ranked.select("*", copies.alias("__copy")).withColumn("__rank", F.col("__before") + F.col("__in") + F.col("__copy"))
    own = [F.when(F.col("__f") == f, F.col(n)).alias(n) for f, n in enumerate(("__s", "__t"))]
    placed = placed.select(*_cols(keys), "__rank", "__hash", *own)
    return placed.groupBy(*_cols(keys), "__rank").agg(*[F.max_by(n, f"{n}.hash").alias(n) for n in ("__s", "__t")]).drop("__rank").where("__s is not null and __t is not null")


def changed_cells(source: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str], of: DataFrame | None = None, tolerance: float = TOLERANCE, all_if_none: bool = True, repeated: bool = True) -> DataFrame:
    """(keys, column, source_value, target_value, source_row_hash, target_row_hash): a row for each cell that differs.

    ``of`` limits the keys that are looked at. A changed row without a cell that differs by more than the tolerance gives all
    its value columns, if ``all_if_none``. Of a repeated key, rows that both sides have go out, and the others are paired in the order of
    their hashes; what one side then has more of has no pair. A caller that knows that no key is ``repeated`` saves that work.
    """
    of = changed_rows(source, target, keys, values) if of is None else of
    frames = (source, target)
    whole = [F.struct(row_hash(df, values, strict=True).alias("hash"), *[col(v).alias(f"v{k}") for k, v in enumerate(values)]) for df in frames]
    kinds = [df.select(w.alias("w")).schema["w"].dataType for df, w in zip(frames, whole)]
    sides = [df.select(*_keyed(df, keys), *[(w if g == f else F.lit(None).cast(kind)).alias(n) for g, (n, kind) in enumerate(zip(("__s", "__t"), kinds))]) for f, (df, w) in enumerate(zip(frames, whole))]
    # Both sides are stacked, so keys are looked up once.
    chosen = rows_for_keys(sides[0].unionByName(sides[1]), of, keys)
    if repeated:
        pairs = _differing_pairs(chosen, keys)
    else:
        pairs = chosen.groupBy(*_cols(keys)).agg(*[F.max_by(n, f"{n}.hash").alias(n) for n in ("__s", "__t")]).where("__s is not null and __t is not null")
    cells = F.array(*[
        F.struct(
            F.lit(v).alias("column"), F.col(f"__s.v{k}").cast("string").alias("source_value"), F.col(f"__t.v{k}").cast("string").alias("target_value"),
            differs(F.col(f"__s.v{k}"), F.col(f"__t.v{k}"), source.schema[v].dataType, target.schema[v].dataType, tolerance).alias("differs"),
        )
        for k, v in enumerate(values)
    ])
    paired = pairs.select(*_cols(keys), F.col("__s.hash").alias("source_row_hash"), F.col("__t.hash").alias("target_row_hash"), cells.alias("cells"))
    found = F.filter("cells", lambda x: x["differs"])
    chosen = F.when(F.size(found) > 0, found).otherwise(F.col("cells")) if all_if_none else found
    exploded = paired.select(*_cols(keys), "source_row_hash", "target_row_hash", F.explode(chosen).alias("cell"))
    return exploded.select(*_cols(keys), "cell.column", "cell.source_value", "cell.target_value", "source_row_hash", "target_row_hash")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that more than one row has; nulls are equal."""
    return df.select(*_keyed(df, keys)).groupBy(*_cols(keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(duplicate_groups, duplicate_rows), all members of a group counted."""
    return duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))


def keyed_presence(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(matched, missing, extra): distinct keys of both sides, of the source only, of the target only."""
    stack = source.select(*_keyed(source, keys), F.lit(1).alias("__s"), F.lit(0).alias("__t")).unionByName(target.select(*_keyed(target, keys), F.lit(0).alias("__s"), F.lit(1).alias("__t")))
    held = stack.groupBy(*_cols(keys)).agg(F.max("__s").alias("__s"), F.max("__t").alias("__t"))
    return held.agg(
        F.count_if((F.col("__s") == 1) & (F.col("__t") == 1)).alias("matched"),
        F.count_if((F.col("__s") == 1) & (F.col("__t") == 0)).alias("missing"), F.count_if((F.col("__s") == 0) & (F.col("__t") == 1)).alias("extra"),
    )


def keyless_presence(source: DataFrame, target: DataFrame, columns: Sequence[str], multiset: bool = False) -> DataFrame:
    """(matched, missing, extra) rows by their whole content, nulls equal.

    A row is missing if the target has no such row at all, however often the source has it; with ``multiset`` copies count.
    """
    stack = source.select(*_keyed(source, columns), F.lit(1).alias("__s"), F.lit(0).alias("__t")).unionByName(target.select(*_keyed(target, columns), F.lit(0).alias("__s"), F.lit(1).alias("__t")))
    held = stack.groupBy(*_cols(columns)).agg(F.sum("__s").alias("__s"), F.sum("__t").alias("__t"))
    s, t = F.col("__s"), F.col("__t")
    if multiset:
        matched, missing, extra = F.least(s, t), F.greatest(s - t, F.lit(0)), F.greatest(t - s, F.lit(0))
    else:
        matched, missing, extra = F.when(t > 0, s).otherwise(0), F.when(t == 0, s).otherwise(0), F.when(s == 0, t).otherwise(0)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return held.agg(total(matched).alias("matched"), total(missing).alias("missing"), total(extra).alias("extra"))
