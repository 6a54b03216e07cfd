"""The two comparisons: catalogs against catalogs, and a file or query against a table or query.

Operators say what is so; this module runs them, keeps the failure of one table from touching the others, and hands
findings to ``verdict``. Only aggregates and bounded samples reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.functions.cells import col, is_ordered, key_text
from parity.model import (
    CatalogRequest, CatalogResult, CellMismatch, ColumnResult, CompareRequest, CompareResult, DataResult, HashMismatch, Mode, SchemaResult, Status, TableResult,
)
from parity.operators import clean, diff, stats
from parity.operators.schema import column_sets, order_of_common, type_differences
from parity.plans import verdict
from parity.sources.catalog import Catalogs
from parity.sources.files import read_csv

#: Tables compared at a time. Each is a few Spark jobs; more at a time would only queue.
TABLES_AT_ONCE = 4
#: Keys sampled for their cells where the mode doesn't ask for samples.
HASH_SAMPLE = 5
#: Changed keys that go to the executors as a local table; more are found there anew.
CHANGED_AT_ONCE = 10_000
#: Schemas of metadata, which are no one's data.
SYSTEM_SCHEMAS = ("information_schema",)


def _attempt(work: Callable, on_error: Callable[[str], None]) -> None:
    try:
        work()
    except Exception as e:  # noqa: BLE001  one table's failure is a finding, not the end
        on_error(f"{type(e).__name__}: {str(e)[:500]}")


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class CatalogComparison:
    def __init__(self, catalogs: Catalogs, threads: int = TABLES_AT_ONCE):
        self.catalogs, self.threads = catalogs, threads

    def validate(self, request: CatalogRequest) -> CatalogResult:
        began = time.monotonic()
        out = CatalogResult(request.source_catalog, request.target_catalog, validation_timestamp=datetime.now(timezone.utc).isoformat())

        def failed(message: str) -> None:
            out.status, out.error = Status.ERROR, message

        _attempt(lambda: self._catalogs(request, out), failed)
        out.summary = verdict.summarize(out)
        out.execution_time_seconds = round(time.monotonic() - began, 3)
        return out

    def _catalogs(self, request: CatalogRequest, out: CatalogResult) -> None:
        absent = [c for c in (request.source_catalog, request.target_catalog) if not self.catalogs.has_catalog(c)]
        if absent:
            out.status, out.error = Status.FAIL, f"no such catalog: {', '.join(absent)}"
            return
        source, target = ({s for s in self.catalogs.schemas(c) if s.lower() not in SYSTEM_SCHEMAS} for c in (request.source_catalog, request.target_catalog))
        common, out.missing_schemas, out.extra_schemas = _split(source, target, request.schemas, request.scope_missing)
        out.schemas = [self._schema(request, s) for s in common]
        out.status = verdict.overall([*(s.status for s in out.schemas), Status.FAIL if out.missing_schemas else None])

    def _schema(self, request: CatalogRequest, schema: str) -> SchemaResult:
        out = SchemaResult(schema)

        def failed(message: str) -> None:
            out.status, out.error = Status.ERROR, message

        def work() -> None:
            source, target = (set(self.catalogs.tables(c, schema)) for c in (request.source_catalog, request.target_catalog))
            common, out.missing_tables, out.extra_tables = _split(source, target, request.tables, request.scope_missing)
            with ThreadPoolExecutor(max(1, self.threads)) as pool:
                out.tables = list(pool.map(lambda t: self._table(request, schema, t), common))
            out.status = verdict.overall([*(t.status for t in out.tables), Status.FAIL if out.missing_tables else None])

        _attempt(work, failed)
        return out

    def _table(self, request: CatalogRequest, schema: str, table: str) -> TableResult:
        out = TableResult(schema, table)

        def failed(message: str) -> None:
            out.status, out.error = Status.ERROR, message

        def work() -> None:
            source, target = (self.catalogs.table(c, schema, table) for c in (request.source_catalog, request.target_catalog))
            compare_table(source, target, request, out)

        _attempt(work, failed)
        return out


def _split(source: set[str], target: set[str], wanted: list[str] | None, scope_missing: bool) -> tuple[list[str], list[str], list[str]]:
    """Common names (limited to ``wanted``, whatever their case), missing and extra ones (limited only if asked)."""
    low = None if wanted is None else {w.lower() for w in wanted}
    inside = lambda names, limit: sorted(n for n in names if low is None or not limit or n.lower() in low)
    return inside(source & target, True), inside(source - target, scope_missing), inside(target - source, scope_missing)


def compare_table(source: DataFrame, target: DataFrame, request: CatalogRequest, out: TableResult) -> None:
    sets = column_sets(source.columns, target.columns, request.ignore_columns, request.case_sensitive_columns)
    out.missing_columns, out.extra_columns = sets.missing, sets.extra
    out.columns_status = Status.FAIL if sets.missing or sets.extra or not sets.common else Status.PASS
    if not sets.common:
        out.status = Status.FAIL
        return
    out.source_column_order, out.target_column_order = order_of_common(source.columns, target.columns, sets)
    if request.validate_column_order:
        out.column_order_status = verdict.equal(out.source_column_order, out.target_column_order)
    # From here on the target's common columns have the source's spelling.
    source = source.select(*[col(a) for a, _ in sets.common])
    renamed = target.select(*[col(b).alias(a) for a, b in sets.common])
    out.columns = [_column(request, source, renamed, a) for a, _ in sets.common]
    _statistics(request, source, renamed, out)
    _aspects(out)
    _counts(source, renamed, out)
    _data(request, source, renamed, out)
    out.status = verdict.overall([
        out.columns_status, out.column_order_status, out.data_types_status, out.nullable_status, out.null_counts_status,
        out.distinct_counts_status, out.min_max_status, out.row_count_status, out.data.status if out.data else None,
    ])


def _column(request: CatalogRequest, source: DataFrame, target: DataFrame, name: str) -> ColumnResult:
    s, t = source.schema[name], target.schema[name]
    out = ColumnResult(name, source_data_type=s.dataType.simpleString(), target_data_type=t.dataType.simpleString(), source_nullable=s.nullable, target_nullable=t.nullable)
    out.data_type_status = verdict.equal(out.source_data_type, out.target_data_type)
    out.nullable_status = verdict.equal(s.nullable, t.nullable) if request.validate_nullable else Status.SKIPPED
    return out


def _statistics(request: CatalogRequest, source: DataFrame, target: DataFrame, out: TableResult) -> None:
    """COUNT_ONLY leaves statistics out."""
    if request.data_compare_mode == Mode.COUNT_ONLY:
        for c in out.columns:
            c.null_count_status = c.distinct_count_status = c.min_max_status = Status.SKIPPED
        return

    def failed(message: str) -> None:
        for c in out.columns:
            c.null_count_status = c.distinct_count_status = c.min_max_status = Status.ERROR
            c.error = message

    def work() -> None:
        names = [c.column for c in out.columns]
        s, t = ({r["column"]: r for r in stats.column_statistics(df, names).collect()} for df in (source, target))
        for c in out.columns:
            a, b = s[c.column], t[c.column]
            c.source_null_count, c.target_null_count = a["null_count"], b["null_count"]
            c.source_distinct_count, c.target_distinct_count = a["distinct_count"], b["distinct_count"]
            c.source_min, c.source_max, c.target_min, c.target_max = a["min_value"], a["max_value"], b["min_value"], b["max_value"]
            c.null_count_status = verdict.equal(a["null_count"], b["null_count"])
            c.distinct_count_status = verdict.equal(a["distinct_count"], b["distinct_count"])
            ordered = is_ordered(source.schema[c.column].dataType) and is_ordered(target.schema[c.column].dataType)
            c.min_max_status = verdict.equal((c.source_min, c.source_max), (c.target_min, c.target_max)) if ordered else Status.SKIPPED

    _attempt(work, failed)


def _aspects(out: TableResult) -> None:
    for c in out.columns:
        c.status = verdict.overall([c.data_type_status, c.nullable_status, c.null_count_status, c.distinct_count_status, c.min_max_status])
    of = lambda name: verdict.overall(getattr(c, name) for c in out.columns)
    out.data_types_status, out.nullable_status = of("data_type_status"), of("nullable_status")
    out.null_counts_status, out.distinct_counts_status, out.min_max_status = of("null_count_status"), of("distinct_count_status"), of("min_max_status")


def _counts(source: DataFrame, target: DataFrame, out: TableResult) -> None:
    def failed(message: str) -> None:
        out.row_count_status, out.error = Status.ERROR, message

    def work() -> None:
        a, b = source.count(), target.count()
        out.row_count_source, out.row_count_target, out.row_count_difference = a, b, b - a
        out.row_count_status = verdict.equal(a, b)

    _attempt(work, failed)


def _data(request: CatalogRequest, source: DataFrame, target: DataFrame, out: TableResult) -> None:
    """Rows by key: whenever a key is configured, row hashes are compared; HASH and FULL also count and sample differences."""
    mode, keys = request.data_compare_mode, request.keys_of(out.schema_name, out.table)
    data = out.data = DataResult(mode)
    if not keys:
        data.note = "rows aren't compared without a key"
        return
    known = {c.lower(): c for c in source.columns}
    if absent := [k for k in keys if k.lower() not in known]:
        data.status, data.error = Status.ERROR, f"no common column {', '.join(absent)}"
        return
    keys = data.key_columns = [known[k.lower()] for k in keys]
    values = [c for c in source.columns if c not in keys]
    deep = mode in (Mode.HASH, Mode.FULL)
    if not deep:
        data.note = f"{mode.value} compares row hashes only"

    def failed(message: str) -> None:
        data.status, data.error = Status.ERROR, message

    _attempt(lambda: _rows(request, source, target, keys, values, deep, out), failed)


def _rows(request: CatalogRequest, source: DataFrame, target: DataFrame, keys: list[str], values: list[str], deep: bool, out: TableResult) -> None:
    data = out.data
    classified = diff.classify(source, target, keys, values, request.null_safe_keys)
    full, limit, status = request.data_compare_mode == Mode.FULL, request.max_sample_rows, F.col("status")
    samples = {"bad": (status != diff.MATCH, limit)}
    if deep:
        samples["changed"] = (status == diff.MISMATCH, limit if full else HASH_SAMPLE)
    if full:
        samples |= {"source": (status == diff.MISSING_IN_TARGET, limit), "target": (status == diff.MISSING_IN_SOURCE, limit)}
    by, found = diff.survey(classified, keys, samples)
    n = {s: by[s]["n"] if s in by else 0 for s in (diff.MATCH, diff.MISMATCH, diff.MISSING_IN_TARGET, diff.MISSING_IN_SOURCE)}
    data.source_duplicate_keys = sum(r["source_repeated"] for r in by.values())
    data.target_duplicate_keys = sum(r["target_repeated"] for r in by.values())
    wrong = sum(n.values()) - n[diff.MATCH]
    data.row_hash_mismatch_count = wrong
    data.row_hash_mismatch_percentage = 100.0 * wrong / sum(n.values()) if sum(n.values()) else 0.0
    data.status = Status.FAIL if wrong else Status.PASS
    if deep:
        data.source_only_rows, data.target_only_rows, data.changed_rows = n[diff.MISSING_IN_TARGET], n[diff.MISSING_IN_SOURCE], n[diff.MISMATCH]
    if not wrong:
        return
    bad = diff.key_frame(classified, keys, found["bad"])
    hashes = diff.classify_hashes(diff.rows_for_keys(source, bad, keys), diff.rows_for_keys(target, bad, keys), keys, values)
    text = hashes.select(key_text(keys).alias("k"), "source_hash", "target_hash", "status").orderBy("k")
    data.row_hash_mismatches = [HashMismatch(r["k"], r["source_hash"] or "", r["target_hash"] or "", r["status"]) for r in text.collect()]
    as_dicts = lambda rows: [{k: r[k] for k in keys} for r in rows]
    if full:
        data.sample_source_only, data.sample_target_only = as_dicts(found["source"]), as_dicts(found["target"])
    if deep and found["changed"]:
        data.sample_changed = as_dicts(found["changed"])
        repeated = any(r["source_rows"] > 1 or r["target_rows"] > 1 for r in found["changed"])
        changed = diff.key_frame(classified, keys, found["changed"])
        cells = diff.changed_cells(source, target, keys, values, of=changed, repeated=repeated).orderBy(*[col(k) for k in keys], "column")
        for r in cells.collect():
            key = {k: r[k] for k in keys}
            data.sample_changed_detail.append(CellMismatch(out.schema_name, out.table, key, r["column"], r["source_value"], r["target_value"], r["source_row_hash"], r["target_row_hash"]))


class TableComparison:
    """A file (or query) against a table (or query)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def compare(self, request: CompareRequest) -> CompareResult:
        source = self.spark.sql(request.source_query) if request.source_query else read_csv(self.spark, request.source_table)
        target = self.spark.sql(request.target_query) if request.target_query else self.spark.table(request.target_table)
        return compare_frames(source, target, request)


def compare_frames(source: DataFrame, target: DataFrame, request: CompareRequest) -> CompareResult:
    began, out = time.monotonic(), CompareResult()
    sets = column_sets(source.columns, target.columns, request.ignore_columns, case_sensitive=False)
    raw_source, raw_target = source, target
    source, target = (clean.clean_texts(clean.drop_ignored(df, request.ignore_columns), request.trim_strings, not request.case_sensitive) for df in (source, target))
    source = source.select(*[col(a) for a, _ in sets.common])
    target = target.select(*[col(b).alias(a) for a, b in sets.common])
    known = {c.lower(): c for c in source.columns}
    if absent := [k for k in request.primary_keys if k.lower() not in known]:
        raise ValueError(f"no common column {', '.join(absent)}")
    keys = [known[k.lower()] for k in request.primary_keys]
    values = [c for c in source.columns if c not in keys]
    if request.compare_schema:
        out.column_differences = [{"type": kind, "columns": found} for kind, found in (("missing_columns_in_target", sets.missing), ("extra_columns_in_target", sets.extra)) if found]
        out.schema_match = not out.column_differences
        out.type_differences = type_differences(raw_source, raw_target, sets)
    if not sets.common:
        out.source_row_count, out.target_row_count = raw_source.count(), raw_target.count()
        out.status, out.execution_time_seconds = verdict.outcome(out), round(time.monotonic() - began, 3)
        return out
    nulls = [stats.null_counts(df).withColumn("side", F.lit(k)) for k, df in enumerate((source, target))]
    counts = {(r["side"], r["column"]): r["null_count"] for r in nulls[0].unionByName(nulls[1]).collect()}
    out.null_differences = [{"column": c, "source_nulls": counts[0, c], "target_nulls": counts[1, c]} for c in source.columns if counts[0, c] != counts[1, c]]
    if keys:
        _by_key(source, target, keys, values, request, out)
    else:
        found = diff.keyless_presence(source, target, source.columns).first()
        out.matched_rows, out.missing_rows, out.extra_rows = found["matched"], found["missing"], found["extra"]
        out.source_row_count, out.target_row_count = found["matched"] + found["missing"], target.count()
    out.status = verdict.outcome(out)
    out.execution_time_seconds = round(time.monotonic() - began, 3)
    return out


def _by_key(source: DataFrame, target: DataFrame, keys: list[str], values: list[str], request: CompareRequest, out: CompareResult) -> None:
    """Counts, presence, repeated keys and changed keys by one shuffle of both tables; cells by a second look at the changed keys."""
    compared = values if request.compare_values else []
    classified = diff.classify(source, target, keys, compared)
    samples = {f"{side}_repeated": (F.col(f"{side}_rows") > 1, request.sample_size) for side in ("source", "target") if request.compare_duplicates}
    if compared:
        samples["changed"] = (F.col("status") == diff.MISMATCH, CHANGED_AT_ONCE)
    by, found = diff.survey(classified, keys, samples)
    total = lambda name, of=None: sum(r[name] for s, r in by.items() if of is None or s in of)
    out.source_row_count, out.target_row_count = total("source_rows"), total("target_rows")
    out.matched_rows, out.missing_rows, out.extra_rows = total("n", (diff.MATCH, diff.MISMATCH)), total("n", (diff.MISSING_IN_TARGET,)), total("n", (diff.MISSING_IN_SOURCE,))
    if request.compare_duplicates:
        out.source_duplicate_rows, out.target_duplicate_rows = total("source_repeated_rows"), total("target_repeated_rows")
        for side in ("source", "target"):
            if rows := found[f"{side}_repeated"]:
                out.duplicate_keys[side] = [{**{k: r[k] for k in keys}, "n": r[f"{side}_rows"]} for r in rows]
    if not compared or not found["changed"]:
        return
    repeated = bool(total("source_repeated", (diff.MISMATCH,)) + total("target_repeated", (diff.MISMATCH,)))
    if total("n", (diff.MISMATCH,)) <= CHANGED_AT_ONCE:
        changed = diff.key_frame(classified, keys, found["changed"])
    else:
        changed = classified.where(F.col("status") == diff.MISMATCH).select(*[col(k) for k in keys])
    cells = diff.changed_cells(source, target, keys, values, of=changed, tolerance=max(request.numeric_tolerance, 1e-9), all_if_none=False, repeated=repeated)
    # the count and the sample read one exchange
    shown = cells.orderBy(*[col(k) for k in keys], "column").limit(request.sample_size).withColumn("__n", F.lit(None).cast("long"))
    number = cells.agg(F.count(F.lit(1)).alias("__n")).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in cells.schema.fields], "__n")
    for r in shown.unionByName(number).collect():
        if r["__n"] is None:
            out.sample_mismatches.append({k: v for k, v in r.asDict(recursive=True).items() if k != "__n"})
        else:
            out.value_mismatches = r["__n"]
