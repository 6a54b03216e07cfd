"""From findings to statuses. Nothing here touches data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parity.model import CatalogResult, CompareResult, Outcome, Status, Summary


def overall(statuses: Iterable[Status | None]) -> Status:
    """ERROR before FAIL before PASS; SKIPPED if there is nothing else. None doesn't count."""
    seen = {s for s in statuses if s is not None}
    for s in (Status.ERROR, Status.FAIL, Status.PASS):
        if s in seen:
            return s
    return Status.SKIPPED


def overall_column(status: Column) -> Column:
    """``overall`` as an aggregate over a column of statuses."""
    has = lambda s: F.coalesce(F.bool_or(status == s), F.lit(False))
    return F.when(has("ERROR"), "ERROR").when(has("FAIL"), "FAIL").when(has("PASS"), "PASS").otherwise("SKIPPED")


def equal(a: object, b: object) -> Status:
    return Status.PASS if a == b else Status.FAIL


def outcome(r: CompareResult) -> Outcome:
    hard = not r.schema_match or r.missing_rows or r.extra_rows or r.source_duplicate_rows or r.target_duplicate_rows or r.value_mismatches
    return Outcome.FAIL if hard else Outcome.WARN if r.null_differences or r.type_differences else Outcome.PASS


def summarize(result: CatalogResult) -> Summary:
    """Missing schemas count as failed and skipped ones as passed; skipped tables count as failed, and so do those in error."""
    out = Summary(total_schemas=len(result.schemas) + len(result.missing_schemas), failed_schemas=len(result.missing_schemas))
    for s in result.schemas:
        good = s.status in (Status.PASS, Status.SKIPPED)
        out.passed_schemas += good
        out.failed_schemas += not good
        out.missing_tables += len(s.missing_tables)
        out.extra_tables += len(s.extra_tables)
        for t in s.tables:
            out.total_tables += 1
            out.passed_tables += t.status == Status.PASS
            out.failed_tables += t.status != Status.PASS
            out.error_tables += t.status == Status.ERROR
    return out
