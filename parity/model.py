"""Requests and results. Dataclasses check what they are given; results are plain trees."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from enum import Enum
from typing import Any


class Status(str, Enum):
    PASS = "PASS"
    FAIL = "FAIL"
    ERROR = "ERROR"
    SKIPPED = "SKIPPED"


class Outcome(str, Enum):
    """Of one file against one table."""

    PASS = "PASS"
    WARN = "WARN"
    FAIL = "FAIL"


class Mode(str, Enum):
    """How far a table's data is compared: counts; statistics too; rows by key too; rows with samples too."""

    COUNT_ONLY = "COUNT_ONLY"
    STATISTICS = "STATISTICS"
    HASH = "HASH"
    FULL = "FULL"


def names(value: Any) -> list[str]:
    """None, one name or several, as a list."""
    return [] if value is None else [value] if isinstance(value, str) else [str(x) for x in value]


def _within(name: str, value: float, low: float, high: float = float("inf")) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")


@dataclass
class Options:
    """What a comparison of a file and a table looks at."""

    primary_keys: list[str] = field(default_factory=list)
    ignore_columns: list[str] = field(default_factory=list)
    compare_schema: bool = True
    compare_values: bool = True
    compare_duplicates: bool = True
    case_sensitive: bool = True
    trim_strings: bool = True
    numeric_tolerance: float = 0.0
    sample_size: int = 20

    def __post_init__(self) -> None:
        self.primary_keys, self.ignore_columns = names(self.primary_keys), names(self.ignore_columns)
        _within("numeric_tolerance", self.numeric_tolerance, 0.0)
        _within("sample_size", self.sample_size, 1, 500)


@dataclass
class CompareRequest(Options):
    """source_table is a CSV path, unless source_query is given; target_query goes before target_table."""

    source_table: str = ""
    target_table: str = ""
    source_query: str | None = None
    target_query: str | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if not (self.source_table or self.source_query) or not (self.target_table or self.target_query):
            raise ValueError("a source and a target are needed")

    @classmethod
    def of(cls, source_table: str, target_table: str, options: Options | None = None, **more: Any) -> CompareRequest:
        chosen = {f.name: getattr(options, f.name) for f in fields(options)} if options else {}
        return cls(source_table=source_table, target_table=target_table, **chosen, **more)


@dataclass
class CompareResult:
    status: Outcome = Outcome.PASS
    execution_time_seconds: float = 0.0
    source_row_count: int = 0
    target_row_count: int = 0
    matched_rows: int = 0
    missing_rows: int = 0
    extra_rows: int = 0
    source_duplicate_rows: int = 0
    target_duplicate_rows: int = 0
    schema_match: bool = True
    column_differences: list[dict] = field(default_factory=list)
    duplicate_keys: dict[str, list[dict]] = field(default_factory=dict)
    null_differences: list[dict] = field(default_factory=list)
    type_differences: list[dict] = field(default_factory=list)
    value_mismatches: int = 0
    sample_mismatches: list[dict] = field(default_factory=list)


@dataclass
class CatalogRequest:
    source_catalog: str
    target_catalog: str
    schemas: list[str] | None = None
    tables: list[str] | None = None
    ignore_columns: list[str] = field(default_factory=list)
    case_sensitive_columns: bool = False
    validate_column_order: bool = True
    validate_nullable: bool = True
    primary_keys: dict[str, list[str]] = field(default_factory=dict)
    data_compare_mode: Mode = Mode.STATISTICS
    max_sample_rows: int = 50
    #: Also leave tables and schemas outside ``schemas`` and ``tables`` out of what counts as missing or extra.
    scope_missing: bool = False
    #: Rows whose key holds a NULL are compared too; otherwise such rows never count as changed.
    null_safe_keys: bool = True

    def __post_init__(self) -> None:
        if not self.source_catalog or not self.target_catalog:
            raise ValueError("both catalogs need a name")
        self.schemas = None if self.schemas is None else names(self.schemas)
        self.tables = None if self.tables is None else names(self.tables)
        self.ignore_columns = names(self.ignore_columns)
        self.primary_keys = {k: names(v) for k, v in (self.primary_keys or {}).items()}
        self.data_compare_mode = Mode(self.data_compare_mode)
        _within("max_sample_rows", self.max_sample_rows, 1, 1000)

    def keys_of(self, schema: str, table: str) -> list[str]:
        return self.primary_keys.get(f"{schema}.{table}") or self.primary_keys.get(table) or []


@dataclass
class ColumnResult:
    column: str
    status: Status = Status.SKIPPED
    source_data_type: str | None = None
    target_data_type: str | None = None
    data_type_status: Status | None = None
    source_nullable: bool | None = None
    target_nullable: bool | None = None
    nullable_status: Status | None = None
    source_null_count: int | None = None
    target_null_count: int | None = None
    null_count_status: Status | None = None
    source_distinct_count: int | None = None
    target_distinct_count: int | None = None
    distinct_count_status: Status | None = None
    source_min: Any = None
    source_max: Any = None
    target_min: Any = None
    target_max: Any = None
    min_max_status: Status | None = None
    error: str | None = None


@dataclass
class CellMismatch:
    schema_name: str
    table: str
    primary_key: dict[str, Any]
    mismatch_column: str
    source_value: Any = None
    target_value: Any = None
    source_row_hash: str | None = None
    target_row_hash: str | None = None


@dataclass
class HashMismatch:
    """status: MISMATCH, MISSING_IN_TARGET or MISSING_IN_SOURCE."""

    primary_key: str
    source_hash: str
    target_hash: str
    status: str


@dataclass
class DataResult:
    mode: Mode
    status: Status = Status.SKIPPED
    source_only_rows: int | None = None
    target_only_rows: int | None = None
    changed_rows: int | None = None
    source_duplicate_keys: int | None = None
    target_duplicate_keys: int | None = None
    key_columns: list[str] = field(default_factory=list)
    sample_source_only: list[dict] = field(default_factory=list)
    sample_target_only: list[dict] = field(default_factory=list)
    sample_changed: list[dict] = field(default_factory=list)
    sample_changed_detail: list[CellMismatch] = field(default_factory=list)
    row_hash_mismatches: list[HashMismatch] = field(default_factory=list)
    row_hash_mismatch_count: int = 0
    row_hash_mismatch_percentage: float = 0.0
    note: str | None = None
    error: str | None = None


@dataclass
class TableResult:
    schema_name: str
    table: str
    status: Status = Status.SKIPPED
    exists_in_source: bool = True
    exists_in_target: bool = True
    missing_columns: list[str] = field(default_factory=list)
    extra_columns: list[str] = field(default_factory=list)
    columns_status: Status = Status.SKIPPED
    column_order_status: Status = Status.SKIPPED
    source_column_order: list[str] = field(default_factory=list)
    target_column_order: list[str] = field(default_factory=list)
    row_count_source: int | None = None
    row_count_target: int | None = None
    row_count_difference: int | None = None
    row_count_status: Status = Status.SKIPPED
    columns: list[ColumnResult] = field(default_factory=list)
    data_types_status: Status = Status.SKIPPED
    nullable_status: Status = Status.SKIPPED
    null_counts_status: Status = Status.SKIPPED
    distinct_counts_status: Status = Status.SKIPPED
    min_max_status: Status = Status.SKIPPED
    data: DataResult | None = None
    error: str | None = None


@dataclass
class SchemaResult:
    schema_name: str
    status: Status = Status.SKIPPED
    exists_in_source: bool = True
    exists_in_target: bool = True
    missing_tables: list[str] = field(default_factory=list)
    extra_tables: list[str] = field(default_factory=list)
    tables: list[TableResult] = field(default_factory=list)
    error: str | None = None


@dataclass
class Summary:
    total_schemas: int = 0
    passed_schemas: int = 0
    failed_schemas: int = 0
    total_tables: int = 0
    passed_tables: int = 0
    failed_tables: int = 0
    error_tables: int = 0
    missing_tables: int = 0
    extra_tables: int = 0


@dataclass
class CatalogResult:
    source_catalog: str
    target_catalog: str
    status: Status = Status.SKIPPED
    validation_timestamp: str | None = None
    execution_time_seconds: float = 0.0
    missing_schemas: list[str] = field(default_factory=list)
    extra_schemas: list[str] = field(default_factory=list)
    summary: Summary = field(default_factory=Summary)
    schemas: list[SchemaResult] = field(default_factory=list)
    error: str | None = None
