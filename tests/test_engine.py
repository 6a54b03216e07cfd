"""What the comparison of catalogs finds, on small frames."""

import pytest
from pyspark.sql import types as T

from parity.model import CatalogRequest, Mode, Status
from parity.plans.engine import CatalogComparison
from parity.plans.verdict import overall
from parity.sources.catalog import FrameCatalogs

P, F, E, S = Status.PASS, Status.FAIL, Status.ERROR, Status.SKIPPED


def frame(spark, rows, *fields):
    kinds = {"int": T.IntegerType(), "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType()}
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, kinds[k], null) for n, k, null in fields]))


ID, NAME, AGE = ("id", "int", False), ("name", "string", True), ("age", "int", True)


@pytest.fixture
def people(spark):
    return frame(spark, [(k, None if k % 5 == 0 else f"n{k}") for k in range(20)], ID, NAME)


def run(source, target, **more):
    catalogs = FrameCatalogs({"a": {"bronze": source} if not isinstance(source, dict) or "bronze" not in source else source, "b": {"bronze": target} if not isinstance(target, dict) or "bronze" not in target else target})
    return CatalogComparison(catalogs).validate(CatalogRequest("a", "b", **more))


def one(source, target, **more):
    return run({"people": source}, {"people": target}, **more).schemas[0].tables[0]


def test_equal_tables_pass(people):
    r = run({"people": people}, {"people": people}, primary_keys={"people": ["id"]}, data_compare_mode="FULL")
    assert r.status == P and r.summary.passed_tables == 1 and r.schemas[0].tables[0].data.status == P


@pytest.mark.parametrize("a, b", [("x", "b"), ("a", "x"), ("x", "y")])
def test_absent_catalogs_fail_at_once(people, a, b):
    r = CatalogComparison(FrameCatalogs({"a": {}, "b": {}})).validate(CatalogRequest(a, b))
    assert r.status == F and r.schemas == [] and "x" in r.error


def test_failing_probe_is_an_error():
    class Broken(FrameCatalogs):
        def has_catalog(self, catalog):
            raise ConnectionError("gone")

    assert CatalogComparison(Broken({})).validate(CatalogRequest("a", "b")).status == E


def test_schemas_and_tables(people):
    r = CatalogComparison(FrameCatalogs({"a": {"bronze": {"people": people, "orders": people}, "gold": {}, "Information_Schema": {}}, "b": {"bronze": {"people": people, "employees": people}}})).validate(CatalogRequest("a", "b"))
    assert (r.missing_schemas, r.extra_schemas, r.status) == (["gold"], [], F)
    assert (r.schemas[0].missing_tables, r.schemas[0].extra_tables) == (["orders"], ["employees"])
    assert (r.summary.total_schemas, r.summary.failed_schemas, r.summary.missing_tables, r.summary.extra_tables) == (2, 2, 1, 1)


def test_filters_limit_common_names_and_missing_ones_if_asked(people):
    a, b = {"people": people, "orders": people, "gone": people}, {"people": people, "orders": people}
    r = run(a, b, tables="PEOPLE")
    assert [t.table for t in r.schemas[0].tables] == ["people"] and r.schemas[0].missing_tables == ["gone"] and r.status == F
    assert run(a, b, tables=["people"], scope_missing=True).status == P


def test_missing_and_extra_columns(spark):
    r = one(frame(spark, [(1, 2)], ID, AGE), frame(spark, [(1, "x")], ID, ("phone", "string", True)))
    assert (r.missing_columns, r.extra_columns, r.columns_status, r.status) == (["age"], ["phone"], F, F)
    assert one(frame(spark, [(1,)], ID), frame(spark, [(1,)], AGE)).columns_status == F
    assert one(frame(spark, [(1, 2)], ID, AGE), frame(spark, [(1,)], ID), ignore_columns="AGE").columns_status == P


def test_type_and_nullability(spark):
    r = one(frame(spark, [(1, 2)], ID, AGE), frame(spark, [(1, 2)], ID, ("age", "bigint", True)))
    assert (r.data_types_status, r.columns[0].source_data_type, r.columns[0].target_data_type) == (F, "int", "bigint")
    a, b = frame(spark, [(1,)], ID), frame(spark, [(1,)], ("id", "int", True))
    assert one(a, b).nullable_status == F and one(a, b, validate_nullable=False).nullable_status == S


def test_column_order(spark):
    a, b = frame(spark, [(1, "x", 2)], ID, NAME, AGE), frame(spark, [(1, 2, "x")], ID, AGE, NAME)
    r = one(a, b)
    assert (r.column_order_status, r.source_column_order, r.target_column_order, r.status) == (F, ["id", "name", "age"], ["id", "age", "name"], F)
    r = one(a, b, validate_column_order=False)
    assert r.column_order_status == S and r.status == P


def test_statistics(spark, people):
    changed = frame(spark, [(k, None if k % 4 == 0 else "same") for k in range(19)], ID, NAME)
    r = one(people, changed)
    assert (r.row_count_source, r.row_count_target, r.row_count_difference, r.row_count_status) == (20, 19, -1, F)
    name, number = {c.column: c for c in r.columns}["name"], {c.column: c for c in r.columns}["id"]
    assert (name.source_null_count, name.target_null_count, name.null_count_status) == (4, 5, F)
    assert (name.source_distinct_count, name.target_distinct_count, name.distinct_count_status, name.min_max_status) == (16, 1, F, S)
    assert (number.source_max, number.target_max, number.min_max_status) == ("19", "18", F)


def test_count_only_leaves_statistics_out(people):
    r = one(people, people, data_compare_mode=Mode.COUNT_ONLY)
    assert (r.null_counts_status, r.distinct_counts_status, r.min_max_status, r.row_count_status, r.status) == (S, S, S, P, P)


def test_empty_tables_pass(spark):
    r = one(frame(spark, [], ID, NAME), frame(spark, [], ID, NAME), primary_keys={"people": ["id"]}, data_compare_mode="FULL")
    assert r.status == P and r.columns[0].source_null_count == 0 and r.data.row_hash_mismatch_percentage == 0.0


def test_one_failing_table_does_not_touch_the_others(people):
    class Partly(FrameCatalogs):
        def table(self, catalog, schema, table):
            if table == "orders":
                raise RuntimeError("no rights")
            return super().table(catalog, schema, table)

    tables = {"bronze": {"people": people, "orders": people}}
    r = CatalogComparison(Partly({"a": tables, "b": tables})).validate(CatalogRequest("a", "b"))
    by = {t.table: t for t in r.schemas[0].tables}
    assert (by["orders"].status, by["people"].status, r.status) == (E, P, E) and "no rights" in by["orders"].error
    assert (r.summary.error_tables, r.summary.failed_tables, r.summary.passed_tables) == (1, 1, 1)


@pytest.mark.parametrize(
    "statuses, want",
    [([], S), ([None], S), ([P, P], P), ([P, F], F), ([F, E], E), ([S, S], S), ([P, S], P)],
)
def test_roll_up(statuses, want):
    assert overall(statuses) == want


def test_data_needs_a_key(people):
    r = one(people, people, data_compare_mode="FULL")
    assert r.data.status == S and r.data.note
    assert one(people, people, primary_keys={"people": ["nope"]}, data_compare_mode="FULL").data.status == E


def test_key_lookup_prefers_the_full_name():
    r = CatalogRequest("a", "b", primary_keys={"s.t": [], "t": "k", "u": ["x"]})
    assert r.keys_of("s", "t") == ["k"] and r.keys_of("s", "v") == []


@pytest.mark.parametrize("mode", ["STATISTICS", "HASH", "FULL"])
def test_rows(spark, mode):
    a = frame(spark, [(1, "a"), (2, "b"), (3, "c"), (4, None)], ID, NAME)
    b = frame(spark, [(1, "a"), (2, "z"), (4, "d"), (5, "e")], ID, NAME)
    d = one(a, b, primary_keys={"bronze.people": ["ID"]}, data_compare_mode=mode).data
    assert (d.status, d.row_hash_mismatch_count, d.row_hash_mismatch_percentage) == (F, 4, 80.0)
    assert [(m.primary_key, m.status) for m in d.row_hash_mismatches] == [("2", "MISMATCH"), ("3", "MISSING_IN_TARGET"), ("4", "MISMATCH"), ("5", "MISSING_IN_SOURCE")]
    if mode == "STATISTICS":
        assert d.changed_rows is None
        return
    assert (d.source_only_rows, d.target_only_rows, d.changed_rows) == (1, 1, 2)
    assert d.sample_source_only == ([{"id": 3}] if mode == "FULL" else [])
    assert [(c.primary_key, c.mismatch_column, c.source_value, c.target_value) for c in d.sample_changed_detail] == [({"id": 2}, "name", "b", "z"), ({"id": 4}, "name", None, "d")]


def test_request_checks():
    for bad in ({"max_sample_rows": 0}, {"max_sample_rows": 1001}, {"data_compare_mode": "ALL"}):
        with pytest.raises(ValueError):
            CatalogRequest("a", "b", **bad)
    with pytest.raises(ValueError):
        CatalogRequest("", "b")
    assert CatalogRequest("a", "b", ignore_columns=None).ignore_columns == []
