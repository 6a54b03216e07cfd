"""Edge semantics of the operators, and the comparison of frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.functions.cells import compatible, differs, is_ordered, row_hash
from parity.model import CompareRequest, Outcome
from parity.operators import clean, diff, stats
from parity.operators.schema import column_sets
from parity.plans.engine import compare_frames


def classified(a, b, keys=("k",), values=("x", "y"), **more):
    return {r.k: r.status for r in diff.classify(a, b, list(keys), list(values), **more).collect()}


def df(spark, rows, schema="k int, x string, y string"):
    return spark.createDataFrame(rows, schema)


def test_a_value_that_moves_between_null_columns_is_seen(spark):
    assert classified(df(spark, [(1, "a", None)]), df(spark, [(1, None, "a")])) == {1: "MISMATCH"}


def test_strict_hashes_tell_separators_apart_and_plain_ones_do_not(spark):
    a, b = df(spark, [(1, "a||b", "c")]), df(spark, [(1, "a", "b||c")])
    h = lambda d, strict: d.select(row_hash(d, ["x", "y"], strict).alias("h")).first().h
    assert h(a, False) == h(b, False) and h(a, True) != h(b, True)
    assert classified(a, b) == {1: "MISMATCH"}


def test_null_keys_are_equal_and_can_be_left_out(spark):
    a, b = df(spark, [(None, "a", "b")]), df(spark, [(None, "a", "c")])
    assert classified(a, b) == {None: "MISMATCH"} and classified(a, b, null_safe=False) == {None: "MATCH"}


def test_rows_of_repeated_keys_are_compared_as_multisets(spark):
    a, b = df(spark, [(1, "a", "b"), (1, "a", "b"), (1, "z", "b")]), df(spark, [(1, "a", "b"), (1, "z", "b")])
    (r,) = diff.classify(a, b, ["k"], ["x", "y"]).collect()
    assert (r.source_rows, r.target_rows, r.status) == (3, 2, "MISMATCH")
    assert classified(a, a.orderBy("x", ascending=False)) == {1: "MATCH"} == classified(a.union(b), b.union(a))
    # each side holds a row twice: neither counts nor greatest hashes alone tell these apart
    rows = [(1, str(v), "y") for v in (103, 503)], [(1, str(v), "y") for v in (303, 503)], [(1, "103", "y")] * 2, [(1, "503", "y")] * 2
    for x in rows:
        for y in rows:
            want = "MATCH" if x == y else "MISMATCH"
            assert classified(df(spark, x), df(spark, y)) == {1: want}
            assert [r.status for r in diff.classify_hashes(df(spark, x), df(spark, y), ["k"], ["x", "y"]).collect()] == [want]


def test_cells_of_repeated_keys(spark):
    a = df(spark, [(1, "same", "s"), (1, "same", "s"), (1, "p", "q"), (2, "x", "y"), (None, "m", "n"), (None, "m", "n")])
    b = df(spark, [(1, "same", "s"), (1, "same", "s"), (1, "P", "q"), (2, "x", "Y"), (None, "m", "n"), (None, "M", "n")])
    want = [(None, "x", "m", "M"), (1, "x", "p", "P"), (2, "y", "y", "Y")]
    got = diff.changed_cells(a, b, ["k"], ["x", "y"]).orderBy("k", "column").collect()
    assert [tuple(r)[:4] for r in got] == want
    more = df(spark, [(1, str(k), "") for k in range(40)]), df(spark, [(1, str(k), "") for k in range(20, 70)])
    assert diff.changed_cells(*more, ["k"], ["x", "y"]).count() == 20  # 20 pairs; the 10 rows that are left over have none
    r = compare_frames(a, b, request(primary_keys="k"))
    assert (r.status, r.value_mismatches, r.matched_rows) == (Outcome.FAIL, 3, 3) and len(r.sample_mismatches) == 3
    moved = [(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "a")], [(1, 1, "b"), (1, 2, "a"), (2, 1, "a"), (2, 2, "b")]
    x, y = (spark.createDataFrame(rows, "k int, v int, w string") for rows in moved)
    assert compare_frames(x, y, request(primary_keys="k")).status == Outcome.FAIL


def test_a_survey_shuffles_both_tables_once(spark):
    a, b = (spark.range(1000).select((F.col("id") + d).alias("k"), (F.col("id") % 7 * m).alias("x")) for d, m in ((0, 1), (10, 2)))
    classes = diff.classify(a, b, ["k"], ["x"])
    bad = F.col("status") != diff.MATCH
    by, found = diff.survey(classes, ["k"], {"bad": (bad, 5), "gone": (F.col("status") == diff.MISSING_IN_TARGET, 3)})
    counts = {r["status"]: r["count"] for r in classes.groupBy("status").count().collect()}
    assert {s: r["n"] for s, r in by.items()} == counts
    frame = diff.survey_frame(classes, ["k"], {"bad": (bad, 5)})
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("Range (") == 2  # each table is read and shuffled once
    assert [r["k"] for r in found["bad"]] == [0, 1, 2, 3, 4] and [r["k"] for r in found["gone"]] == [0, 1, 2]


def test_only_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert {r.k: r.status for r in diff.classify(a, b, ["k"], []).collect()} == {1: "MISSING_IN_TARGET", 2: "MATCH", 3: "MISSING_IN_SOURCE"}


def test_missing_key_column_is_an_error(spark):
    with pytest.raises(ValueError, match="nope"):
        diff.classify(df(spark, []), df(spark, []), ["nope"], ["x"])


def test_swap_turns_missing_into_extra(spark):
    a, b = df(spark, [(k, "x", None) for k in range(7)]), df(spark, [(k, "x", None) for k in range(4, 15)])
    x, y = diff.keyed_presence(a, b, ["k"]).first(), diff.keyed_presence(b, a, ["k"]).first()
    assert (x.matched, x.missing, x.extra) == (3, 4, 8) == (y.matched, y.extra, y.missing)


def test_keyless_rows_with_and_without_copies(spark):
    a, b = df(spark, [(1, "a", None)] * 2 + [(2, "b", "c")]), df(spark, [(1, "a", None)])
    assert tuple(diff.keyless_presence(a, b, a.columns).first()) == (2, 1, 0)
    assert tuple(diff.keyless_presence(a, b, a.columns, multiset=True).first()) == (1, 2, 0)


@pytest.mark.parametrize(
    "kind_a, kind_b, a, b, want",
    [
        ("double", "double", 1.0, 1.0 + 5e-10, False), ("double", "double", 1.0, 1.0 + 2e-9, True), ("double", "double", float("nan"), float("nan"), False),
        ("bigint", "bigint", 2**60, 2**60 + 1, True), ("int", "double", 1, 1.0, False), ("string", "int", "1", 1, False), ("string", "string", None, None, False),
        ("string", "string", None, "", True), ("double", "double", float("inf"), float("inf"), False),
        ("timestamp_ntz", "timestamp_ntz", dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 11), True), ("date", "timestamp_ntz", dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 11), False),
    ],
)
def test_cells(spark, kind_a, kind_b, a, b, want):
    d = spark.createDataFrame([(a, b)], f"a {kind_a}, b {kind_b}")
    assert d.select(differs(F.col("a"), F.col("b"), d.schema["a"].dataType, d.schema["b"].dataType).alias("d")).first().d is want


def test_a_change_below_the_tolerance_gives_all_columns(spark):
    a, b = spark.createDataFrame([(1, 1.0, "s")], "k int, x double, y string"), spark.createDataFrame([(1, 1.0 + 1e-12, "s")], "k int, x double, y string")
    assert [r["column"] for r in diff.changed_cells(a, b, ["k"], ["x", "y"]).orderBy("column").collect()] == ["x", "y"]
    assert diff.changed_cells(a, b, ["k"], ["x", "y"], all_if_none=False).count() == 0


def test_types():
    assert compatible(T.IntegerType(), T.DoubleType()) and not compatible(T.ShortType(), T.IntegerType()) and not compatible(T.DateType(), T.StringType())
    assert is_ordered(T.DecimalType(10, 2)) and not is_ordered(T.DayTimeIntervalType()) and not is_ordered(T.StringType())


def test_nested_columns(spark):
    schema = "k int, m map<string,int>, a array<struct<p:int,q:map<int,string>>>"
    a = spark.createDataFrame([(1, {"x": 1, "y": 2}, [(1, {1: "a"})])], schema)
    b = spark.createDataFrame([(1, {"y": 2, "x": 1}, [(1, {1: "a"})])], schema)
    assert classified(a, b, values=("m", "a")) == {1: "MATCH"}
    s = {r["column"]: r for r in stats.column_statistics(a).collect()}
    assert (s["m"]["distinct_count"], s["m"]["min_value"], s["k"]["min_value"]) == (1, None, "1")


def test_names_with_dots_and_ticks(spark):
    a = spark.createDataFrame([(1, "x")], "`a.b` int, `c``d` string")
    assert diff.classify(a, a, ["a.b"], ["c`d"]).first().status == "MATCH"
    assert {r["column"] for r in stats.column_statistics(a).collect()} == {"a.b", "c`d"}


def test_cleaning_keeps_nulls_and_words_that_look_like_them(spark):
    d = spark.createDataFrame([(1, "\t A\xa0 ", None), (2, "nan", "None")], "k int, x string, y string")
    got = [tuple(r) for r in clean.clean_texts(d, lower=True).orderBy("k").collect()]
    assert got == [(1, "a", None), (2, "nan", "none")]


def test_column_sets():
    s = column_sets(["ID", "Name", "x"], ["id", "name", "Y"], ignore=["X"])
    assert (s.common, s.missing, s.extra) == ([("ID", "id"), ("Name", "name")], [], ["y"])
    s = column_sets(["ID", "id"], ["id"], case_sensitive=True)
    assert (s.common, s.missing) == ([("id", "id")], ["ID"])


def request(**more):
    return CompareRequest(source_query="s", target_query="t", **more)


def test_frames(spark):
    a = df(spark, [(1, " a ", "p"), (2, "b", None), (3, "c", "r"), (3, "c", "r")])
    b = df(spark, [(1, "a", "p"), (2, "B", None), (4, "d", "s")])
    r = compare_frames(a, b, request(primary_keys="K"))
    assert (r.status, r.matched_rows, r.missing_rows, r.extra_rows, r.source_duplicate_rows, r.target_duplicate_rows) == (Outcome.FAIL, 2, 1, 1, 2, 0)
    assert (r.value_mismatches, [(m["k"], m["column"]) for m in r.sample_mismatches]) == (1, [(2, "x")])
    assert r.duplicate_keys == {"source": [{"k": 3, "n": 2}]}
    assert compare_frames(a, b, request(primary_keys="k", case_sensitive=False)).value_mismatches == 0
    same = compare_frames(a, a, request())
    assert (same.status, same.matched_rows) == (Outcome.PASS, 4)


def test_frames_warn_for_types_and_nulls_alone(spark):
    a, b = spark.createDataFrame([(1, None)], "k int, x string"), spark.createDataFrame([(1, 5)], "k int, x int")
    r = compare_frames(a, b, request(primary_keys="k", compare_values=False))
    assert r.status == Outcome.WARN and r.type_differences and r.null_differences
    with pytest.raises(ValueError):
        compare_frames(a, b, request(primary_keys="nope"))


def test_statistics_read_each_column_once(spark, sf_dir):
    plan = stats.distinct_counts(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey", "o_orderstatus"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint>" in plan and "ReadSchema: struct<o_orderstatus:string>" in plan
