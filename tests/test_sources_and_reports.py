"""Files, catalogs, reports, the command line and the driver's contract."""

import csv
import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from parity import cli, report
from parity.model import CatalogRequest, Status
from parity.plans import registry
from parity.plans.engine import CatalogComparison, TableComparison
from parity.sources.catalog import FolderCatalogs, FrameCatalogs, SessionCatalogs, quoted
from parity.sources.files import file_schema, read_csv, read_path

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,\n")
    (tmp_path / "in/b.json").write_text(json.dumps([{"id": 3, "extra": True}]))
    (tmp_path / "in/c.jsonl").write_text('{"id": 4}\n')
    (tmp_path / "in/_skip.csv").write_text("no\n")
    (tmp_path / "notes.txt").write_text("no")
    spark.range(5, 6).write.parquet(str(tmp_path / "in/d.parquet"))
    df = read_path(spark, str(tmp_path))
    assert sorted(r.id for r in df.collect()) == [1, 2, 3, 4, 5] and set(df.columns) == {"id", "name", "extra"}
    assert {(r.column_name, r.is_nullable) for r in file_schema(spark, str(tmp_path / "a.csv")).collect()} == {("id", False), ("name", True)}
    assert read_csv(spark, str(tmp_path / "a.csv")).dtypes[0] == ("id", "int")
    with pytest.raises(ValueError):
        read_path(spark, str(tmp_path / "notes.txt"))
    with pytest.raises(FileNotFoundError):
        read_path(spark, str(tmp_path / "none"))


def test_session_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS parity_test")
    spark.range(3).write.mode("overwrite").saveAsTable("parity_test.t")
    try:
        c = SessionCatalogs(spark)
        assert c.has_catalog("SPARK_CATALOG") and not c.has_catalog("nowhere")
        assert "parity_test" in c.schemas("spark_catalog") and c.has_schema("spark_catalog", "Parity_Test")
        assert c.tables("spark_catalog", "parity_test") == ["t"] and c.has_table("spark_catalog", "parity_test", "T")
        assert c.table("spark_catalog", "parity_test", "t").count() == 3
        r = CatalogComparison(c).validate(CatalogRequest("spark_catalog", "spark_catalog", schemas="parity_test"))
        assert r.status == Status.PASS and r.summary.passed_tables == 1
    finally:
        spark.sql("DROP DATABASE parity_test CASCADE")
    assert quoted("a.b", "c`d") == "`a.b`.`c``d`"


@pytest.fixture
def folders(spark, tmp_path):
    for root, n in (("a", 5), ("b", 6)):
        spark.range(n).selectExpr("id", "concat('n', id) AS name").coalesce(1).write.parquet(str(tmp_path / root / "s/t.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "a/s/gone"))
    return {x: str(tmp_path / x) for x in "ab"}


def test_folder_catalogs_and_reports(spark, folders, tmp_path):
    r = CatalogComparison(FolderCatalogs(spark, folders)).validate(CatalogRequest("A", "b", primary_keys={"t": "id"}, data_compare_mode="FULL"))
    assert r.status == Status.FAIL and r.schemas[0].missing_tables == ["gone"]
    rows = report.table_rows(r)
    assert [x[1] for x in rows] == ["gone", "t"] and all(len(x) == len(report.TABLE_HEADERS) for x in rows)
    assert rows[1][16:20] == [1, "20.00%", 1, "16.67%"]
    assert report.row_hash_rows(r)[0][:4] == [1, "s", "t", "5"]
    assert dict(report.summary_metrics(r))["Failed Tables"] == 2
    raw = Path(report.write_csv(r, str(tmp_path / "r.csv"))).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    assert next(csv.reader(raw.decode("utf-8-sig").splitlines())) == list(report.TABLE_HEADERS)
    assert report.as_frame(spark, report.TABLE_HEADERS, rows).count() == 2


def test_rows_of_missing_columns_have_all_cells(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "id int, x int, y int"), spark.createDataFrame([(1, 9, 9)], "id int, x int, z int")
    r = CatalogComparison(FrameCatalogs({"a": {"s": {"t": a}}, "b": {"s": {"t": b}}})).validate(CatalogRequest("a", "b", primary_keys={"t": "id"}, data_compare_mode="FULL"))
    rows = report.column_rows(r)
    assert {x[3] for x in rows} >= {"MISSING_FROM_TARGET", "EXTRA_IN_TARGET"} and all(len(x) == len(report.COLUMN_HEADERS) for x in rows)
    assert [x[2:6] for x in report.mismatch_rows(r)] == [["id=1", "x", "2", "9"]]


def test_a_workbook_needs_its_library(spark, tmp_path):
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        r = CatalogComparison(FrameCatalogs({"a": {}, "b": {}})).validate(CatalogRequest("a", "b"))
        with pytest.raises(RuntimeError, match="openpyxl"):
            report.write_excel(r, str(tmp_path / "r.xlsx"))


def test_command_line(spark, folders, tmp_path, capsys):
    catalogs = FolderCatalogs(spark, folders)
    base = ["validate-catalogs", "--source-catalog", "a", "--target-catalog"]
    assert cli.main([*base, "b", "--mode", "HASH", "--primary-keys", "s.t=id; u = x , y", "--csv", str(tmp_path / "o.csv")], catalogs) == 2
    assert "FAIL  a against b" in capsys.readouterr().out and (tmp_path / "o.csv").exists()
    assert cli.main([*base, "a", "--tables", "t"], catalogs) == 0
    assert cli.main([*base, "b", "--primary-keys", "nokey"], catalogs) == 1 and cli.main([]) == 1
    assert cli.parse_keys("s.t=a,b;; t2=c") == {"s.t": ["a", "b"], "t2": ["c"]}


def test_csv_against_table(spark, tmp_path):
    from parity.model import CompareRequest

    (tmp_path / "a.csv").write_text("id,name\n1, x\n2,y\n")
    spark.createDataFrame([(1, "x"), (2, "z")], "ID int, name string").createOrReplaceTempView("people_t")
    r = TableComparison(spark).compare(CompareRequest.of(str(tmp_path / "a.csv"), "people_t"))
    assert (r.missing_rows, r.extra_rows, r.matched_rows) == (1, 1, 1)
    r = TableComparison(spark).compare(CompareRequest(source_table=str(tmp_path / "a.csv"), target_query="SELECT 1 AS id, 'x' AS name", primary_keys="id"))
    assert (r.missing_rows, r.value_mismatches) == (1, 0)
    with pytest.raises(ValueError):
        CompareRequest(source_table="x")


#: Statuses of orders against its changed copy at the two small sizes.
GOLDEN = {
    "sf0.001": {"MATCH": 1450, "MISMATCH": 34, "MISSING_IN_TARGET": 16, "MISSING_IN_SOURCE": 15},
    "sf0.01": {"MATCH": 14501, "MISMATCH": 344, "MISSING_IN_TARGET": 155, "MISSING_IN_SOURCE": 149},
}


@pytest.mark.parametrize("sf", GOLDEN)
def test_golden_numbers(spark, sf):
    assert {r.status: r.n for r in registry.queries()["row_hash_summary"](spark, f"/root/testdata/{sf}").collect()} == GOLDEN[sf]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_contract(spark):
    assert contract.entry(spark).count() == 4
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    import shutil

    for x in ("parity", "__spark_entry__.py"):
        source = ROOT / x
        if source.is_dir():
            shutil.copytree(source, tmp_path / x, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / x)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
