"""The comparison operators over ``orders`` and a changed copy of it, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.functions.cells import key_pairs, key_text
from parity.operators import clean, diff, schema, stats
from parity.plans import verdict

KEYS = ["o_orderkey"]
VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
COLUMNS = [*KEYS, *VALUES]

#: The changed copy: some rows gone, some new, prices changed, priorities lost.
CHANGED = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1.0 ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 101 = 0
"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders and its changed copy, as one plan each: the copy is a filter and projection of the same scan."""
    source = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kept = source.where(key % 97 != 0).select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.when(key % 89 == 0, F.col("o_totalprice") + 1.0).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate", F.when(key % 83 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    added = source.where(key % 101 == 0).withColumn("o_orderkey", key + 10000000)
    return source, kept.unionByName(added)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH source AS (SELECT * FROM orders), target AS ({CHANGED})\n{sql}" if "WITH" not in sql[:8].upper() else sql
        return f

    return put


_TEXT = " || '||' || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(1) || 'NULL' || chr(1))" for c in sorted(VALUES))
_CLASSIFIED = f"""
SELECT o_orderkey, a.h AS source_hash, b.h AS target_hash,
  CASE WHEN b.h IS NULL THEN 'MISSING_IN_TARGET' WHEN a.h IS NULL THEN 'MISSING_IN_SOURCE' WHEN a.h = b.h THEN 'MATCH' ELSE 'MISMATCH' END AS status
FROM (SELECT o_orderkey, sha256({_TEXT}) AS h FROM source) a FULL JOIN (SELECT o_orderkey, sha256({_TEXT}) AS h FROM target) b USING (o_orderkey)
"""
_DIFFERS = " OR ".join(f"s.{c} IS DISTINCT FROM t.{c}" for c in VALUES)
_CHANGED_KEYS = f"SELECT s.o_orderkey FROM source s JOIN target t USING (o_orderkey) WHERE {_DIFFERS}"


@query("row_hash_classify", _CLASSIFIED)
def row_hash_classify(spark, sf_dir):
    return diff.classify_hashes(*pair(spark, sf_dir), KEYS, VALUES)


@query("row_hash_summary", f"SELECT status, count(*) AS n FROM ({_CLASSIFIED}) GROUP BY status")
def row_hash_summary(spark, sf_dir):
    return diff.status_counts(diff.classify(*pair(spark, sf_dir), KEYS, VALUES))


@query("row_hash_percentage", f"SELECT count(*) AS total_keys, count(*) FILTER (status <> 'MATCH') AS mismatch_count, 100.0::DOUBLE * count(*) FILTER (status <> 'MATCH') / count(*) AS mismatch_percentage FROM ({_CLASSIFIED})")
def row_hash_percentage(spark, sf_dir):
    return diff.mismatch_summary(diff.classify(*pair(spark, sf_dir), KEYS, VALUES))


@query("row_count_parity", "SELECT a.n AS source_rows, b.n AS target_rows, b.n - a.n AS difference, CASE WHEN a.n = b.n THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS n FROM source) a, (SELECT count(*) AS n FROM target) b")
def row_count_parity(spark, sf_dir):
    s, t = (stats.row_count(df) for df in pair(spark, sf_dir))
    both = s.select(F.col("row_count").alias("source_rows")).join(t.select(F.col("row_count").alias("target_rows")))
    return both.select("*", (F.col("target_rows") - F.col("source_rows")).alias("difference"), F.when(F.col("source_rows") == F.col("target_rows"), "PASS").otherwise("FAIL").alias("status"))


def _stats_sql(table: str, columns: list[str], ordered: set[str], tail: str = "") -> str:
    """Extremes go through their own type and are then written as texts, for which only types that both engines write alike are used."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS null_count, count(DISTINCT {c}) AS distinct_count, "
        + (f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value" if c in ordered else "CAST(NULL AS VARCHAR) AS min_value, CAST(NULL AS VARCHAR) AS max_value")
        + f" FROM {table}"
        for c in columns
    )


_ORDERED = {"o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"}


@query("column_stats_orders", _stats_sql("source", COLUMNS, _ORDERED))
def column_stats_orders(spark, sf_dir):
    return stats.column_statistics(pair(spark, sf_dir)[0], COLUMNS)


@query("column_stats_target", _stats_sql("target", COLUMNS, _ORDERED))
def column_stats_target(spark, sf_dir):
    return stats.column_statistics(pair(spark, sf_dir)[1], COLUMNS)


@query("column_stats_lineitem", "WITH x AS (SELECT 1) " + _stats_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"], {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"}))
def column_stats_lineitem(spark, sf_dir):
    return stats.column_statistics(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"])


_SAME = lambda a, b: f"CASE WHEN {a} IS NOT DISTINCT FROM {b} THEN 'PASS' ELSE 'FAIL' END"


@query("column_stats_verdict", f"SELECT a.\"column\", {_SAME('a.null_count', 'b.null_count')} AS null_count_status, {_SAME('a.distinct_count', 'b.distinct_count')} AS distinct_count_status, CASE WHEN a.min_value IS NULL THEN 'SKIPPED' WHEN a.min_value = b.min_value AND a.max_value = b.max_value THEN 'PASS' ELSE 'FAIL' END AS min_max_status FROM ({_stats_sql('source', COLUMNS, _ORDERED)}) a JOIN ({_stats_sql('target', COLUMNS, _ORDERED)}) b USING (\"column\")")
def column_stats_verdict(spark, sf_dir):
    s, t = (stats.column_statistics(df, COLUMNS).alias(k) for k, df in zip("st", pair(spark, sf_dir)))
    same = lambda c: F.when(F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), "PASS").otherwise("FAIL")
    extremes = F.when(F.col("s.min_value").isNull(), "SKIPPED").when((same("min_value") == "PASS") & (same("max_value") == "PASS"), "PASS").otherwise("FAIL")
    return s.join(t, "column").select("column", same("null_count").alias("null_count_status"), same("distinct_count").alias("distinct_count_status"), extremes.alias("min_max_status"))


@query("min_max_parity", f"SELECT \"column\", a.min_value AS source_min, a.max_value AS source_max, b.min_value AS target_min, b.max_value AS target_max FROM ({_stats_sql('source', sorted(_ORDERED), _ORDERED)}) a JOIN ({_stats_sql('target', sorted(_ORDERED), _ORDERED)}) b USING (\"column\")")
def min_max_parity(spark, sf_dir):
    s, t = (stats.min_max(df, sorted(_ORDERED)) for df in pair(spark, sf_dir))
    s = s.select("column", F.col("min_value").alias("source_min"), F.col("max_value").alias("source_max"))
    return s.join(t.select("column", F.col("min_value").alias("target_min"), F.col("max_value").alias("target_max")), "column")


@query("null_count_diff", f"SELECT \"column\", a.null_count AS source_nulls, b.null_count AS target_nulls FROM ({_stats_sql('source', COLUMNS, set())}) a JOIN ({_stats_sql('target', COLUMNS, set())}) b USING (\"column\") WHERE a.null_count <> b.null_count")
def null_count_diff(spark, sf_dir):
    s, t = (stats.null_counts(df, COLUMNS).withColumnRenamed("null_count", n) for df, n in zip(pair(spark, sf_dir), ("source_nulls", "target_nulls")))
    return s.join(t, "column").where("source_nulls <> target_nulls")


@query("source_only_keys", "SELECT o_orderkey FROM source EXCEPT SELECT o_orderkey FROM target")
def source_only_keys(spark, sf_dir):
    return diff.keys_only_in(*pair(spark, sf_dir), KEYS)


@query("target_only_keys", "SELECT o_orderkey FROM target EXCEPT SELECT o_orderkey FROM source")
def target_only_keys(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    return diff.keys_only_in(t, s, KEYS)


@query("key_diff_counts", f"SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM source EXCEPT SELECT o_orderkey FROM target)) AS source_only, (SELECT count(*) FROM (SELECT o_orderkey FROM target EXCEPT SELECT o_orderkey FROM source)) AS target_only, (SELECT count(*) FROM ({_CHANGED_KEYS})) AS changed")
def key_diff_counts(spark, sf_dir):
    c = F.col("status")
    return diff.classify(*pair(spark, sf_dir), KEYS, VALUES).agg(
        F.count_if(c == diff.MISSING_IN_TARGET).alias("source_only"), F.count_if(c == diff.MISSING_IN_SOURCE).alias("target_only"), F.count_if(c == diff.MISMATCH).alias("changed")
    )


@query("changed_rows", _CHANGED_KEYS)
def changed_rows(spark, sf_dir):
    return diff.changed_rows(*pair(spark, sf_dir), KEYS, VALUES)


@query("changed_rows_sample", f"SELECT * FROM ({_CHANGED_KEYS}) ORDER BY o_orderkey LIMIT 50")
def changed_rows_sample(spark, sf_dir):
    return diff.sample(changed_rows(spark, sf_dir), KEYS, 50)


_CELLS = " UNION ALL ".join(
    f"SELECT o_orderkey, '{c}' AS \"column\", CAST(s.{c} AS VARCHAR) AS source_value, CAST(t.{c} AS VARCHAR) AS target_value FROM source s JOIN target t USING (o_orderkey) WHERE "
    + (f"abs(s.{c} - t.{c}) > 1e-9" if c == "o_totalprice" else f"s.{c} IS DISTINCT FROM t.{c}")
    for c in VALUES
)


@query("changed_row_detail", _CELLS)
def changed_row_detail(spark, sf_dir):
    return diff.changed_cells(*pair(spark, sf_dir), KEYS, VALUES).select(*KEYS, "column", "source_value", "target_value")


@query("sampled_row_fetch", f"SELECT * FROM source WHERE o_orderkey IN (SELECT o_orderkey FROM ({_CHANGED_KEYS}) ORDER BY o_orderkey LIMIT 50)")
def sampled_row_fetch(spark, sf_dir):
    return diff.rows_for_keys(pair(spark, sf_dir)[0], changed_rows_sample(spark, sf_dir), KEYS)


_DUPLICATES = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"


@query("duplicate_keys_lineitem", f"WITH d AS ({_DUPLICATES}) SELECT * FROM d")
def duplicate_keys_lineitem(spark, sf_dir):
    return diff.duplicate_keys(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_row_count", f"WITH d AS ({_DUPLICATES}) SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM d")
def duplicate_row_count(spark, sf_dir):
    return diff.duplicate_totals(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_keys_sample", f"WITH d AS ({_DUPLICATES}) SELECT * FROM d ORDER BY l_orderkey, l_linenumber LIMIT 20")
def duplicate_keys_sample(spark, sf_dir):
    return diff.sample(duplicate_keys_lineitem(spark, sf_dir), ["l_orderkey", "l_linenumber"], 20)


@query("keyed_missing_extra", "SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM source INTERSECT SELECT o_orderkey FROM target)) AS matched, (SELECT count(*) FROM (SELECT o_orderkey FROM source EXCEPT SELECT o_orderkey FROM target)) AS missing, (SELECT count(*) FROM (SELECT o_orderkey FROM target EXCEPT SELECT o_orderkey FROM source)) AS extra")
def keyed_missing_extra(spark, sf_dir):
    return diff.keyed_presence(*pair(spark, sf_dir), KEYS)


_PART = "o_custkey, o_orderstatus, o_orderpriority"
_EQUAL = " AND ".join(f"s.{c.strip()} IS NOT DISTINCT FROM t.{c.strip()}" for c in _PART.split(","))


@query("keyless_row_diff", f"SELECT (SELECT count(*) FROM source s WHERE EXISTS (FROM target t WHERE {_EQUAL})) AS matched, (SELECT count(*) FROM source s WHERE NOT EXISTS (FROM target t WHERE {_EQUAL})) AS missing, (SELECT count(*) FROM target t WHERE NOT EXISTS (FROM source s WHERE {_EQUAL})) AS extra")
def keyless_row_diff(spark, sf_dir):
    return diff.keyless_presence(*pair(spark, sf_dir), [c.strip() for c in _PART.split(",")])


@query("keyless_multiset_diff", f"SELECT (SELECT count(*) FROM (SELECT {_PART} FROM source INTERSECT ALL SELECT {_PART} FROM target)) AS matched, (SELECT count(*) FROM (SELECT {_PART} FROM source EXCEPT ALL SELECT {_PART} FROM target)) AS missing, (SELECT count(*) FROM (SELECT {_PART} FROM target EXCEPT ALL SELECT {_PART} FROM source)) AS extra")
def keyless_multiset_diff(spark, sf_dir):
    return diff.keyless_presence(*pair(spark, sf_dir), [c.strip() for c in _PART.split(",")], multiset=True)


@query("clean_trim_lower", "WITH x AS (SELECT c_custkey, ' ' || chr(9) || c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) ELSE '  ' END AS c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer) SELECT c_custkey, lower(regexp_replace(c_name, '^\\s+|\\s+$', '', 'g')) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM x")
def clean_trim_lower(spark, sf_dir):
    key = F.col("c_custkey")
    messy = _table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit(" \t"), "c_name", F.when(key % 2 == 0, "\n").otherwise("  ")).alias("c_name"), F.when(key % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal"
    )
    return clean.clean_texts(clean.drop_ignored(messy, ["C_ACCTBAL"]), trim=True, lower=True)


@query("key_texts", "WITH x AS (SELECT l_orderkey, l_linenumber, any_value(1) AS one FROM lineitem GROUP BY ALL) SELECT l_orderkey || '|' || l_linenumber AS key_text, 'l_orderkey=' || l_orderkey || ', l_linenumber=' || l_linenumber AS key_pairs FROM x")
def key_texts(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber"]
    return _table(spark, sf_dir, "lineitem").select(*keys).distinct().select(key_text(keys).alias("key_text"), key_pairs(keys).alias("key_pairs"))


@query("schema_columns", "WITH x(column_name, data_type, ordinal_position) AS (VALUES ('o_orderkey', 'bigint', 0), ('o_custkey', 'bigint', 1), ('o_orderstatus', 'string', 2), ('o_totalprice', 'double', 3), ('o_orderdate', 'timestamp_ntz', 4), ('o_orderpriority', 'string', 5)) SELECT column_name, data_type, ordinal_position FROM x")
def schema_columns(spark, sf_dir):
    return schema.schema_frame(spark, _table(spark, sf_dir, "orders").schema).drop("is_nullable")


@query("schema_column_diff", "WITH x(\"column\", presence) AS (VALUES ('o_custkey', 'common'), ('o_orderdate', 'common'), ('o_orderkey', 'common'), ('o_orderpriority', 'missing'), ('o_orderstatus', 'common'), ('o_totalprice', 'common'), ('o_comment', 'extra')) SELECT * FROM x")
def schema_column_diff(spark, sf_dir):
    source, target = pair(spark, sf_dir)
    sets = schema.column_sets(source.columns, target.drop("o_orderpriority").withColumn("O_Comment", F.lit("")).columns)
    rows = [*((a, "common") for a, _ in sets.common), *((a, "missing") for a in sets.missing), *((a, "extra") for a in sets.extra)]
    return spark.createDataFrame(rows, "column string, presence string")


@query("column_order", "WITH x(ordinal, source_column, target_column, same) AS (VALUES (0, 'o_orderkey', 'o_custkey', false), (1, 'o_custkey', 'o_orderkey', false), (2, 'o_orderstatus', 'o_orderstatus', true)) SELECT * FROM x")
def column_order(spark, sf_dir):
    source = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    target = source.select("o_custkey", "o_orderkey", "o_orderstatus")
    a, b = schema.order_of_common(source.columns, target.columns, schema.column_sets(source.columns, target.columns))
    return spark.createDataFrame([(k, x, y, x == y) for k, (x, y) in enumerate(zip(a, b))], "ordinal int, source_column string, target_column string, same boolean")


@query("dtype_compare", "WITH x(\"column\", source_type, target_type) AS (VALUES ('o_orderdate', 'timestamp_ntz', 'string'), ('o_orderstatus', 'string', 'int')) SELECT * FROM x")
def dtype_compare(spark, sf_dir):
    source = _table(spark, sf_dir, "orders")
    target = source.withColumns({"o_orderdate": F.col("o_orderdate").cast("string"), "o_custkey": F.col("o_custkey").cast("double"), "o_orderstatus": F.length("o_orderstatus")})
    return spark.createDataFrame([tuple(d.values()) for d in schema.type_differences(source, target, schema.column_sets(source.columns, target.columns))], "column string, source_type string, target_type string")


@query("status_rollup", "WITH x AS (SELECT o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'PASS' WHEN 3 THEN 'SKIPPED' END AS status FROM orders) SELECT o_custkey, CASE WHEN coalesce(bool_or(status = 'ERROR'), false) THEN 'ERROR' WHEN coalesce(bool_or(status = 'FAIL'), false) THEN 'FAIL' WHEN coalesce(bool_or(status = 'PASS'), false) THEN 'PASS' ELSE 'SKIPPED' END AS status FROM x GROUP BY o_custkey")
def status_rollup(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    status = F.when(k == 0, "ERROR").when(k == 1, "FAIL").when(k == 2, "PASS").when(k == 3, "SKIPPED")
    return _table(spark, sf_dir, "orders").select("o_custkey", status.alias("status")).groupBy("o_custkey").agg(verdict.overall_column(F.col("status")).alias("status"))


def _catalog_result(spark, sf_dir):
    from parity.model import CatalogRequest, Mode
    from parity.plans.engine import CatalogComparison
    from parity.sources.catalog import FrameCatalogs

    source, target = pair(spark, sf_dir)
    nation = _table(spark, sf_dir, "nation")
    catalogs = FrameCatalogs({"a": {"tpch": {"orders": source, "nation": nation, "region": _table(spark, sf_dir, "region")}}, "b": {"tpch": {"orders": target, "nation": nation}}})
    return CatalogComparison(catalogs).validate(CatalogRequest("a", "b", primary_keys={"orders": KEYS, "nation": ["n_nationkey"]}, data_compare_mode=Mode.FULL))


_HEAD = f"WITH source AS (SELECT * FROM orders), target AS ({CHANGED}), c AS ({_CLASSIFIED})"


@query("validation_summary", "WITH x(total_schemas, passed_schemas, failed_schemas, total_tables, passed_tables, failed_tables, error_tables, missing_tables, extra_tables) AS (VALUES (1, 0, 1, 2, 1, 1, 0, 1, 0)) SELECT * FROM x")
def validation_summary(spark, sf_dir):
    s = vars(_catalog_result(spark, sf_dir).summary)
    return spark.createDataFrame([tuple(s.values())], ", ".join(f"{k} int" for k in s))


@query("table_report", f"""{_HEAD}
SELECT 'orders' AS table_name, 'FAIL' AS status, (SELECT count(*) FROM source)::VARCHAR AS source_rows, (SELECT count(*) FROM target)::VARCHAR AS target_rows,
  (SELECT count(*) FILTER (status <> 'MATCH') FROM c)::VARCHAR AS row_hash_mismatches
UNION ALL SELECT 'nation', 'PASS', (SELECT count(*) FROM nation)::VARCHAR, (SELECT count(*) FROM nation)::VARCHAR, '0'
UNION ALL SELECT 'region', 'MISSING_FROM_TARGET', '', '', ''""")
def table_report(spark, sf_dir):
    from parity import report

    df = report.as_frame(spark, report.TABLE_HEADERS, report.table_rows(_catalog_result(spark, sf_dir)))
    return df.select(F.col("Source Table").alias("table_name"), F.col("Overall Status").alias("status"), F.col("`Row Count (Src)`").alias("source_rows"), F.col("`Row Count (Tgt)`").alias("target_rows"), F.col("Row Hash Mismatch Count").alias("row_hash_mismatches"))


@query("table_compare", "SELECT 'FAIL' AS status, (SELECT count(*) FROM source) AS source_rows, (SELECT count(*) FROM target) AS target_rows, (SELECT count(*) FROM (SELECT o_orderkey FROM source EXCEPT SELECT o_orderkey FROM target)) AS missing_rows, (SELECT count(*) FROM (SELECT o_orderkey FROM target EXCEPT SELECT o_orderkey FROM source)) AS extra_rows, " + f"(SELECT count(*) FROM ({_CELLS})) AS value_mismatches")
def table_compare(spark, sf_dir):
    from parity.model import CompareRequest
    from parity.plans.engine import compare_frames

    r = compare_frames(*pair(spark, sf_dir), CompareRequest(source_query="orders", target_query="changed", primary_keys=KEYS))
    return spark.createDataFrame([(r.status.value, r.source_row_count, r.target_row_count, r.missing_rows, r.extra_rows, r.value_mismatches)], "status string, source_rows long, target_rows long, missing_rows long, extra_rows long, value_mismatches long")


_PAIRS = "SELECT o_custkey, o_orderstatus, o_orderpriority FROM"


@query("repeated_key_classes", f"""SELECT o_custkey, CASE WHEN b.n IS NULL THEN 'MISSING_IN_TARGET' WHEN a.n IS NULL THEN 'MISSING_IN_SOURCE' WHEN d.n IS NULL THEN 'MATCH' ELSE 'MISMATCH' END AS status
FROM (SELECT o_custkey, count(*) AS n FROM source GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM target GROUP BY 1) b USING (o_custkey)
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM (({_PAIRS} source EXCEPT ALL {_PAIRS} target) UNION ALL ({_PAIRS} target EXCEPT ALL {_PAIRS} source)) GROUP BY 1) d USING (o_custkey)""")
def repeated_key_classes(spark, sf_dir):
    """Customers, of whom each has many orders, by whether their orders are the same rows, each as often."""
    return diff.classify(*pair(spark, sf_dir), ["o_custkey"], ["o_orderstatus", "o_orderpriority"]).select("o_custkey", "status")
