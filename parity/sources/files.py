"""Files and folders as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How files of each ending are read.
READERS = {
    ".parquet": lambda spark, paths: spark.read.parquet(*paths),
    ".pq": lambda spark, paths: spark.read.parquet(*paths),
    ".csv": lambda spark, paths: spark.read.csv(paths, header=True, inferSchema=True),
    ".json": lambda spark, paths: spark.read.option("multiLine", True).json(paths),
    ".jsonl": lambda spark, paths: spark.read.json(paths),
}
#: Rows that decide whether a column of a file counts as nullable.
SAMPLED_ROWS = 1000


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A CSV file with a header. Types are inferred over the whole file: integers with blanks stay integers, ISO dates are dates."""
    return spark.read.csv(path, header=True, inferSchema=infer)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """All files at or below ``path``, sorted; hidden ones and markers are left out."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(path)
    found, it = [], fs.listFiles(where, True)
    while it.hasNext():
        found.append(it.next().getPath().toString())
    below = where.toUri().getPath()
    return sorted(f for f in found if not any(part.startswith((".", "_")) for part in f.split(below, 1)[-1].strip("/").split("/")))


def _ending(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return next((e for e in READERS if name.endswith(e)), "")


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """A file, or all readable files below a folder, with the columns of all; others are left out. Nothing readable is an error.

    Files of one ending are one scan, whatever their number.
    """
    by_ending: dict[str, list[str]] = {}
    for f in list_files(spark, path):
        by_ending.setdefault(_ending(f), []).append(f)
    by_ending.pop("", None)
    if not by_ending:
        raise ValueError(f"nothing that can be read at {path}: known endings are {', '.join(READERS)}")
    frames = []
    for ending, files in sorted(by_ending.items()):
        reader = spark.read.option("mergeSchema", True).parquet(*files) if ending in (".parquet", ".pq") else READERS[ending](spark, files)
        frames.append(reader)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def file_schema(spark: SparkSession, path: str) -> DataFrame:
    """(column_name, data_type, is_nullable) of the first readable file; nullable if one of its first rows has a null."""
    first = next((f for f in list_files(spark, path) if _ending(f)), None)
    if first is None:
        raise ValueError(f"nothing that can be read at {path}")
    df = READERS[_ending(first)](spark, [first])
    row = df.limit(SAMPLED_ROWS).agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(df.columns)]).first()
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), bool(row[k])) for k, f in enumerate(df.schema)], "column_name string, data_type string, is_nullable boolean")
