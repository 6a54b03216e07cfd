"""What the operators share: reading tables, shared scratch tables, Arrow helpers, connected components."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lists that collect the scratch tables written in the blocks at hand, the innermost last.
_OWNERS: ContextVar[tuple[list[str], ...]] = ContextVar("owners", default=())


#: About so many bytes go to a Python worker at a time, so that long texts need no more memory than short ones.
BATCH_BYTES = 8 << 20
#: With this setting Spark deletes the shuffle files of a query when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this machine's files import the package (a cluster gets it by --py-files), and bound their batches."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(limit, BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if root not in sys.path:
        sys.path.append(root)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set, one of our own, on one machine only: a cluster must name one that all share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='parity-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder. What is written there goes when the innermost ``owned`` block ends, and when the application does
    in any case."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if owners := _OWNERS.get():
        owners[-1].append(path)
    return path


def materialize(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write ``df`` below the shared scratch folder and read it back: cuts lineage, and survives lost executors. Its shuffle files go when
    it is written, as nothing reads them again.

    ``narrow``, for tables of short rows: four tasks a core write it at most, each several partitions in turn, as each file costs a few processes
    and calls to the store whatever its size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "parity")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(4 * max(2, spark.sparkContext.defaultParallelism)) if narrow else df).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of scratch tables that are written in the block."""
    tables: list[str] = []
    token = _OWNERS.set((*_OWNERS.get(), tables))
    try:
        yield tables
    finally:
        _OWNERS.reset(token)


@contextmanager
def owned(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables that are written in the block belong to it and are deleted at its end, those of others never. A DataFrame made in
    the block must be used up in it, or what it still reads be taken off the list that the block is given."""
    with collected() as tables:
        try:
            yield tables
        finally:
            for path in tables:
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after which a worker, which goes on to other tasks, gives back the memory that it no longer uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ..., so that names made here clash with none, and the old names."""
    names = df.columns
    return df.toDF(*[f"c{k}" for k in range(len(names))]), names


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without making Python strings."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def as_bytes_or_empty(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in as_bytes(column)]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst long): root is the smallest node that it reaches.

    Alternating large-star and small-star rounds, each written to the shared folder, until nothing changes. Both are joins and
    partial aggregates by node, so a node with very many links is split by adaptive skew handling and
    never gathered in one task. Links and components stay on the executors; the driver sees two numbers a round.
    """
    spark = edges.sparkSession

    def signature(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
        return row["n"], row["h"]

    def one_round(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()

    with owned(spark) as tables:
        e = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), narrow=True)
        before = signature(e)
        while before[0]:
            e = materialize(one_round(e), narrow=True)
            for path in tables[:-1]:
                delete(spark, path)
            del tables[:-1]
            now = signature(e)
            if now == before:
                break
            before = now
        if tables:
            rest = tables.pop()  # what the result reads; it goes to the block around
            if len(owners := _OWNERS.get()) > 1:
                owners[-2].append(rest)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
