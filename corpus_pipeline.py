"""From documents to packed sequences: language ID, line dedup, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir), where docs is a written table with the columns of documents, and returns a
DataFrame; all but the last return the columns of their docs. As docs is written, the scratch tables of the stage before
it are deleted when a stage begins; those of other calls never are.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.llm._base import collected, delete, read, scratch_path, ship
from parity.llm._vocab import vocabulary
from parity.llm.language_id import keep_languages
from parity.llm.line_dedup import line_dedup
from parity.llm.packing import pack
from parity.llm.secret_scan import redact
from parity.llm.simhash import keep_one_of_each

#: Bits a byte, twice those of bytes at random: a text that takes so many in every learned language, by escape after escape, is in none.
MOST_BITS = 16.0
#: Words of a shingle of the near-dedup stage.
SHINGLE = 5


#: Scratch tables of the last stage that this thread has called.
_BEFORE: ContextVar[tuple[str, ...]] = ContextVar("before", default=())


def _stage(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(work)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        for path in _BEFORE.get():
            delete(spark, path)
        with collected() as tables:
            out = work(spark, docs, sf_dir)
        _BEFORE.set(tuple(tables))
        return out

    return call


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars after a change of text, where docs has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, texts without a letter, and texts that no learned language codes below MOST_BITS a byte go; all others stay, and
    a language that is missing is filled in with the predicted one."""
    return keep_languages(docs, MOST_BITS)


@_stage
def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier line go, and documents that lose all their lines by it."""
    return _counted(line_dedup(docs, counts=False, emptied=False))


@_stage
def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by fingerprints, or by a similarity of five-word shingles of 0.8 or more, the row with the
    smallest doc_id stays."""
    return keep_one_of_each(docs, width=SHINGLE)


@_stage
def stage_secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the scan finds is masked; all documents stay."""
    return _counted(redact(docs))


@_stage
def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", stage_language_id),
    ("line dedup", stage_line_dedup),
    ("SimHash near-dedup", stage_near_dedup),
    ("secret scans", stage_secret_scan),
    ("packing", stage_packing),
]

#: The first stage learns a model, which SQL can't express; tests compare every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What each but the last returns is written to the shared folder and read again."""
    docs, written = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if written:
            delete(spark, written)
        written = path
    return STAGES[-1][1](spark, docs, sf_dir)
