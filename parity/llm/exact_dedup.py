"""Exact dedup: local combining, then salted digest groups, then salt winners, with full content compared throughout."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parity.llm._base import as_bytes_or_empty, lean, materialize, read, ship

#: Deleted before texts are compared: [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"
#: A task holds at most so many normalised bytes, or rows, before it hands its local groups on.
WINDOW_BYTES = 48 << 20
WINDOW_ROWS = 200_000

_LOCAL = "lid long, digest binary, content binary, n long, neg_len long, id_null int, best_id long, best_at int, ids array<long>"


def _local_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal texts within a bounded window of this task's rows."""
    part, made = TaskContext.get().partitionId(), 0
    packer = zstandard.ZstdCompressor(level=1)
    groups: dict[bytes, list[list]] = {}
    held = rows = 0
    names = [x.strip().split(" ")[0] for x in _LOCAL.split(", ")]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal made, held, rows
        out: list[tuple] = []
        for digest, same in groups.items():
            for content, order, at, ids in same:
                out.append(((part << 36) + made, digest, packer.compress(content), len(ids), order[0], order[1], ids[at], at, ids))
                made += 1
        for k in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 2000]), types)], names)
        groups.clear()
        held = rows = 0

    for batch in batches:
        lengths = pc.utf8_length(batch.column(1)).to_pylist()
        for doc, text, n in zip(batch.column(0).to_pylist(), as_bytes_or_empty(batch.column(1)), lengths):
            content = text.translate(None, WHITE)
            order = (-(n or 0), int(doc is None), doc or 0)
            same = groups.setdefault(hashlib.sha256(content).digest(), [])
            for group in same:
                if group[0] == content:
                    if order < group[1]:
                        group[1], group[2] = order, len(group[3])
                    group[3].append(doc)
                    break
            else:
                same.append([content, order, 0, [doc]])
                held += len(content)
            rows += 1
            if held > WINDOW_BYTES or rows >= WINDOW_ROWS:
                yield from flush()
    yield from flush()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting spaces and the controls 9 to 13; a null text is empty.
    Of equal texts the row with the most code points stays, then the smallest doc_id (null ids last).
    Of repeated rows (same id, same text) exactly one is kept; all of them name it in keep_id.
    An empty table gives no rows; other columns of ``docs`` are not looked at.

    1. Each task groups its own rows (bounded windows), comparing digests and then contents. A hot text
       leaves a task once per window, with the ids of its rows, so from here on it weighs little.
    2. Groups of one digest meet within ``salts`` salts, by digest and content.
    3. The winners of the salts meet, again by digest and content, and the decision goes back by group number.

    Contents travel compressed at one fixed setting: equal contents give equal bytes, and equal bytes mean equal contents.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local = materialize(rows.mapInArrow(lean(_local_groups), _LOCAL))

    order = F.struct("neg_len", "id_null", "best_id", "lid", "best_at")
    salted = Window.partitionBy("digest", "salt", "content")
    one = materialize(
        local.withColumn("salt", F.pmod(F.xxhash64("lid"), F.lit(salts)).cast("int"))
        .withColumn("sid", F.min("lid").over(salted))
        .withColumn("sn", F.sum("n").over(salted))
        .withColumn("best", F.min(order).over(salted))
        .select("lid", "sid", "digest", "ids", F.expr("if(lid = sid, content, null)").alias("content"), "sn", "best")
    )
    whole = Window.partitionBy("digest", "content")
    final = (
        one.where("lid = sid")
        .withColumn("size", F.sum("sn").over(whole))
        .withColumn("win", F.min("best").over(whole))
        .select(F.col("sid").alias("gid"), "size", "win")
    )
    return (
        one.join(final, F.col("sid") == F.col("gid"))
        .select(F.posexplode("ids").alias("at", "doc_id"), "lid", "digest", "size", "win")
        .select(
            "doc_id",
            F.col("win.best_id").alias("keep_id"),
            F.col("size").alias("group_size"),
            ((F.col("win.lid") == F.col("lid")) & (F.col("win.best_at") == F.col("at"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), r AS (
  SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""

QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {"op1_exact_dedup": ORACLE}
