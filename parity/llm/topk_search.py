"""Exact top-k inner products: blocks of documents in the order of their bounds, scored until no block can reach the k-th score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parity.llm._base import lean, materialize, read, ship

#: Vectors of a block; blocks of a bucket, and queries of a chunk: what one task holds.
BLOCK = 128
GROUP = 64
CHUNK = 4096
#: Integers up to here are exact in floating point, and so are their sums.
EXACT = 1 << 53

_BLOCKS = "part int, blk int, dims int, ids binary, terms binary, high binary, low binary"


def _matrix(column: pa.Array) -> np.ndarray:
    """floor(256 * x) of each component, rows padded with zeros to one length."""
    lists = column.to_pylist()
    width = max([1, *map(len, lists)])
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return np.floor(256.0 * out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward indexes of BLOCK neighbouring vectors, with the largest and the least component of each term."""
    part, made = TaskContext.get().partitionId(), 0
    names = [x.split(" ")[0] for x in _BLOCKS.split(", ")]
    types = [pa.int32()] * 3 + [pa.binary()] * 4
    ids: list[int] = []
    rows: list[np.ndarray] = []

    def close() -> pa.RecordBatch:
        nonlocal made
        width = max(len(r) for r in rows)
        m = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            m[i, : len(r)] = r
        out = (part, made, width, np.array(ids, "<i8").tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes())
        made += 1
        ids.clear()
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types)], names)

    for batch in batches:
        matrix = _matrix(batch.column(1))
        for i, r in zip(batch.column(0).to_pylist(), matrix):
            ids.append(i)
            rows.append(r)
            if len(ids) == BLOCK:
                yield close()
    if ids:
        yield close()


def _better(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly; beyond the exact range of floating point by Python's integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1) < EXACT:
        return a @ b.T
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    return np.array(exact, dtype=object).reshape(len(a), len(b))


def _search(own: np.ndarray, q: np.ndarray, floor: list, stores: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec, score) of the k best of these blocks for each query, pruned by bounds. Scores below ``floor`` aren't wanted."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    # The sum of each term's maximum: a positive query component meets the largest, a negative one the least.
    bound = np.concatenate([_product(up, s[2]) + _product(down, s[3]) for s in stores], axis=1)
    order = np.argsort(-bound, axis=1, kind="stable")
    best = [(np.zeros(0, bound.dtype), np.zeros(0, np.int64))] * len(q)
    kth = [-np.inf if f is None else f for f in floor]
    alive = np.arange(len(q))
    for turn in range(len(stores)):
        # A block whose bound equals the k-th score may still hold a smaller id.
        alive = np.array([i for i in alive if bound[i, order[i, turn]] >= kth[i]], np.int64)
        if not len(alive):
            break
        chosen = order[alive, turn]
        for b in np.unique(chosen):
            who = alive[chosen == b]
            ids, terms = stores[b][:2]
            for i, row in zip(who, _product(q[who], terms)):
                fit = (ids != own[i]) & (row >= kth[i])
                if fit.any():
                    best[i] = _better(np.concatenate([best[i][0], row[fit]]), np.concatenate([best[i][1], ids[fit]]), k)
                    if len(best[i][0]) == k:
                        kth[i] = max(kth[i], best[i][0][-1])
    return np.repeat(own, [len(b[0]) for b in best]), np.concatenate([b[1] for b in best]), np.concatenate([b[0] for b in best])


def topk_search(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query with the other rows: query_id, rank (from 1), vec_id, score.

    Components are floor(256 * x), x as double; scores are exact (and must fit 64 bits); ties go to the smaller id. A row is no
    candidate of its own id. Rows whose id or vector is null, or that hold null or non-finite components, take no part; shorter
    vectors end in zeros. All candidates are given if there are fewer than k. Repeated rows are candidates each; of queries with one id
    the least vector asks. An empty table gives no rows; other columns are not looked at.

    Neighbouring ids form blocks with their terms' extremes. Chunks of the stated queries meet buckets of blocks, and in
    each meeting a query scores blocks in the order of their bounds and stops where these fall below its k-th score. A first pass
    over one bucket for each chunk gives all others a k-th score to start from. A task holds about CHUNK queries and GROUP blocks
    whatever the input; blocks are shuffled once for each chunk, and a query's results are k rows a bucket at most.
    """
    spark = ship(vectors.sparkSession)
    finite = f"""{id_col} is not null and {vector_col} is not null and
        forall({vector_col}, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double))"""
    usable = vectors.where(finite)
    as_rows = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize(as_rows(usable).repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").mapInArrow(lean(_blocks), _BLOCKS))
    queries = as_rows(usable.where(is_query)).groupBy("vec_id").agg(F.min("v").alias("v"))
    chunks, buckets = max(1, -(-queries.count() // CHUNK)), max(1, -(-blocks.count() // GROUP))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
    placed = blocks.withColumn("bucket", F.pmod(F.xxhash64("part", "blk"), F.lit(buckets)).cast("int")).drop("part", "blk")
    result = "query_id long, vec_id long, score long"

    def search(key: tuple, chunk: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        own, rows, floor = [], [], []
        for asked in chunk["asked"]:
            for x in asked:
                own.append(x["vec_id"])
                rows.append(np.floor(256.0 * np.asarray(x["v"], float)))
                floor.append(x["floor"])
        if not own or table.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q = np.zeros((len(rows), max([1, *map(len, rows)])))
        for i, r in enumerate(rows):
            q[i, : len(r)] = r
        stores = [(np.frombuffer(r.ids, "<i8"), np.frombuffer(r.terms).reshape(-1, r.dims), np.frombuffer(r.high)[None], np.frombuffer(r.low)[None]) for r in table.itertuples()]
        found = _search(np.array(own, "int64"), q, floor, stores, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (x.astype("int64") for x in found))))

    def packed(asked: DataFrame) -> DataFrame:
        return asked.groupBy("chunk").agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("asked"))

    def meet(chunk_rows: DataFrame, block_rows: DataFrame) -> DataFrame:
        return chunk_rows.groupBy("chunk", "bucket").cogroup(block_rows.groupBy("chunk", "bucket")).applyInPandas(search, result)

    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    asked = queries.withColumn("floor", F.lit(None).cast("long"))
    if buckets > 1:
        own_bucket = (F.col("chunk") % buckets).cast("int")
        first = meet(
            packed(asked).withColumn("bucket", own_bucket),
            placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).where(F.col("bucket") == own_bucket),
        )
        floors = first.withColumn("rank", F.row_number().over(top)).where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("floor"))
        asked = queries.join(materialize(floors), F.col("vec_id") == F.col("of"), "left").drop("of")
    found = meet(packed(asked).withColumn("bucket", every), placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(read(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op6_topk_search": op6_topk_search}
ORACLES = {"op6_topk_search": ORACLE}
