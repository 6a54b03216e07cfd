"""All pairs of texts whose sets of shingles have a Jaccard similarity of 4/5 or more: prefix filtering, then the sets themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parity.llm._base import as_bytes_or_empty, lean, materialize

SEED = 42
#: Of 1 / SAMPLE of the texts, shingles that stand in HOT or more come last in the order of prefixes, at most MOST_HOT of them.
#: Every order finds all pairs; a good one has few texts at each shingle.
SAMPLE, HOT, MOST_HOT = 8, 4, 1 << 18
ROWS_AT_ONCE = 1 << 20
#: So many ids of texts at most (8 bytes each) are sent to all executors to look their texts up.
SENT = 1 << 20
CHUNK = 1 << 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """64-bit hashes of the shingles of ``width`` words, with repeats; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, ">u8")
    shingles = (b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))
    digest, parts = xxhash.xxh64_digest, []
    while part := b"".join([digest(x, SEED) for x in islice(shingles, CHUNK)]):
        parts.append(part)
    return np.frombuffer(b"".join(parts), ">u8")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, width).astype(np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 4/5 or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b)) > 0


def sketch(own: np.ndarray) -> bytes:
    """How many hashes stand in each of 64 ranges, 255 at most: of two sets these differ in sum by no more than the sets do."""
    return np.minimum(np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes()


def fine_sketch(own: np.ndarray) -> bytes:
    """As ``sketch``, with a power of two of ranges, the least with four hashes or fewer a range on average; 64 at least."""
    bits = max(6, (-(-len(own) // 4) - 1).bit_length())
    return np.minimum(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_fit(n: int, m: int, a: bytes, b: bytes) -> bool:
    """Whether the fine sketches of two sets of n and m hashes leave room for 4/5. Ranges of the finer one are added up, and capped again."""
    ranges = min(len(a), len(b))
    one, two = (np.minimum(np.frombuffer(x, np.uint8).reshape(ranges, -1).sum(axis=1, dtype=np.int64), 255) for x in (a, b))
    return 9 * int(np.abs(one - two).sum()) <= n + m


def prefix(own: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What two similar sets share at least one of: all but the last 4/5 (less one) in the order of hashes, those in ``hot`` last."""
    n = len(own)
    p = n - -(-4 * n // 5) + 1
    if n and len(hot):
        late = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own[:p] if n else own


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (token, d): the rows, each once, at shingles that more than one text has."""

    def made(token: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.r_[True, (token[1:] != token[:-1]) | (d[1:] != d[:-1])]
        token, d = token[new], d[new]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        sizes = np.diff(np.r_[starts, len(token)])
        many = np.repeat(sizes, sizes) > 1
        yield from _rows(["token", "d"], token[many], d[many])

    yield from _by_group(batches, made)


def _rows(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in columns], names)


def possible(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches leave room for 4/5: similar sets differ in a ninth of n + m at most."""
    fits = 4 * np.maximum(n, m) <= 5 * np.minimum(n, m)
    return fits & (9 * np.abs(a.astype(np.int16) - b).sum(axis=1, dtype=np.int64) <= n + m)


def _sketches(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), np.uint8).reshape(-1, 64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (token, d, n, sketch): the first text at each shingle with each other one that may be similar."""

    def made(token: np.ndarray, d: np.ndarray, n: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _sketches(packed)
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        first = np.repeat(starts, np.diff(np.r_[starts, len(token)]))
        for k in range(0, len(token), 50_000):
            at = np.arange(k, min(k + 50_000, len(token)))
            at = at[at != first[at]]
            at = at[possible(n[first[at]], n[at], own[first[at]], own[at])]
            pairs = np.unique(np.stack([d[first[at]], d[at]], axis=1), axis=0)
            yield from _rows(["d", "e"], pairs[:, 0], pairs[:, 1])

    yield from _by_group(batches, made)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (token, label, d, n, sketch): the pairs with different labels at each shingle that may be similar. Pairs that can't be are
    seen by vector operations only and never become rows."""

    def made(token: np.ndarray, label: np.ndarray, d: np.ndarray, n: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _sketches(packed)
        ends = np.r_[np.flatnonzero(token[1:] != token[:-1]) + 1, len(token)]
        runs = np.r_[np.flatnonzero((token[1:] != token[:-1]) | (label[1:] != label[:-1])) + 1, len(token)]
        at = np.arange(len(token))
        end, after = ends[np.searchsorted(ends, at, "right")], runs[np.searchsorted(runs, at, "right")]
        lag = 1
        alive = np.flatnonzero(at + 1 < end)
        while len(alive):  # each row with the one that is ``lag`` places on
            for k in range(0, len(alive), 50_000):
                i = alive[k : k + 50_000]
                i = i[i + lag >= after[i]]
                j = i + lag
                fits = possible(n[i], n[j], own[i], own[j])
                i, j = i[fits], j[fits]
                yield from _rows(["d", "e"], np.minimum(d[i], d[j]), np.maximum(d[i], d[j]))
            lag += 1
            alive = alive[alive + lag < end[alive]]

    yield from _by_group(batches, made)


def _by_group(batches: Iterator[pa.RecordBatch], made: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``made`` of the columns of about ROWS_AT_ONCE rows at a time, never splitting the rows of one first column."""
    rest: list[tuple] = []
    waiting = 0
    for batch in batches:
        if batch.num_rows:
            rest.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            waiting += batch.num_rows
        if waiting >= ROWS_AT_ONCE:
            columns = [np.concatenate(x) for x in zip(*rest)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last group may go on
            if cut:
                yield from made(*(c[:cut] for c in columns))
            rest = [tuple(c[cut:] for c in columns)]
            waiting = 0
    if rest:
        yield from made(*(np.concatenate(x) for x in zip(*rest)))


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("n", "m", "fine", "other"))
        yield batch.select(["d", "e"]).filter(pa.array([may_fit(*x) for x in zip(*columns)], pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
        yield batch.select(["d", "e"]).filter(pa.array([similar(a, b) for a, b in zip(*sets)], pa.bool_()))


def similar_texts(texts: DataFrame, width: int, sketches: DataFrame, labels: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(d, e) links that, with those that ``labels`` knows, join all pairs of similar texts to the right components.

    ``texts`` has d (long, one for each different text) and text, ``sketches`` d with the size (n), the sketch and the fine sketch (fine) of
    its set, which rule out most pairs before any text moves. ``labels`` gets links and returns (d, label) of all texts, by the
    components that these links and its own make. Texts at a shingle are paired with one of them first; then those that no links join
    yet are compared with each other by size and sketch within the task, and only pairs that may be similar become rows. Every
    pair is checked against its sets.
    """
    spark = texts.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_of = as_bytes_or_empty(batch.column(0))
            for k in range(0, len(texts_of), 200):
                tokens = np.concatenate([shingle_set(x, width) for x in texts_of[k : k + 200]])
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], ["token"])

    counted = texts.where(F.pmod("d", F.lit(SAMPLE)) == 0).select("text").mapInArrow(lean(sampled), "token long").groupBy("token").count()
    found = counted.where(F.col("count") >= HOT).orderBy(F.desc("count"), "token").limit(MOST_HOT).select("token").toArrow()
    hot = spark.sparkContext.broadcast(np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(dict(zip(batch.column(0).to_pylist(), as_bytes_or_empty(batch.column(1)))).items())
            for k in range(0, len(own), 200):
                ids, firsts = [d for d, _ in own[k : k + 200]], [prefix(shingle_set(x, width), hot.value) for _, x in own[k : k + 200]]
                columns = [np.concatenate(firsts).view(np.int64), np.repeat(np.array(ids, np.int64), [len(p) for p in firsts])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "d"])

    placed = texts.select("d", "text").mapInArrow(lean(prefixes), "token long, d long")
    met = placed.repartition(n_parts, "token").sortWithinPartitions("token", "d").mapInArrow(lean(_crowds), "token long, d long")
    met = materialize(met, narrow=True)  # sketches are several times wider, so they join for each use instead of being written
    fine = sketches.select("d", "n", "fine")
    sketches = sketches.select("d", "n", "sketch")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), as_bytes_or_empty(batch.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([shingle_set(x, width).tobytes()], pa.binary())], ["d", "own"])

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.distinct(), narrow=True)
        both = pairs.join(fine, "d").join(fine.toDF("e", "m", "other"), "e")
        pairs = materialize(both.mapInArrow(lean(_fitting), "d long, e long"), narrow=True)
        wanted = materialize(pairs.select("d").union(pairs.select("e")).distinct(), narrow=True)
        if wanted.count() <= SENT:  # else both sides are shuffled
            wanted = F.broadcast(wanted)
        sets = materialize(texts.join(wanted, "d", "left_semi").dropDuplicates(["d"]).select("d", "text").mapInArrow(lean(packed), "d long, own binary"))
        others = sets.toDF("e", "other")
        return materialize(pairs.join(sets, "d").join(others, "e").select("d", "e", "own", "other").mapInArrow(lean(_verified), "d long, e long"), narrow=True)

    by_token = met.join(sketches, "d").select("token", "d", "n", "sketch").repartition(n_parts, "token")
    links = checked(by_token.sortWithinPartitions("token", "d").mapInArrow(lean(_stars), "d long, e long"))
    labelled = met.join(labels(links).join(sketches, "d"), "d").select("token", "label", "d", "n", "sketch")
    rest = labelled.repartition(n_parts, "token").sortWithinPartitions("token", "label", "d").mapInArrow(lean(_across), "d long, e long")
    return links.unionByName(checked(rest))
