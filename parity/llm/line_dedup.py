"""Line dedup: lines within one edit of an earlier line go, found by a join of deletion variants."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.llm._base import as_bytes, as_bytes_or_empty, lean, materialize, positional, read, ship

#: Windows into which a line is cut: a line first emits its variants without a whole window, and single deletions only
#: within windows in which it agrees with another line outside.
WINDOWS = 4
#: About so many code points are hashed at a time; a longer line is hashed as a whole, in memory in proportion to its length.
CHUNK = 1 << 18
#: Slots in which a task remembers lines whose variants it has emitted. What is forgotten is emitted again, and nothing else.
SLOTS = 1 << 20

_U = np.uint64
_MULTIPLIERS = (_U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A random number for each code point."""
    return _mixed(np.arange(1, 0x110001, dtype=np.uint64))


@lru_cache(maxsize=4)
def _powers(which: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a multiplier and of its inverse, 2^bits of them."""
    m = _MULTIPLIERS[which]
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full((1 << bits) - 1, x, np.uint64))]) for x in (m, _U(pow(int(m), -1, 1 << 64))))


class Hashes:
    """Hashes of stretches of a text (code points), by prefix sums: any stretch, or two joined to one, in constant time."""

    def __init__(self, code_points: np.ndarray, which: int):
        self.power, self.inverse = _powers(which, max(18, int(len(code_points)).bit_length()))
        self.sums = np.zeros(len(code_points) + 1, np.uint64)
        np.cumsum(_letters()[code_points] * self.power[: len(code_points)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def without(self, start: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of start to end without a to b, as if that were one stretch."""
        return self.of(start, a) + self.of(b, end) * self.power[a - start]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def cuts(n: np.ndarray, less: int, place: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a window of lines of n code points begins and ends, if they are cut as if they had ``less`` code points fewer."""
    base = n - less
    return place * base // WINDOWS, (place + 1) * base // WINDOWS + less


def window_keys(hashes: Hashes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row a line: keys of its variants without a window. Two lines within one edit share one: the shorter cuts its windows by its own
    length (places 0 to WINDOWS - 1), and each line also cuts them as if it had one character less (the places after)."""
    n = end - start
    out = np.empty((len(n), 2 * WINDOWS), np.uint64)
    for less in (0, 1):
        for i in range(WINDOWS):
            a, b = cuts(n, less, i)
            key = hashes.without(start, start + a, start + b, end)
            out[:, less * WINDOWS + i] = _mixed(key ^ _mixed(((n - less) * WINDOWS + i).astype(np.uint64)))
    return out


def deletions(text: str, places: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes, hashes, role): the line as it is (0), without one character of a window (1), and the same with its place marked (2).

    ``places`` has a bit for each window."""
    x = code_points(text)
    n = len(x)
    both = [Hashes(x, k) for k in (0, 1)]
    start, end = np.zeros(1, np.int64), np.full(1, n)
    out = [(*(h.of(start, end) for h in both), 0)]
    for less, role in ((0, 2), (1, 1)):
        held = np.zeros(n, bool)
        for i in range(WINDOWS):
            if places >> (less * WINDOWS + i) & 1:
                a, b = cuts(n, less, i)
                held[a:b] = True
        p = np.flatnonzero(held)
        if len(p):
            v = [h.without(start, p, p + 1, end) for h in both]
            out.append((*(_mixed(x ^ _mixed(p.astype(np.uint64) + _U(1))) if role == 2 else x for x in v), role))
    return out


def lines_of(text: bytes) -> list[tuple[int, bytes]]:
    """(number, stripped line) of the lines that aren't blank."""
    return [(k, s) for k, line in enumerate(text.split(b"\n")) if (s := line.strip())]


_LINES = T.StructType([*(T.StructField(c, T.LongType()) for c in ("h1", "h2", "own")), T.StructField("nul", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("doc", "k1")), T.StructField("line", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def _lines(least: int):
    """Of (nul, doc, k1, text): each different line of a document with its 128-bit hash and its place. Where the task hasn't
    met the line lately, also the keys of its variants without a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, met = xxhash.xxh3_128_digest, np.zeros(SLOTS, np.uint64)
        shift = _U(64 - (SLOTS.bit_length() - 1))
        lines: list[bytes] = []
        digests: list[bytes] = []
        places: list[tuple[int, int, int, int]] = []
        held = 0

        def made() -> pa.RecordBatch:
            x = code_points(b"\n".join(lines).decode("utf-8", "replace"))
            breaks = np.flatnonzero(x == 10)
            start, end = np.r_[0, breaks + 1], np.r_[breaks, len(x)]
            hashes = Hashes(x, 0)
            own = _mixed(hashes.of(start, end) ^ _mixed((end - start).astype(np.uint64)))
            first = np.zeros(len(own), bool)
            first[np.unique(own, return_index=True)[1]] = True
            slot = (own >> shift).astype(np.int64)
            told = first & (met[slot] != own) & (end - start >= least)
            met[slot[told]] = own[told]
            keys = window_keys(hashes, start[told], end[told]).view(np.int64).ravel()
            offsets = np.r_[0, np.cumsum(told * 2 * WINDOWS)].astype(np.int32)
            nulls = pa.array(np.r_[~told, False])
            listed = pa.ListArray.from_arrays(pa.array(offsets, mask=nulls.to_numpy(zero_copy_only=False)), pa.array(keys))
            h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            nul, doc, k1, number = (np.array(c, np.int64) for c in zip(*places))
            columns = [h[:, 0], h[:, 1], own.view(np.int64), nul.astype(np.int32), doc, k1, number.astype(np.int32)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), listed], _LINES.names)

        for batch in batches:
            nul, doc, k1 = (batch.column(k).to_pylist() for k in range(3))
            for z, d, k, text in zip(nul, doc, k1, as_bytes_or_empty(batch.column(3))):
                seen: set[bytes] = set()
                for number, s in lines_of(text):
                    h = digest(s)
                    if h not in seen:  # only the first of a document can be the first of all
                        seen.add(h)
                        lines.append(s)
                        digests.append(h)
                        places.append((z, d, k, number))
                        held += len(s) + 1
                        if held >= CHUNK:
                            yield made()
                            lines, digests, places, held = [], [], [], 0
        if lines:
            yield made()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, own, place) sorted by key and own: own and place of the rows at keys that more than one line has. Holds one batch
    and one row for each place, however many rows a key has."""
    key_at, own_at, places, many = None, None, np.zeros(0, np.int32), False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, own, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if key_at is not None and key[0] == key_at:  # goes on with the last key: its held rows, or one for all that it had
            before = places if not many else np.zeros(1, np.int32)
            fresh = np.r_[np.full(len(before), not many), np.ones(len(key), bool)]
            key, own, place = np.r_[np.full(len(before), key_at), key], np.r_[np.full(len(before), own_at), own], np.r_[before, place]
        else:
            fresh, many = np.ones(len(key), bool), False
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        several = np.logical_or.reduceat(np.r_[False, (own[1:] != own[:-1]) & (key[1:] == key[:-1])], starts)
        several[0] |= many
        tell = np.repeat(several, np.diff(np.r_[starts, len(key)])) & fresh
        yield pa.RecordBatch.from_arrays([pa.array(own[tell]), pa.array(place[tell])], ["own", "place"])
        last = starts[-1]
        key_at, own_at, many = key[last], own[last], bool(several[-1])
        places = np.unique(place[last:]) if not many else places


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (nul, doc, k1, text, wanted): the variants of the wanted lines."""
    names = ["v1", "v2", "role", "h1", "h2", "nul", "doc", "k1", "line", "text"]
    held: list[tuple] = []
    rows = 0

    def made() -> pa.RecordBatch:
        sizes = [len(x[0]) for x in held]
        v1, v2 = (np.concatenate([x[k] for x in held]).view(np.int64) for k in (0, 1))
        rest = [np.repeat(np.array([x[k] for x in held], t), sizes) for k, t in zip(range(2, 9), (np.int32, np.int64, np.int64, np.int32, np.int64, np.int64, np.int32))]
        texts = pa.array([x[9] for x in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        return pa.RecordBatch.from_arrays([pa.array(v1), pa.array(v2), *map(pa.array, rest), texts], names)

    for batch in batches:
        for nul, doc, k1, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3)), as_bytes_or_empty(batch.column(3)), batch.column(4).to_pylist()):
            parts = text.split(b"\n")
            for w in wanted:
                line = parts[w["line"]].strip().decode("utf-8", "replace")
                for v1, v2, role in deletions(line, w["places"]):
                    held.append((v1, v2, role, w["h1"], w["h2"], nul, doc, k1, w["line"], None if role else line))
                    rows += len(v1)
                    if rows >= 50_000:
                        yield made()
                        held, rows = [], 0
    if held:
        yield made()


def within_one_edit(a: str, b: str) -> bool:
    """Whether one code point inserted, deleted or replaced, or none, makes ``b`` of ``a``. In time in proportion to the length, but for a logarithm."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)  # the length of what both begin with
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        close = [within_one_edit(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield batch.select(["h1", "h2"]).filter(pa.array(close, pa.bool_()))


def near_lines(texts: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that are within one edit of a line that first stands earlier."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = lines.where("keys is not null").select("own", F.posexplode("keys").alias("place", "key")).select("key", "own", "place")
    candidates = (
        windows.repartition(parts, "key").sortWithinPartitions("key", "own").mapInArrow(lean(_met), "own long, place int")
        .groupBy("own").agg(F.expr("bit_or(shiftleft(1, place))").alias("places"))
    )
    by_doc = firsts.join(candidates, "own").groupBy("nul", "doc", "k1").agg(F.collect_list(F.struct("line", "h1", "h2", "places")).alias("wanted"))
    made = materialize(
        texts.join(by_doc, ["nul", "doc", "k1"]).select("nul", "doc", "k1", "text", "wanted")
        .mapInArrow(lean(_variants), "v1 long, v2 long, role int, h1 long, h2 long, nul int, doc long, k1 long, line int, text string")
    )
    own = F.struct("nul", "doc", "k1", "line", "h1", "h2")
    earliest = made.groupBy("v1", "v2").agg(*[F.min(F.when(F.col("role") == r, own)).alias(f"e{r}") for r in range(3)])
    facing = F.when(F.col("role") == 0, F.col("e1")).when(F.col("role") == 1, F.col("e0")).otherwise(F.col("e2"))
    pairs = (
        made.join(earliest, ["v1", "v2"])
        .select("h1", "h2", own.alias("own"), facing.alias("other"))
        .where("other < own")
        .select("h1", "h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
        .distinct()
    )
    texts = made.where("role = 0").select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    others = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("text").alias("o_text"))
    both = pairs.join(texts, ["h1", "h2"]).join(others, ["o1", "o2"]).select("h1", "h2", "text", "o_text")
    return both.mapInArrow(lean(_verified), "h1 long, h2 long").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, counts: bool = True, emptied: bool = True) -> DataFrame:
    """``docs`` with lines dropped that repeat, or nearly repeat, an earlier line; with ``counts`` also n_lines and n_dropped (long).
    Rows that had lines and lose all of them stay only if ``emptied``.

    Lines end at \\n and are compared without ASCII white space at their ends; blank lines always stay and aren't counted. A line
    goes if an equal line stands earlier, or if a line within one edit (a code point inserted, deleted or replaced) first stands
    earlier, be that one kept or not. The bound is one edit at every length; a caller may set it to none for lines of fewer
    than ``least`` code points. Earlier is by doc_id (nulls last), then by the text's hash for rows of one id, then by line. Repeated
    rows (same id, same text) are one document and keep the same lines. A null text stays null; an empty table gives no rows.
    Other columns stay as they are.

    Lines travel as 128-bit hashes. All lines emit their variants without one of a few windows; only lines that share one with another line
    emit single deletions, and only in that window, with their texts. Equal variants meet in aggregates that keep the earliest, so
    no group of lines is gathered or paired; each line is then checked against the earliest it met by edit distance.
    """
    ship(docs.sparkSession)
    flat, names = positional(docs)
    own, at = (f"c{names.index(c)}" for c in (id_col, text_col))
    flat = flat.withColumn(at, F.col(at).cast("string"))
    doc = F.col(own).cast("long")
    keyed = flat.select("*", doc.isNull().cast("int").alias("nul"), F.coalesce(doc, F.lit(0).cast("long")).alias("doc"), F.xxhash64(at).alias("k1"))
    texts = keyed.where(F.col(at).isNotNull()).select("nul", "doc", "k1", F.col(at).alias("text"))
    lines = materialize(texts.mapInArrow(lean(_lines(least)), _LINES))
    place = F.struct("nul", "doc", "k1", "line", "own")
    firsts = materialize(lines.groupBy("h1", "h2").agg(F.min(place).alias("p")).select("h1", "h2", "p.*"))
    kept = (
        firsts.join(near_lines(texts, lines, firsts), ["h1", "h2"], "left_anti")
        .groupBy("nul", "doc", "k1")
        .agg(F.collect_list("line").alias("lines"))
    )
    joined = keyed.join(kept, ["nul", "doc", "k1"], "left").select(*flat.columns, "lines")
    schema = T.StructType([*flat.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    columns, made = flat.columns, schema.names

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, gone = [], [], []
            for text, stay in zip(as_bytes(batch.column(at)), batch.column("lines").to_pylist()):
                if text is None:
                    texts.append(None)
                    n.append(0)
                    gone.append(0)
                    continue
                stay, parts = set(stay or ()), text.split(b"\n")
                solid = [bool(p.strip()) for p in parts]
                out = [p for k, p in enumerate(parts) if not solid[k] or k in stay]
                texts.append(text if len(out) == len(parts) else b"\n".join(out))
                n.append(sum(solid))
                gone.append(len(parts) - len(out))
            rest = [pa.array(texts, pa.binary()).cast(pa.string()) if c == at else batch.column(c) for c in columns]
            out = pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], made)
            yield out if emptied else out.filter(pa.array([not a or b < a for a, b in zip(n, gone)], pa.bool_()))

    done = joined.mapInArrow(lean(rebuild), schema)
    return done.select(*[F.col(c).alias(name) for c, name in zip(columns, names)], *(["n_lines", "n_dropped"] if counts else []))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH u AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents
), l AS (
  SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM u
), f AS (
  SELECT s, length(s) AS n, min({'doc': doc_id, 'line': line}) AS p FROM l WHERE s <> '' GROUP BY s
), d AS (
  SELECT *, n // 2 AS h, (n - 1) // 2 AS g FROM f
), same AS (
  SELECT a.s AS x, b.s AS y FROM d a JOIN d b ON a.n = b.n AND left(a.s, a.h) = left(b.s, b.h) WHERE a.s <> b.s
  UNION SELECT a.s, b.s FROM d a JOIN d b ON a.n = b.n AND right(a.s, a.h) = right(b.s, b.h) WHERE a.s <> b.s
), more AS (
  SELECT a.s AS x, b.s AS y FROM d a JOIN d b ON a.n = b.n - 1 AND left(a.s, a.h) = left(b.s, b.g)
  UNION SELECT a.s, b.s FROM d a JOIN d b ON a.n = b.n - 1 AND right(a.s, a.h) = right(b.s, b.g)
), near AS (
  SELECT x, y FROM same WHERE len(list_filter(range(1, length(x) + 1), lambda i: substring(x, i, 1) <> substring(y, i, 1))) = 1
  UNION ALL (
    SELECT x, y FROM more WHERE len(list_filter(range(0, length(x) + 1), lambda i: left(x, i) = left(y, i) AND right(x, length(x) - i) = right(y, length(x) - i))) > 0
  )
), both_ways AS (SELECT x, y FROM near UNION SELECT y, x FROM near),
gone AS (
  SELECT DISTINCT n.x AS s FROM both_ways n JOIN f a ON a.s = n.x JOIN f b ON b.s = n.y WHERE b.p < a.p
), k AS (
  SELECT l.*, l.s = '' OR (f.p = {'doc': l.doc_id, 'line': l.line} AND gone.s IS NULL) AS keep
  FROM l LEFT JOIN f ON f.s = l.s LEFT JOIN gone ON gone.s = l.s
)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (keep), '') AS text,
       count(*) FILTER (s <> '') AS n_lines, count(*) FILTER (NOT keep) AS n_dropped
FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {"op2_line_dedup": ORACLE}
