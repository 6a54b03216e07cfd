"""Packing by cutting-stock column generation: patterns over a histogram of lengths, then places for ranked pieces."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parity.llm._base import as_bytes_or_empty, lean, materialize, read, ship
from parity.llm._vocab import LETTERS, vocabulary

#: Tokens of a sequence, and the id that closes each document.
CAPACITY = 2048
END_ID = 1
#: Lengths are classed in so many tokens, rounded up. The histogram has CAPACITY / UNIT classes whatever the input.
UNIT = 16
#: Columns are sought until the best would save less than this share; the program is then within it of its optimum.
GAP = 5e-4
#: Words, and pre-tokens, whose ids a worker remembers at least, and the longest that it remembers.
REMEMBERED = 120_000
LONGEST = 40

# Normaliser and pre-tokenizer of the files whose pre-tokens are made here. Their tokens never hold or look across white space.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The same below U+0100, as bytes of Latin-1 in lower case. Characters whose treatment as white space or case differs between
# libraries are left out; words that hold them take the library's own way.
_LOW = LETTERS.replace("A-Z", "").replace(r"\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\xdf-\xf6\xf8-\xff").encode("latin-1")
_SPACE = rb"\t-\r \xa0"
_SPLIT = re.compile(rb"\n|'s|'t|'re|'ve|'m|'ll|'d|[" + _LOW + rb"]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^" + _SPACE + _LOW + rb"0-9\xb2\xb3\xb9\xbc-\xbe]+").findall
_ODD = re.compile(r"[^\t-\r \x21-\x7e\xa0-\xff]").search
#: Stands between words whose pre-tokens are looked up together, and the id, which no vocabulary has, that it gives.
_END, _END_MARK = b"\n", 0xFFFFFFFF


def has_known_form(path: str) -> bool:
    """Whether the file's normaliser and pre-tokenizer are those above, so that the ids of a text are those of its words, one after the other."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    normalizer, steps = t.get("normalizer") or {}, (t.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, rest = steps[0], steps[1:]
    return (
        normalizer.get("type") == "Sequence" and normalizer["normalizers"] == _NORMALIZER
        and first.get("type") == "Split" and first.get("pattern") == {"Regex": _PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
        and [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or len(a["content"].split()) != 1 for a in t["added_tokens"])
        and t["model"].get("dropout") is None
    )


def _byte_characters() -> dict[int, str]:
    """For each code point below U+0100: its UTF-8 bytes as the characters that byte-level vocabularies write for them, which are
    the printable ones for themselves, and those from U+0100 on for the others in turn."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    written = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(written[b] for b in chr(c).encode()) for c in range(256)}


class Remembered:
    """Values of keys, kept for the last REMEMBERED new keys at least, and for twice as many (and those of one call) at most."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]]):
        self.make, self.known, self.older = make, {}, {}

    def of(self, keys: list[bytes]) -> list[bytes]:
        known, older, new = self.known, self.older, {}
        values = list(map(known.get, keys))
        missing = [i for i, v in enumerate(values) if v is None]
        for i in missing:
            if (value := older.get(keys[i])) is None:
                new[keys[i]] = b""
            else:
                known[keys[i]] = value
        new = dict(zip(new, self.make(list(new))))
        for i in missing:
            key = keys[i]
            values[i] = new[key] if key in new else known[key]
        known.update((k, v) for k, v in new.items() if len(k) <= LONGEST)
        if len(known) >= REMEMBERED:
            self.known, self.older = {}, known
        return values


class WordIds:
    """Ids by the tokenizers library, as unsigned 32-bit little-endian numbers. Of files of the known form, words between white space and
    their pre-tokens are remembered, and the library's model is asked for new pre-tokens only."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = _byte_characters()
        self.known_form = has_known_form(path)
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
        self.words, self.pieces = Remembered(self._words), Remembered(self._pieces)

    def _library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        of, ids, ends = self.model.tokenize, [], []
        for piece in pieces:
            if piece == _END:
                ids.append(_END_MARK)
            else:
                ids += [t.id for t in of(piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.characters))]
            ends.append(4 * len(ids))
        whole = np.array(ids, "<u4").tobytes()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        whole = b"\n".join(words).decode("utf-8", "replace")
        own: dict[int, bytes] = {}
        if _ODD(whole) or self.added(whole):
            texts = whole.split("\n")
            own = {k: self._library(t) for k, t in enumerate(texts) if _ODD(t) or self.added(t)}
            whole = "\n".join([t for k, t in enumerate(texts) if k not in own])
        joined = b"".join(self.pieces.of(_SPLIT(whole.lower().encode("latin-1"))))
        ends = np.flatnonzero(np.frombuffer(joined, "<u4") == _END_MARK) * 4
        plain = [joined[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(joined)])]
        if not own:
            return plain[: len(words)]
        rest = iter(plain)
        return [own[k] if k in own else next(rest) for k in range(len(words))]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Of each whole text: its ids."""
        if not self.known_form:
            return [self._library(t.decode("utf-8", "replace")) for t in texts]
        cut = [t.split() for t in texts]
        ids, at, out = self.words.of(list(chain.from_iterable(cut))), 0, []
        for words in cut:
            out.append(b"".join(ids[at : at + len(words)]))
            at += len(words)
        return out


@lru_cache(maxsize=2)
def _coder(path: str) -> WordIds:
    return WordIds(path)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part long, at long"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: whole stretches of CAPACITY ids, and what is left of each document.

    ``part`` and ``at`` number the pieces of a class within the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _coder(path), TaskContext.get().partitionId()
        seen = np.zeros(CAPACITY // UNIT + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        names = [x.split(" ")[0] for x in _PIECES.split(", ")]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes_or_empty(batch.column(1))
            for k in range(0, len(texts), 256):
                out = []
                for doc, raw in zip(ids[k : k + 256], coder.encode(texts[k : k + 256])):
                    raw = memoryview(raw + end)
                    n = len(raw) // 4
                    for start in range(0, n, CAPACITY):
                        length = min(CAPACITY, n - start)
                        c = -(-length // UNIT)
                        out.append((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, c, part, int(seen[c])))
                        seen[c] += 1
                columns = list(zip(*out)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if name == "class" else pa.int64()) for x, name in zip(columns, names)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), _PIECES)


def _knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of largest value, by dynamic programming over units (class k takes k + 1)."""
    m = len(values)
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        reach = min(room, m)
        worth = values[:reach] + best[room - 1 :: -1][:reach]
        k = int(worth.argmax())
        if worth[k] > best[room - 1] + 1e-12:
            best[room], pick[room] = worth[k], k
        else:
            best[room] = best[room - 1]
    pattern = np.zeros(m, np.int64)
    room = capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            pattern[pick[room]] += 1
            room -= pick[room] + 1
    return float(best[capacity]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss and Jordan with pivots: at this size faster than starting a library's threads."""
    n = len(a)
    both = np.hstack([a, np.eye(n)])
    for k in range(n):
        top = k + int(np.abs(both[k:, k]).argmax())
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def solve(histogram: np.ndarray, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that every class k (of k + 1 units) gets histogram[k] slots or more.

    The linear program over patterns starts from one class a pattern. Each round a knapsack over the dual prices finds the column
    that saves most; a revised simplex step takes it in. The solution is rounded down, and the few pieces that are then
    left go by first fit decreasing. All of it works on the histogram, so its cost doesn't grow with the input.
    """
    units = len(histogram)
    used = np.flatnonzero(histogram)
    if not len(used):
        return []
    demand = histogram[used].astype(float)
    m = len(used)
    columns = [np.zeros(m, np.int64) for _ in range(m)]
    for i, k in enumerate(used):
        columns[i][i] = units // (k + 1)
    inverse = np.diag([1.0 / columns[i][i] for i in range(m)])
    times_vector = lambda a, x: np.einsum("ij,j->i", a, x)  # noqa: E731  small: not worth the threads of a library
    level = times_vector(inverse, demand)
    for step in range(rounds):
        prices = inverse.sum(axis=0)  # every pattern costs 1
        values = np.zeros(units)
        values[used] = np.maximum(prices, 0)
        worth, pattern = _knapsack(values, units)
        if worth <= 1 + GAP:
            break
        column = pattern[used]
        direction = times_vector(inverse, column.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, level / direction, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        inverse[out] /= direction[out]
        direction[out] = 0
        inverse -= direction[:, None] * inverse[out]
        columns[out] = column
        if step % 100 == 99:  # start anew from the columns, against rounding errors
            inverse = _inverse(np.array(columns, float).T)
        level = np.maximum(times_vector(inverse, demand), 0)

    plan: list[tuple[np.ndarray, int]] = []
    left = histogram.astype(np.int64).copy()
    for column, x in zip(columns, level):
        times = int(np.floor(x + 1e-9))
        have = column > 0
        if have.any():  # never more slots than pieces, so that no pattern is left half empty
            times = min(times, int((left[used][have] // column[have]).min()))
        if times > 0:
            full = np.zeros(units, np.int64)
            full[used] = column
            plan.append((full, times))
            left -= full * times
    # What rounding leaves: at most a few pieces of each class, whole patterns first, then first fit decreasing.
    while left.any():
        pattern = np.zeros(units, np.int64)
        room = units
        for k in range(units - 1, -1, -1):
            if left[k] and room > k:
                pattern[k] = min(int(left[k]), room // (k + 1))
                room -= pattern[k] * (k + 1)
        have = pattern > 0
        times = int((left[have] // pattern[have]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is the ids of its whole text and the id 1; a null or empty text is that id alone. Documents are cut only
    where they hold CAPACITY ids or more: whole stretches fill sequences of their own, and the rest is packed. Every id
    lies in one piece. Repeated rows are packed each for itself; an empty table gives no rows; other columns are not looked at.

    Texts are read once and never shuffled: a task cuts pieces and checksums; the histogram (CAPACITY / UNIT classes)
    goes to the driver, the patterns come back as a table of the same bound. A piece's rank within its class is its number in its
    task and what tasks before have of the class, so no class is ranked in one task. Sequences are then gathered by id.
    """
    spark = ship(docs.sparkSession)
    units = CAPACITY // UNIT
    made = materialize(pieces(docs, path, id_col, text_col))
    counted = made.groupBy("class", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(units, np.int64)
    for row in counted.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most CAPACITY / UNIT rows
        histogram[row["class"] - 1] = row["n"]
    before = counted.select(
        F.col("class").alias("b_class"), F.col("part").alias("b_part"),
        (F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).alias("before"),
    )

    # For each class: its slots in order, as runs of equal patterns.
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = np.zeros(units, np.int64), 0
    for pattern, times in solve(histogram):
        for k in np.flatnonzero(pattern):
            runs.setdefault(int(k) + 1, []).append((int(taken[k]), sequence, int(pattern[k])))
            taken[k] += pattern[k] * times
        sequence += times
    table = {c: tuple(np.array(x, np.int64) for x in zip(*r)) for c, r in runs.items()}
    sent = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out = np.zeros(len(c), np.int64)
            slot = np.zeros(len(c), np.int64)
            for k in np.unique(c):
                own = c == k
                first, sequence_id, each = sent.value[int(k)]
                at = np.searchsorted(first, rank[own], "right") - 1
                inside = rank[own] - first[at]
                out[own] = sequence_id[at] + inside // each[at]
                slot[own] = inside % each[at]
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(-c.astype(np.int64)), pa.array(slot), *rest], ["sequence_id", "order", "slot", *batch.schema.names[2:]])

    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = made.join(before, (F.col("class") == F.col("b_class")) & (F.col("part") == F.col("b_part"))).select("class", (F.col("before") + F.col("at")).alias("rank"), *keep)
    placed = ranked.mapInArrow(lean(place), "sequence_id long, order long, slot long, " + ", ".join(f"{x} long" for x in keep))
    so_far = Window.partitionBy("sequence_id").orderBy("order", "slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0).cast("long"))).select(*keep, "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
