"""Language ID by partial matching: per-language variable-order trees of byte contexts give exact code lengths under frozen counts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.llm._base import as_bytes, as_bytes_or_empty, lean, materialize, positional, read, ship

#: Bytes of the longest context. Contexts of all shorter lengths are kept too, and escapes lead to the next shorter one.
DEPTH = 4
#: Numbers that the model's tables hold at most, for any number of languages and any number of rows. Contexts, and symbols in them, that
#: are rarer than a share of a language's bytes are pruned; this and the languages give the share.
NUMBERS = 1 << 23
#: Bytes coded at a time; a longer text is coded in pieces that overlap by DEPTH bytes, so whole.
PIECE = 1 << 17
#: Different byte strings that a task counts before it hands them on.
COUNTED = 1 << 20
#: Rows of (language, least count) that are sent to all executors at most; more of them are joined by shuffles.
SENT = 1 << 16
#: Bits of a symbol after all escapes.
PLAIN_BITS = 8.0
#: Decides how soon the score nears 1: bytes after which evidence stops adding up.
SOFT_BYTES = 40
_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def grams(data: bytes) -> np.ndarray:
    """Each byte from the one at DEPTH on, with the DEPTH bytes before it, as one number."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(x) - DEPTH
    out = np.zeros(n, np.int64)
    for j in range(DEPTH + 1):
        out = (out << 8) | x[j : n + j]
    return out


def padded(text: bytes) -> bytes:
    """A-Z lower-cased, after DEPTH zeros, which stand for what is before a text."""
    return b"\0" * DEPTH + text.lower()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of strings of DEPTH + 1 bytes by language, of this task's texts, handed on when there are many."""
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    held = 0

    def settle() -> None:
        nonlocal held
        for lang, parts in waiting.items():
            k, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in counts:
                k0, n0 = counts[lang]
                k1, back = np.unique(np.concatenate([k0, k]), return_inverse=True)
                k, n = k1, np.bincount(back, np.concatenate([n0, n])).astype(np.int64)
            counts[lang] = k, n
        waiting.clear()
        held = 0

    def told() -> Iterator[pa.RecordBatch]:
        for lang, (k, n) in counts.items():
            for at in range(0, len(k), 100_000):
                part = k[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(part), np.int64))), pa.array(part), pa.array(n[at : at + 100_000])], ["lang", "gram", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes_or_empty(batch.column(1))):
            if text:
                data = padded(text)
                for at in range(0, len(text), 4 * PIECE):
                    part = grams(data[at : at + 4 * PIECE + DEPTH])
                    waiting.setdefault(lang, []).append(part)
                    held += len(part)
                    if held > 4 * PIECE:
                        settle()
                        if sum(len(k) for k, _ in counts.values()) > COUNTED:
                            yield from told()
    settle()
    yield from told()


class Table:
    """Places of whole numbers in an array of different ones, -1 for others, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            at, first = np.unique(slot, return_index=True)
            free = self.keys[at] < 0
            mine = first[free]
            self.keys[at[free]], self.places[at[free]] = keys[todo[mine]], todo[mine]
            rest = np.ones(len(todo), bool)
            rest[mine] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.places[slot], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.places[slot[todo[same]]]
            todo = todo[~same & (held >= 0)]
        return out


@dataclass
class Model:
    """For each order (bytes of context): known strings of context and symbol with their whole cost in each language, and known contexts
    with the cost of leaving them for the next shorter one."""

    langs: list[str]
    strings: list[tuple[Table, np.ndarray]]
    escapes: list[tuple[Table, np.ndarray]]

    def costs(self, found: np.ndarray, order: int = DEPTH) -> np.ndarray:
        """Bits of each string's last byte after the ``order`` bytes before it: a row a string, a column a language."""
        out = np.zeros((len(found), len(self.langs)))
        todo = np.arange(len(found))
        for k in range(min(order, len(self.strings) - 1), -1, -1):
            own = found[todo] & ((1 << 8 * (k + 1)) - 1)
            table, bits = self.strings[k]
            place = table.find(own)
            hit = place >= 0
            out[todo[hit]] += bits[place[hit]]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                return out
            table, bits = self.escapes[k]
            place = table.find(own >> 8)
            hit = place >= 0
            out[todo[hit]] += bits[place[hit]]
        out[todo] += PLAIN_BITS
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each whole text in each language."""
        total = np.zeros((len(texts), len(self.langs)))
        parts: list[np.ndarray] = []
        owners: list[int] = []
        held = 0

        def add() -> None:
            starts = np.cumsum([0, *map(len, parts[:-1])])
            np.add.at(total, owners, np.add.reduceat(self.costs(np.concatenate(parts)), starts, axis=0))

        for k, text in enumerate(texts):
            data = padded(text)
            for at in range(0, len(text), PIECE):
                parts.append(grams(data[at : at + PIECE + DEPTH]))
                owners.append(k)
                held += len(parts[-1])
                if held >= PIECE:
                    add()
                    parts, owners, held = [], [], 0
        if parts:
            add()
        return total

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float, float]]:
        """(language or und, score, bits a byte) of each text."""
        out = [("und", 0.0, 0.0)] * len(texts)
        at = [k for k, t in enumerate(texts) if t is not None and self.langs and has_letter(t)]
        for k, bits in zip(at, self.bits([texts[k] for k in at])):
            n = len(texts[k])
            best = int(bits.argmin())  # ties: the first language by name
            gap = (bits - bits[best]) / n * min(n, SOFT_BYTES)
            out[k] = self.langs[best], float(1 / np.exp2(-gap).sum()), float(bits[best] / n)
        return out


def freeze(contexts: Iterable[tuple[str, int, int, int, int, list[tuple[int, int]]]]) -> Model:
    """Trees from contexts: (language, order, context, symbols seen there, different ones, those kept with their counts).

    A kept symbol seen c times in a context of n symbols, d of them different, costs -log2(c / (n + d)) there. All others cost the
    escape, which has what is left of the probability (d, and the pruned counts), and then what they cost in the next shorter context;
    after the empty context all symbols cost PLAIN_BITS. A context that isn't in a language's tree costs no escape.
    """
    rows = list(contexts)
    langs = sorted({r[0] for r in rows})
    at = {lang: k for k, lang in enumerate(langs)}
    model = Model(langs, [], [])
    for order in range(DEPTH + 1):
        own = [r for r in rows if r[1] == order]
        known = np.unique(np.array([r[2] for r in own], np.int64))
        escape = np.zeros((len(known), len(langs)))
        strings, owners, bits = [], [], []
        for lang, _, context, n, d, kept in own:
            escape[np.searchsorted(known, context), at[lang]] = -np.log2((n + d - sum(c for _, c in kept)) / (n + d))
            for symbol, c in kept:
                strings.append(context << 8 | symbol)
                owners.append(at[lang])
                bits.append(-np.log2(c / (n + d)))
        model.escapes.append((Table(known), escape))
        all_of, back = np.unique(np.array(strings, np.int64), return_inverse=True)
        cost = np.zeros((len(all_of), len(langs)))
        if len(all_of):
            place = model.escapes[-1][0].find(all_of >> 8)
            cost = escape[place] + (model.costs(all_of, order - 1) if order else PLAIN_BITS)
            cost[back, owners] = bits
        model.strings.append((Table(all_of), cost))
    return model


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", numbers: int = NUMBERS) -> Model:
    """Counts of all rows with a language, summed and made to trees on the executors. Contexts and symbols that make up less than a share
    of a language's bytes are pruned: of each order no more than one in that share can be left, so what the driver gets and sends
    on holds ``numbers`` numbers at most, however many rows and languages there are."""
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counted = materialize(rows.mapInArrow(lean(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), narrow=True)
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    if not totals:
        return freeze([])
    share = len(totals) ** 2 * 2 * (DEPTH + 1) / numbers
    least = spark.createDataFrame([(lang, float(n * share)) for lang, n in totals.items()], "lang string, least double")
    if len(totals) <= SENT:  # a join by language would put a common one into a single task
        least = F.broadcast(least)
    orders = F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    strings = counted.select("lang", orders.alias("order"), "gram", "n").select("lang", "order", F.expr("gram & (shiftleft(1L, 8 * (order + 1)) - 1)").alias("string"), "n")
    strings = strings.groupBy("lang", "order", "string").agg(F.sum("n").alias("c")).join(least, "lang")
    kept = F.collect_list(F.when(F.col("c") >= F.col("least"), F.struct(F.expr("cast(string & 255 as int)").alias("symbol"), "c")))  # 256 at most
    contexts = (
        strings.groupBy("lang", "order", F.expr("shiftright(string, 8)").alias("context"))
        .agg(F.sum("c").alias("n"), F.count("*").alias("d"), kept.alias("kept"), F.max("least").alias("least"))
        .where("n >= least")
    )
    table = contexts.select("lang", "order", "context", "n", "d", F.col("kept.symbol").alias("symbols"), F.col("kept.c").alias("counts")).toArrow()
    columns = (table.column(c).to_pylist() for c in ("lang", "order", "context", "n", "d", "symbols", "counts"))
    return freeze((lang, order, context, n, d, list(zip(symbols, counts))) for lang, order, context, n, d, symbols, counts in zip(*columns))


def is_held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, bits_per_byte.

    lang_pred is ``und`` (score 0) where the text is null or has no letter, or nothing was learned. The score is
    the winner's share among the languages over at most SOFT_BYTES bytes of mean evidence. Whole texts are coded.
    Repeated rows each get a row; an empty table gives none; only the id and the text are looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.predict(as_bytes(batch.column(2)))
            lang, score, bits = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``identify`` with what ``learn`` takes from the rows that aren't held out (crc32 of the id, mod 5, not 0)."""
    ship(docs.sparkSession)
    return identify(docs, learn(docs.where(~is_held_out(id_col)), lang_col, text_col), id_col, text_col)


def keep_languages(docs: DataFrame, most_bits: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a learned language and takes less than ``most_bits`` bits a byte in
    it. Rows whose text is null or has no letter go; a null language becomes the predicted one. Learns as ``language_id`` does; one more
    pass decides, without a shuffle."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs.where(~is_held_out(id_col)), lang_col, text_col))
    flat, names = positional(docs)
    at, of = names.index(text_col), names.index(lang_col)
    flat = flat.withColumn(f"c{of}", F.col(f"c{of}").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.predict(as_bytes(batch.column(at)))
            own = batch.column(of)
            filled = pa.array([x if x is not None else p[0] for x, p in zip(own.to_pylist(), found)], own.type)
            batch = batch.set_column(of, batch.schema.field(of), filled)
            yield batch.filter(pa.array([lang != "und" and bits < most_bits for lang, _, bits in found], pa.bool_()))

    return flat.mapInArrow(lean(run), flat.schema).toDF(*names)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
