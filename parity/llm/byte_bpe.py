"""Byte-level BPE: a minimal perfect hash resolves pre-tokens that are in the vocabulary; the rest merge by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.llm._base import lean, read, ship
from parity.llm._vocab import splitter, vocabulary

#: Results of pre-tokens that a worker remembers before it starts anew, and the longest that it remembers.
REMEMBERED = 400_000
LONGEST = 64


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n keys, n slots, one 32-bit number for about 4 keys."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = n = len(keys)
        self.buckets = m = max(1, n // per_bucket)
        self.mask = (1 << 32) - 1
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(m)]
        for i, h in enumerate(hashes):
            groups[(h >> 64) % m].append(i)
        free = np.ones(n, bool)
        self.shift = [0] * m
        self.slots: list[bytes | None] = [None] * n
        self.values = [0] * n
        for b in sorted(range(m), key=lambda b: -len(groups[b])):
            if not groups[b]:
                continue
            low = np.array([hashes[i] & self.mask for i in groups[b]], np.uint64)
            step = np.array([hashes[i] >> 32 & self.mask | 1 for i in groups[b]], np.uint64)
            first = 0
            while True:  # try many displacements at a time
                d = np.arange(first, first + 512, dtype=np.uint64)[:, None]
                at = ((low + d * step) & np.uint64(self.mask)) % np.uint64(n)
                good = free[at].all(1)
                for k in np.flatnonzero(good):
                    if len(set(at[k].tolist())) == len(groups[b]):
                        break
                else:
                    first += 512
                    continue
                break
            self.shift[b] = first + int(k)
            free[at[k]] = False
            for i, s in zip(groups[b], at[k].tolist()):
                self.slots[s], self.values[s] = keys[i], i

    def find(self, key: bytes) -> int:
        """The place of ``key`` among the keys, or -1."""
        h = xxhash.xxh3_128_intdigest(key)
        s = (((h & self.mask) + self.shift[(h >> 64) % self.buckets] * (h >> 32 & self.mask | 1)) & self.mask) % self.n
        return self.values[s] if self.slots[s] == key else -1


class ByteBpe:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str | None = None):
        with open(path, "rb") as f:
            ranks = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        self.tokens = [t for t, _ in ranks]
        self.ids = [r for _, r in ranks]
        self.hash = PerfectHash(self.tokens)
        self.bytes_of = {r: t for t, r in ranks}
        self.text_of = {r: str(r) for r in self.ids}
        rank = {t: r for t, r in ranks}
        if max(self.ids) >= 1 << 16:
            raise ValueError("ranks above 16 bits")
        #: Rank of the token that two neighbouring tokens make, by the pair (ranks fit 16 bits).
        self.merged = {rank[t[:k]] << 16 | rank[t[k:]]: r for t, r in ranks for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank}
        self.byte_rank = [rank[bytes([b])] for b in range(256)]
        self.split = splitter(pattern)
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, leftmost first, until none is left."""
        merged = self.merged.get
        ids = [self.byte_rank[b] for b in piece]
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        #: Rank of the pair that starts at each place, -1 if it can't merge. An entry of the heap is its rank and place.
        rank_at = [merged(a << 16 | b, -1) for a, b in zip(ids, ids[1:])]
        rank_at.append(-1)
        heap = [r << 32 | i for i, r in enumerate(rank_at) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            if rank_at[i] != r:
                continue  # one of the two has merged otherwise since
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j] = r, -1
            rank_at[i] = rank_at[j] = -1
            if k < n:
                before[k] = i
                if (s := merged(r << 16 | ids[k], -1)) >= 0:
                    rank_at[i] = s
                    push(heap, s << 32 | i)
            k = before[i]
            if k >= 0:
                rank_at[k] = s = merged(ids[k] << 16 | r, -1)
                if s >= 0:
                    push(heap, s << 32 | k)
        return [x for x in ids if x >= 0]

    def piece(self, token: str) -> tuple[int, ...]:
        raw = token.encode()
        k = self.hash.find(raw)
        found = (self.ids[k],) if k >= 0 else tuple(self.merge(raw))
        if len(token) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = found
        return found

    def encode(self, text: str) -> list[int]:
        known, piece = self.known, self.piece
        return list(chain.from_iterable([known.get(t) or piece(t) for t in self.split(text)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def written(self, ids: list[int]) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str | None = None) -> ByteBpe:
    """One coder a worker process."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids array<int>. Null texts are empty and have no ids."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1).to_pylist()
            for k in range(0, len(texts), 256):
                ids = [own.encode(t or "") for t in texts[k : k + 256]]
                yield pa.RecordBatch.from_arrays([docs_.slice(k, 256), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: doc_id, bytes binary."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            out = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(lean(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, from encoding and decoding each whole text.

    A null text is empty. Repeated rows each get a row, an empty table gives none, and other columns are not
    looked at. One pass over the texts: only digests leave the workers, and nothing is shuffled.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            n, shas, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                n.append(len(ids))
                shas.append(hashlib.sha256(own.written(ids).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
