"""SimHash near-dedup: fingerprints meet at the anchors of a covering code, and links are joined to components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.llm._base import as_bytes_or_empty, connected_components, lean, materialize, positional, read, ship
from parity.llm.set_join import fine_sketch, shingle_hashes, similar_texts, sketch

SEED = 42
#: Fingerprints link at so many differing bits, or fewer. Of two halves one then differs in at most one bit.
THRESHOLD = 3
#: Shingles hashed at a time, so that a very long text needs bounded memory besides its words.
CHUNK = 1 << 16
#: Anchors of more rows than this are split into blocks of about so many, and each two blocks meet by themselves.
LARGE = 4096
#: A task compares about so many rows at a time (never splitting one anchor's or two blocks' rows), and holds so many links before it joins them.
ROWS_AT_ONCE = 1 << 21
LINKS_AT_ONCE = 1 << 20


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the shingles of ``width`` words; 0 if there is no word."""
    words = text.lower().split()  # bytes: A-Z only, and splits at [\x20\x09-\x0D]
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) < CHUNK else (b" ".join(words[k : k + width]) for k in range(len(words) - width + 1))
        n = len(words) - width + 1
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    while part := b"".join([digest(x, SEED) for x in islice(shingles, CHUNK)]):
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashes (big-endian): a bit is 1 if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k : k + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; a null text is empty, and a text without words has fingerprint 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x, width) for x in as_bytes_or_empty(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, fp long")


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Of the perfect Hamming code of 31 bits: 0 for a codeword, else the place (from 1) of the bit to flip."""
    out = np.zeros(len(x), np.int64)
    for k in range(5):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1))
        out |= (np.bitwise_count(x & mask) & 1).astype(np.int64) << k
    return out


#: For each syndrome s: the 15 pairs of places whose flips also lead to a codeword, as masks.
_PAIRS = np.array([[0] * 15] + [sorted((1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)) for s in range(1, 32)], np.uint64)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of all copies of the fingerprints.

    Each half, less its top bit, is covered by the Hamming code of 31 bits with radius 1. A fingerprint is at
    home at the codeword within 1 of it and visits those within 1 + 1. Where two halves differ in at most one
    bit, the home of either is within 2 of the other.
    """
    rows, keys, homes = [], [], []
    at = np.arange(len(fps))
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        s = _syndromes(x)
        side = np.uint64(half << 31)
        rows.append(at)
        keys.append(np.where(s > 0, x ^ (np.uint64(1) << (np.maximum(s, 1) - 1).astype(np.uint64)), x) | side)
        homes.append(np.ones(len(x), bool))
        odd = np.flatnonzero(s)
        rows.append(np.repeat(odd, 15))
        keys.append((x[odd][:, None] ^ _PAIRS[s[odd]]).ravel() | side)
        homes.append(np.zeros(15 * len(odd), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(fps), 20_000):
            part = fps[k : k + 20_000]
            row, key, home = anchors(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(part[row]), pa.array(home)], ["anchor", "fp", "home"])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links, as stars: at most one row a node."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within sorted rows of (anchor, fp, home): links between a row at home and any other row of the anchor, joined to stars."""
    held_u: list[np.ndarray] = []
    held_v: list[np.ndarray] = []
    links = 0

    def join() -> None:
        nonlocal links
        u, v = _forest(np.concatenate(held_u), np.concatenate(held_v))
        held_u[:], held_v[:], links = [u], [v], 0

    def compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> None:
        nonlocal links
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes = np.diff(np.r_[starts, len(anchor)])
        place = np.arange(len(anchor)) - np.repeat(starts, sizes)
        left = np.repeat(sizes, sizes) - place  # rows from here to the end of its anchor
        alive = np.flatnonzero(left > 1)
        lag = 1
        while len(alive):
            a, b = fp[alive], fp[alive + lag]
            hit = (home[alive] | home[alive + lag]) & (np.bitwise_count((a ^ b).view(np.uint64)) <= THRESHOLD) & (a != b)
            if hit.any():
                held_u.append(a[hit])
                held_v.append(b[hit])
                links += int(hit.sum())
                if links > LINKS_AT_ONCE:
                    join()
            lag += 1
            alive = alive[left[alive] > lag]

    rest: list[tuple] = []
    waiting = 0
    for batch in batches:
        rest.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
        waiting += batch.num_rows
        if waiting >= ROWS_AT_ONCE:
            anchor, fp, home = (np.concatenate(x) for x in zip(*rest))
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                compare(anchor[:cut], fp[:cut], home[:cut])
            rest, waiting = [(anchor[cut:], fp[cut:], home[cut:])], 0
    if rest:
        compare(*(np.concatenate(x) for x in zip(*rest)))
    if held_u:
        join()
        for k in range(0, len(held_u[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(held_u[0][k : k + 50_000]), pa.array(held_v[0][k : k + 50_000])], ["src", "dst"])


def near_links(fps: DataFrame) -> DataFrame:
    """(src, dst) links that join all fingerprints (column fp, distinct) within THRESHOLD bits to the right components."""
    placed = fps.mapInArrow(lean(_replicate), "anchor long, fp long, home boolean")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.count(F.lit(1))
    hot = placed.groupBy("anchor").agg(F.ceil(size / F.lit(LARGE)).cast("int").alias("blocks"), size.alias("n")).where(F.col("n") > LARGE).select("anchor", "blocks")
    blocks, own = F.col("blocks"), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    meetings = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.xxhash64(F.col("anchor"), F.least(own, other), F.greatest(own, other)))
    split = placed.join(materialize(hot, narrow=True), "anchor", "left").select(
        F.explode(F.when(blocks.isNull(), F.array("anchor")).otherwise(meetings)).alias("anchor"), "fp", "home"
    )
    return split.repartition(n, "anchor").sortWithinPartitions("anchor", "fp").mapInArrow(lean(_compare), "src long, dst long")


def components(classes: DataFrame) -> DataFrame:
    """(fp, root) for each of the distinct fingerprints of ``classes``."""
    found = materialize(connected_components(near_links(classes.select("fp"))), narrow=True)
    return classes.select("fp").join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z), cut at [\\x20\\x09-\\x0D] into words and into shingles of ``width`` words (a
    shorter text is one shingle; a null text, or one without words, has fingerprint 0 and links like any other).
    Documents link where fingerprints differ in at most 3 bits; component_id is the smallest doc_id that can be
    reached (null ids count only where a component has no other). Repeated rows each get a row. An empty table
    gives no rows; other columns of ``docs`` are not looked at.

    Equal fingerprints are one class, so a hot group of copies is a single row from there on. Each class goes to
    its anchors (at most 32), anchors compare rows at home against all rows, and every task gives stars, not pairs. Anchors of
    more than LARGE rows are split into blocks that meet two by two, so no task holds a hot anchor as a whole.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, width))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = classes.join(components(classes), "fp")
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(by_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs``, with all columns, less the rows that aren't the first of their component: that with the smallest doc_id (nulls
    last), then the smallest hash of its text. Of rows alike in both one stays, whichever it is. Rows link where fingerprints
    differ in at most 3 bits, or where the sets of their shingles have a Jaccard similarity of 0.8 or more."""
    ship(docs.sparkSession)
    flat, names = positional(docs)
    doc, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    key = F.struct(doc.isNull().alias("nul"), F.coalesce(doc.cast("long"), F.lit(0).cast("long")).alias("doc"), F.xxhash64(text).alias("k1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, sketches, fine = [], [], [], []
            for x in as_bytes_or_empty(batch.column(1)):
                hashes = shingle_hashes(x, width)
                own = np.unique(hashes.astype(np.uint64))
                fps.append(majority(hashes))
                sizes.append(len(own))
                sketches.append(sketch(own))
                fine.append(fine_sketch(own))
            columns = [batch.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(fine, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "fp", "n", "sketch", "fine"])

    made = materialize(flat.select(key.alias("key"), text.cast("string").alias("text")).mapInArrow(lean(run), "key struct<nul:boolean,doc:bigint,k1:bigint>, fp long, n long, sketch binary, fine binary"))
    sketches = made.select(F.col("key.k1").alias("d"), "n", "sketch", "fine").dropDuplicates(["d"])
    rows = made.groupBy("fp").agg(F.min("key").alias("key"))
    by_text = made.groupBy(F.col("key.k1").alias("d")).agg(F.min("fp").alias("fp"))
    by_bits = materialize(near_links(rows.select("fp")), narrow=True)

    def joined(links: DataFrame) -> DataFrame:
        """(fp, root), by fingerprints and by links of texts."""
        ends = by_text.select(F.col("d").alias("e"), F.col("fp").alias("dst"))
        by_sets = links.join(by_text, "d").join(ends, "e").select(F.col("fp").alias("src"), "dst")
        found = materialize(connected_components(by_bits.unionByName(by_sets)), narrow=True)
        return rows.select("fp").join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))

    texts = flat.select(F.xxhash64(text).alias("d"), text.cast("string").alias("text"))
    links = similar_texts(texts, width, sketches, lambda x: by_text.join(joined(x), "fp").select("d", F.col("root").alias("label")))
    first = rows.join(joined(links), "fp").groupBy("root").agg(F.min("key").alias("key")).select("key.*")
    keyed = flat.select("*", key.alias("key")).select(*flat.columns, "key.*")
    kept = keyed.join(first, ["nul", "doc", "k1"], "left_semi").dropDuplicates(["nul", "doc", "k1"])
    return kept.select(*flat.columns).toDF(*names)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
ORACLES: dict[str, str] = {}
