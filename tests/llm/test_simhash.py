import random
import re

import numpy as np
import pytest
import xxhash

from parity.llm import simhash as S
from parity.llm._base import connected_components


def plain(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fps):
    """fps: list of (id, fingerprint). Smallest id reachable, by comparing all."""
    ids = [i for i, _ in fps]
    x = np.array([f for _, f in fps], np.uint64)
    root = {}
    seen = set()
    for a in range(len(x)):
        if a in seen:
            continue
        todo, group = [a], {a}
        while todo:
            k = todo.pop()
            near = np.flatnonzero(np.bitwise_count(x ^ x[k]) <= 3)
            new = set(near.tolist()) - group
            group |= new
            todo += new
        seen |= group
        least = min((ids[k] for k in group if ids[k] is not None), default=None)
        root |= dict.fromkeys(group, least)
    return [root[k] for k in range(len(x))]


def test_fingerprints():
    texts = ["", " \t", "One", "one two", "One TWO three", "a b c d e f g", "É\xa0x y\x0bz w", "w " * 70_000 + "z"]
    for t in texts:
        assert S.fingerprint(t.encode(), 3) & (2**64 - 1) == plain(t)
    assert S.fingerprint(b"a b c d e f", 5) & (2**64 - 1) == plain("a b c d e f", 5)


def test_pairs_meet_at_the_home_of_either():
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(300)]
    pairs = [(x, x ^ sum(1 << b for b in r.sample(range(64), r.randrange(4)))) for x in base]
    for x, y in pairs:
        row, key, home = S.anchors(np.array([x, y], np.uint64))
        of = lambda k, h=None: {int(a) for a, q, w in zip(key, row, home) if q == k and (h is None or w == h)}
        assert of(0, True) & of(1) and of(1, True) & of(0)
        assert len(of(0)) <= 32


def test_the_code_is_perfect():
    x = np.random.default_rng(0).integers(0, 1 << 31, 2000).astype(np.uint64)
    s = S._syndromes(x)
    nearest = np.where(s > 0, x ^ (np.uint64(1) << (np.maximum(s, 1) - 1).astype(np.uint64)), x)
    assert (S._syndromes(nearest) == 0).all() and abs((s == 0).mean() - 1 / 32) < 0.02


@pytest.mark.parametrize("limit", [1 << 21, 50])
def test_against_all_pairs(spark, monkeypatch, limit):
    if limit == 50:
        monkeypatch.setattr(S, "LARGE", 3)  # so most anchors are split
    r = random.Random(limit)
    texts = []
    for k in range(120):
        words = [r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.choice((0, 1, 2, 60, 90)))]
        texts.append(" ".join(words))
        if words and k % 3 == 0:
            words[r.randrange(len(words))] = "changed"
            texts += [" ".join(words)] * 2
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = [*zip(ids, texts), (None, "only null"), (500, None), (501, "x " * 50_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(5)
    got = {(r_.doc_id, r_.fingerprint, r_.component_id) for r_ in S.simhash_near_dedup(df).collect()}
    fps = [(i, plain(t)) for i, t in rows]
    assert got == {(i, f"{f:016x}", c) for (i, f), c in zip(fps, components(fps))}
    assert S.simhash_near_dedup(df.limit(0)).count() == 0


def test_chains_and_a_star(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1001 + k) for k in range(3000)]
    edges = spark.createDataFrame(chain + star + [(7, 7), (200, 199)], "src long, dst long").repartition(6)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 4001)}
    assert connected_components(edges.limit(0)).count() == 0


def test_dense_groups_stay_small():
    base = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(np.array([base ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(64) for b in range(64)], np.uint64)).view(np.int64)
    import pyarrow as pa

    (batch,) = S._replicate(iter([pa.RecordBatch.from_arrays([pa.array(fps)], ["fp"])]))
    rows = batch.sort_by([("anchor", "ascending"), ("fp", "ascending")])
    links = pa.Table.from_batches(list(S._compare(iter([rows])))).to_pydict()
    assert len(links["src"]) == len(fps) - 1 and len(set(links["dst"])) == 1


def test_one_of_each_stays(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a b c d e f g", "z"), (None, "other words are said here now", None), (9, None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = S.keep_one_of_each(df, width=5).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.text) == [(0, "other words are said here now"), (1, "a b c d e f g")] and len(got) == 3


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = [(r.doc_id, plain(r.text)) for r in docs]
    want = {(i, f"{f:016x}", c) for (i, f), c in zip(fps, components(fps))}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in S.op9_simhash_near_dedup(spark, sf_dir).collect()} == want
