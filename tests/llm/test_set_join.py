import random

import numpy as np
import pytest

from parity.llm import set_join as J
from parity.llm import simhash as S
from tests.llm.test_simhash import plain


def shingles(text, width=5):
    words = text.lower().split()
    return {" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b) > 0


def kept(docs):
    """By all pairs: the smallest id of each component."""
    sets, fps = [shingles(t) for _, t in docs], [plain(t, 5) for _, t in docs]
    root = list(range(len(docs)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if near(sets[a], sets[b]) or bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return sorted(docs[k][0] for k in range(len(docs)) if top(k) == k)


def made(seed):
    """Copies of texts with some words changed, from none to a fifth of the shingles; a passage that many hold; a crowd."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(25)]
    texts = ["", "one two", "One two"]
    for _ in range(25):
        words = [word() for _ in range(r.choice((6, 30, 120)))]
        if r.random() < 0.5:
            words[3:3] = passage
        for changes in (0, 1, 2, 3, 4, 5, 6):
            copy = words[:]
            for _ in range(changes):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    crowd = [word() for _ in range(200)]
    for _ in range(60):
        copy = crowd[:]
        copy[r.randrange(200)] = word()
        texts.append(" ".join(copy))
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    docs = made(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = kept(docs)
    assert sorted(r.doc_id for r in S.keep_one_of_each(df, width=5).collect()) == want
    bits = S.simhash_near_dedup(df, width=5).select("component_id").distinct().count()
    assert len(want) < bits  # fingerprints alone join fewer


def test_prefixes_of_similar_sets_meet_in_any_order():
    r = np.random.default_rng(5)
    for _ in range(3000):
        n = int(r.integers(1, 60))
        a = r.choice(100, n, replace=False)
        b = np.concatenate([a[int(r.integers(0, n // 4 + 1)) :], r.integers(100, 120, int(r.integers(0, n // 4 + 1)))])
        a, b, hot = (np.unique(x).astype(np.uint64) for x in (a, b, r.integers(0, 120, int(r.integers(0, 60)))))
        assert J.similar(a, b) == near(set(a.tolist()), set(b.tolist()))
        assert not J.similar(a, b) or set(J.prefix(a, hot).tolist()) & set(J.prefix(b, hot).tolist())


def test_sketches_rule_out_no_similar_sets():
    r = np.random.default_rng(6)
    ruled_out = 0
    for _ in range(500):
        n = int(r.integers(1, 400))
        a = r.integers(0, 1 << 64, n, dtype=np.uint64)
        k = int(r.integers(0, n // 4 + 1))
        a, b = np.unique(a), np.unique(np.concatenate([a[k:], r.integers(0, 1 << 64, k, dtype=np.uint64)]))
        sketches = (J._sketches(np.array([J.sketch(x)], object)) for x in (a, b))
        (left,) = J.possible(np.array([len(a)]), np.array([len(b)]), *sketches)
        assert left or not J.similar(a, b)
        ruled_out += not left
    assert ruled_out


def test_fine_sketches_rule_out_no_similar_sets():
    r = np.random.default_rng(8)
    ruled_out = 0
    for _ in range(600):
        n = int(r.integers(0, 3000))
        a = r.integers(0, 1 << 64, n, dtype=np.uint64)
        k, more = int(r.integers(0, n // 5 + 1)), int(r.integers(0, n // 5 + 1))
        a, b = np.unique(a), np.unique(np.concatenate([a[k:], r.integers(0, 1 << 64, more, dtype=np.uint64)]))
        left = J.may_fit(len(a), len(b), J.fine_sketch(a), J.fine_sketch(b))
        assert left or not J.similar(a, b)
        ruled_out += not left
    assert ruled_out
    close = np.arange(4000, dtype=np.uint64)  # all in one range, beyond what a byte counts
    assert J.may_fit(4000, 4500, J.fine_sketch(close), J.fine_sketch(np.arange(4500, dtype=np.uint64)))
