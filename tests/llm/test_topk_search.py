import math
import random

import duckdb
import numpy as np
import pytest

from parity.llm import topk_search as K


def brute(rows, k=5, every=50):
    vs = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: v for i, v in vs}.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vs if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("block, group, chunk", [(128, 64, 4096), (4, 3, 7)])
def test_against_brute_force(spark, monkeypatch, block, group, chunk):
    for name, value in (("BLOCK", block), ("GROUP", group), ("CHUNK", chunk)):
        monkeypatch.setattr(K, name, value)
    r = random.Random(block)
    rows = [(i, [r.choice((-0.5, 0.25, 0.3, r.gauss(0, 1))) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # one vector many times
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [1.0] * 6), (2200, [0.5]), (2250, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {(x.query_id, x["rank"], x.vec_id, x.score) for x in K.topk_search(df).collect()}
    assert got == brute(rows)
    assert K.topk_search(df.limit(0)).count() == 0


def test_few_candidates_and_large_numbers(spark):
    df = spark.createDataFrame([(0, [1e9, -2e6]), (50, [3e9, 1.0]), (7, [-1e9, 5.0])], "vec_id long, embedding array<double>")
    got = {(x.query_id, x["rank"], x.vec_id): x.score for x in K.topk_search(df.selectExpr("vec_id", "transform(embedding, x -> x / 256) as embedding")).collect()}
    assert got[(0, 1, 50)] == 3 * 10**18 - 2 * 10**6 and len(got) == 4


def test_bounds_hold_and_prune():
    r = np.random.default_rng(0)
    stores = [(np.arange(b * 10, b * 10 + 10), m, m.max(0)[None], m.min(0)[None]) for b in range(30) for m in [np.floor(r.normal(b, 1, (10, 4)) * 9)]]
    q = np.floor(r.normal(5, 1, (3, 4)) * 9)
    own, vec, score = K._search(np.array([-1, -2, -3]), q, [None] * 3, stores, 5)
    everything = np.concatenate([s[1] for s in stores])
    for i, o in enumerate((-1, -2, -3)):
        assert sorted(score[own == o].tolist(), reverse=True) == sorted((everything @ q[i]).tolist(), reverse=True)[:5]


def test_query(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = set(db.execute(f"select query_id, rank, vec_id, score from ({K.ORACLE})").fetchall())
    assert {tuple(r) for r in K.op6_topk_search(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()} == want
