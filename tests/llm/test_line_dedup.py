import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from parity.llm import line_dedup as L


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def test_one_edit():
    r = random.Random(1)
    for _ in range(3000):
        a = "".join(r.choice("ab") for _ in range(r.randrange(6)))
        b = "".join(r.choice("ab") for _ in range(r.randrange(6)))
        near = a == b or any(a[:k] + c + a[k + w :] == b for k in range(len(a) + 1) for c in ("", "a", "b") for w in (0, 1))
        assert L.within_one_edit(a, b) == near == within_one(a, b)


def brute(docs, least=1):
    """docs: (doc_id, text) with distinct ids. What stays of each text."""
    white = " \t\n\x0b\x0c\r"
    first = {}
    for doc, text in sorted(d for d in docs if d[1] is not None):
        for k, line in enumerate(text.split("\n")):
            s = line.strip(white)
            if s:
                first.setdefault(s, (doc, k))
    gone = {a for a in first for b in first if a != b and len(a) >= least and len(b) >= least and first[b] < first[a] and within_one(a, b)}
    out = {}
    for doc, text in docs:
        if text is None:
            out[doc] = None
            continue
        lines = text.split("\n")
        out[doc] = "\n".join(x for k, x in enumerate(lines) if not (s := x.strip(white)) or (first[s] == (doc, k) and s not in gone))
    return out


def made(seed, n):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcé ") for _ in range(r.choice((0, 1, 2, 3, 7, 19, 40)))) + "." for _ in range(12)]

    def line():
        s = list(r.choice(pool))
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            k = r.randrange(len(s) + 1)
            s[k : k + r.choice((0, 1))] = r.choice(("", "x", "é", "aa"))
        return r.choice(("", " ", "\t")) + "".join(s) + r.choice(("", " "))

    return [(k, "\n".join(r.choice((line, line, line, lambda: ""))() for _ in range(r.randrange(0, 9)))) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs = made(seed, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in L.line_dedup(df).collect()} == brute(docs)


def test_a_least_length(spark):
    docs = made(11, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.line_dedup(df, least=20).collect()} == brute(docs, 20)


def keys_of(line):
    x = L.code_points(line)
    return set(L.window_keys(L.Hashes(x, 0), np.zeros(1, np.int64), np.array([len(x)]))[0].tolist())


def test_variants_meet_just_where_lines_are_within_one_edit():
    r = random.Random(7)
    texts = ["a", "b", "ab", "ba", "é", "aé", "abc", "abd", "xbc", "ac"]
    for n in (5, 24, 300):
        base = "".join(r.choice("abcdefgh") for _ in range(n))
        texts += [base, base[: n // 2] + base[n // 2 + 1 :], base[:2] + "é" + base[2:], base[:-1] + "Z", base[:-1] + "ZZ", base[1:], base[::-1], "x" * n, "x" * (n + 1), "x" * (n - 1)]
    texts = list(dict.fromkeys(texts))
    found = {}
    for k, t in enumerate(texts):
        rows = {0: set(), 1: set(), 2: set()}
        for v1, v2, role in L.deletions(t, (1 << 2 * L.WINDOWS) - 1):
            rows[role] |= set(zip(v1.tolist(), v2.tolist()))
        found[k] = rows
        assert len(rows[2]) == len(t)
    for a, x in enumerate(texts):
        for b, y in enumerate(texts):
            if a < b:
                met = bool(found[a][2] & found[b][2] or found[a][0] & found[b][1] or found[a][1] & found[b][0])
                assert met == within_one(x, y), (x, y)
                assert keys_of(x) & keys_of(y) or not met


def test_lines_at_a_key_are_met_in_bounded_memory():
    r = random.Random(3)
    rows = sorted({(k, r.choice((5, 5, 5, 6, 7)), r.randrange(8)) for k in (1, 1, 2, 3, 3, 4, 9) for _ in range(r.randrange(1, 30))})
    rows += [(20, 5, 1), (21, 5, 1), (21, 5, 2), (22, 4, 0), (22, 8, 0)]
    many = {k for k in {x[0] for x in rows} if len({x[1] for x in rows if x[0] == k}) > 1}
    for size in (1, 2, 3, 1000):
        cut = [rows[k : k + size] for k in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in c], pa.int64()), pa.array([x[1] for x in c], pa.int64()), pa.array([x[2] for x in c], pa.int32())], ["key", "own", "place"]) for c in cut]
        got = [(o, p) for b in L._met(iter(batches)) for o, p in zip(*(c.to_pylist() for c in b.columns))]
        assert set(got) == {x[1:] for x in rows if x[0] in many} and len(got) == sum(x[0] in many for x in rows)


def test_what_a_task_forgets_is_emitted_again(spark, monkeypatch):
    lines = [b"line %d" % (k % 50) for k in range(400)]
    monkeypatch.setattr(L, "CHUNK", 64)
    for slots in (2, 1 << 20):
        monkeypatch.setattr(L, "SLOTS", slots)
        batch = pa.RecordBatch.from_arrays([pa.array([0] * 400, pa.int32()), pa.array(range(400), pa.int64()), pa.array([0] * 400, pa.int64()), pa.array([x.decode() for x in lines])], ["nul", "doc", "k1", "text"])
        rows = [r for b in L._lines(1)(iter([batch])) for r in b.to_pylist()]
        assert len(rows) == 400 and len({(r["h1"], r["h2"]) for r in rows}) == 50
        assert {r["own"] for r in rows if r["keys"]} == {r["own"] for r in rows}
        assert sum(r["keys"] is not None for r in rows) == 50 if slots > 2 else sum(r["keys"] is not None for r in rows) > 50


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x\n\n  \nx", None), (3, "x\n\n  \nx", None), (None, "x\nyyy", "c"), (4, "long " * 30_000 + "end", "d"), (5, "long " * 30_000 + "and", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.n_lines) for r in L.line_dedup(df, counts=False).collect()), key=str)
    want = [(False, 1, None, "a"), (False, 2, "", "b"), (False, 3, "x\n\n  ", None), (False, 3, "x\n\n  ", None), (True, 0, "yyy", "c"), (False, 4, "long " * 30_000 + "end", "d"), (False, 5, "", "e")]
    assert got == sorted(want, key=str)
    assert L.line_dedup(df.limit(0)).count() == 0
    assert {r.doc_id for r in L.line_dedup(df, counts=False, emptied=False).collect()} == {1, 2, 3, None, 4}


def test_query(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(db.execute(f"select doc_id, text, n_lines, n_dropped from ({L.ORACLE})").fetchall())
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in L.op2_line_dedup(spark, sf_dir).collect()) == want
