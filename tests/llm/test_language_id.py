import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from parity.llm import language_id as L


def trees(texts, least=0):
    """Contexts of all orders of some texts of each language, counted in plain Python."""
    counts = {}
    for lang, ts in texts.items():
        for t in ts:
            data = b"\0" * L.DEPTH + t.lower()
            for k in range(L.DEPTH, len(data)):
                for order in range(L.DEPTH + 1):
                    counts.setdefault((lang, order, int.from_bytes(data[k - order : k], "big")), Counter())[data[k]] += 1
    return [(lang, order, c, sum(n.values()), len(n), [(s, x) for s, x in n.items() if x >= least]) for (lang, order, c), n in counts.items() if sum(n.values()) >= least]


def coded(contexts, lang, text):
    """Bits of a text, byte by byte."""
    by = {(order, c): (n, d, dict(kept)) for one, order, c, n, d, kept in contexts if one == lang}
    total, data = 0.0, b"\0" * L.DEPTH + text.lower()
    for k in range(L.DEPTH, len(data)):
        for order in range(L.DEPTH, -1, -1):
            n, d, kept = by.get((order, int.from_bytes(data[k - order : k], "big")), (0, 0, {}))
            if data[k] in kept:
                total -= math.log2(kept[data[k]] / (n + d))
                break
            if n:
                total -= math.log2((n + d - sum(kept.values())) / (n + d))
        else:
            total += 8
    return total


TEXTS = {"x": [b"abracadabra", b"banana abra banana"], "y": [b"zebra zoo", b"Buzz zoo zoo"], "z": ["été à la".encode()]}


@pytest.mark.parametrize("least", [0, 2, 3])
def test_exact_code_lengths(least):
    contexts = trees(TEXTS, least)
    model = L.freeze(contexts)
    texts = [b"abra", b"zoo banana", b"q", b"Ban", bytes([0xC3, 0xA9]), b"", b"abracadabra zebra" * 9]
    for text, bits in zip(texts, model.bits(texts)):
        for k, lang in enumerate(model.langs):
            assert bits[k] == pytest.approx(coded(contexts, lang, text), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("least", [0, 2, 4])
def test_probabilities_after_a_context_add_up_to_one_at_most(least):
    model = L.freeze(trees(TEXTS, least))
    for before in (b"abra", b"\0\0\0\0", b"zoo ", b"qqqq", b"\0zeb", b"nana"):
        bits = model.costs(L.grams(b"".join(before + bytes([s]) for s in range(256)))[:: L.DEPTH + 1])
        assert (np.exp2(-bits).sum(axis=0) <= 1 + 1e-9).all()


def test_long_texts_are_coded_whole(monkeypatch):
    model = L.freeze(trees(TEXTS))
    texts = [b"zoo abra " * 500, b"banana", b"", b"zebra" * 30]
    whole = model.bits(texts)
    monkeypatch.setattr(L, "PIECE", 37)
    assert model.bits(texts) == pytest.approx(whole)


def test_table():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        keys = np.unique(r.integers(0, 1 << 40, n))
        table = L.Table(keys)
        assert (table.find(keys) == np.arange(len(keys))).all()
        other = np.setdiff1d(r.integers(0, 1 << 40, 2000), keys)
        assert (table.find(other) == -1).all()


def test_learning_counts_all_rows_and_prunes_by_share(spark):
    rows = [(lang, t.decode()) for lang, ts in TEXTS.items() for t in ts]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    texts = [b"abra", b"zebra banana", "é".encode()]
    assert L.learn(df).bits(texts) == pytest.approx(L.freeze(trees(TEXTS)).bits(texts))
    small = L.learn(df, numbers=400)  # a share of 9 * 2 * 5 / 400
    assert sum(t.size + e.size for (_, t), (_, e) in zip(small.strings, small.escapes)) <= 400
    least = {lang: sum(map(len, ts)) * 9 * 10 / 400 for lang, ts in TEXTS.items()}
    want = [x for lang in TEXTS for x in trees({lang: TEXTS[lang]}, least[lang])]
    assert small.bits(texts) == pytest.approx(L.freeze(want).bits(texts))


def test_more_languages_than_are_sent(spark, monkeypatch):
    df = spark.createDataFrame([(lang, t.decode()) for lang, ts in TEXTS.items() for t in ts], "lang string, text string")
    sent = L.learn(df).bits([b"abra zoo"])
    monkeypatch.setattr(L, "SENT", 1)
    assert np.array_equal(sent, L.learn(df).bits([b"abra zoo"]))


def test_any_number_of_languages(spark):
    df = spark.createDataFrame([(f"l{k:03d}", f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 20) for k in range(200)], "lang string, text string")
    model = L.learn(df)
    assert len(model.langs) == 200 and [p[0] for p in model.predict([b"cb cb cb", b"ah ah"])] == ["l028", "l182"]


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (4, "the words", None), (None, "the words", "en"), (6, "die Wörter", "de"), (7, "die Wörter", "de"), (8, "Ελλάδα", None), (9, "the", "en"), (10, "das", "de"), (11, "x" * 100_000, "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in L.language_id(df).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[8].lang_pred != "und"
    assert all(0 <= r.score <= 1 and r.held_out == (crc32(str("" if k is None else k).encode()) % 5 == 0) for k, r in got.items())
    assert L.language_id(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.language_id(df.withColumn("lang", df.lang.substr(9, 1)).where("false")).collect()} == set()
    kept = L.keep_languages(df, 8.0)
    assert kept.columns == df.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    assert all(r.lang in ("en", "de") for r in kept.collect())


def test_no_language_learned(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.language_id(df).collect()] == ["und"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in L.op10_language_id(spark, sf).collect() if r.held_out]
    assert len(rows) > 100 and sum(r.lang_pred == want[r.doc_id] for r in rows) / len(rows) > 0.98
