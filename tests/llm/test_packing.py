import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import parity.llm.packing as P5
from parity.llm.packing import CAPACITY, UNIT, WordIds, _coder, _inverse, has_known_form, op5_packing, pack, solve

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(
    st.text(max_size=60)
    | st.text(st.characters(max_codepoint=255), max_size=60)
    | st.text("ab'sdlreVE Ñß\t\n\x0b\x0c\x1c\x85\u2028\xa0\u0301\u0338²½µ7!.-<=ΣİK", max_size=60)
    | st.lists(st.sampled_from(["<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", " ", "\n", "a", "endoftext", "É"]), max_size=12).map("".join)
)
def test_same_ids_as_the_library(library, text):
    assert np.frombuffer(_coder(PATH).encode([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_files_go_to_the_library_whole(tmp_path):
    assert has_known_form(PATH) and _coder(PATH).known_form
    changed = json.loads(Path(PATH).read_text())
    changed["pre_tokenizer"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(changed))
    assert not has_known_form(str(other))
    text = "two words\nand more"
    assert np.frombuffer(WordIds(str(other)).encode([text.encode()])[0], "<u4").tolist() == Tokenizer.from_file(str(other)).encode(text, add_special_tokens=False).ids


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(P5, "REMEMBERED", 10)
    asked = []
    r = P5.Remembered(lambda keys: asked.extend(keys) or [k * 2 for k in keys])
    keys = [b"%d" % (k % 7) for k in range(50)] + [b"%d" % k for k in range(40)] + [b"x" * 100]
    assert [r.of([k])[0] for k in keys] == [k * 2 for k in keys] and len(r.known) <= 10 and len(r.older) <= 10 and len(asked) == 41
    assert r.of([b"x" * 100, b"1", b"x" * 100]) == [b"x" * 200, b"11", b"x" * 200]


def test_added_tokens_as_the_library(spark, library):
    texts = {1: "hello <|endoftext|> there", 2: "<|startoftext|><|endoftext|>", 3: "x<|endoftext|>y <|ENDOFTEXT|>"}
    check(pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH).collect(), texts, library)
    assert np.frombuffer(_coder(PATH).encode([b"hello <|endoftext|> there"])[0], "<u4").tolist() == [3306, 49407, 997]


def test_patterns_cover_the_histogram_and_fit():
    r = np.random.default_rng(5)
    units = CAPACITY // UNIT
    for n in (0, 1, 7, 400, 30_000):
        lengths = r.integers(1, CAPACITY + 1, n)
        h = np.bincount(-(-lengths // UNIT) - 1, minlength=units)
        plan = solve(h)
        assert all((p * np.arange(1, units + 1)).sum() <= units and t > 0 for p, t in plan)
        assert (sum((p * t for p, t in plan), np.zeros(units, int)) == h).all()
        if n == 30_000:
            need = (h * np.arange(1, units + 1)).sum() / units
            assert sum(t for _, t in plan) <= 1.03 * need


def test_inverse():
    a = np.random.default_rng(0).normal(size=(20, 20))
    assert np.allclose(_inverse(a) @ a, np.eye(20))


def check(rows, texts, library):
    """Every id in one piece, checksums right, sequences gapless and within CAPACITY. Returns the filled share."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
    return sum(r.length for r in rows) / (CAPACITY * len(by_sequence))


def test_edges(spark, library):
    texts = {1: None, 2: "", 3: "word " * 10_000, 4: "x" * 3000, 5: "a b"}
    df = spark.createDataFrame([(k, t, 0, "s") for k, t in texts.items()], "doc_id long, text string, start int, class string")
    check(pack(df, PATH).collect(), texts, library)
    assert pack(df.limit(0), PATH).count() == 0
    twice = pack(df.where("doc_id = 5").union(df.where("doc_id = 5")), PATH).collect()
    assert [r.doc_tokens for r in twice] == [3, 3] and {r.offset for r in twice} in ({0, 3}, {0})


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check(op5_packing(spark, sf_dir).collect(), texts, library) > 0.9
