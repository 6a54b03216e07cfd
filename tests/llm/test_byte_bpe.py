import base64

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from parity.llm.byte_bpe import PerfectHash, coder, decode_documents, encode_documents, op8_byte_bpe, round_trip

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab'sdlre ve\t\n\x85\xa0\x1c²½É7!", max_size=60))
def test_same_ids_as_the_library(other, text):
    own = coder(PATH)
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(k).encode() for k in range(3000)]
    h = PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(3000))
    assert sorted(h.values) == list(range(3000)) and h.find(b"no") == -1


def test_long_pieces_merge_like_the_library(other):
    text = "thereforeandtheother" * 400
    assert coder(PATH).encode(text) == other.encode_ordinary(text)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "Hi <|endoftext|>", None)], "doc_id long, text string, ids string")
    rows = {(r.doc_id, r.n_tokens) for r in round_trip(docs, PATH).collect()}
    assert (1, 0) in rows and (2, 0) in rows and len(rows) == 3
    assert round_trip(docs, PATH).count() == 4 and round_trip(docs.limit(0), PATH).count() == 0
    back = decode_documents(encode_documents(docs, PATH), PATH).collect()
    assert sorted(bytes(r.bytes).decode() for r in back) == ["", "", "", "Hi <|endoftext|>"]


def test_query(spark, sf_dir, other):
    import hashlib

    want = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = other.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
