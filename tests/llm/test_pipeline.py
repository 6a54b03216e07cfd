"""Each stage against a plain version of it, on its own input."""

import pytest

import corpus_pipeline as C
from parity.llm import language_id as L
from parity.llm.set_join import shingle_set
from tests.llm.test_line_dedup import brute as lines_that_stay
from tests.llm.test_packing import check as check_packing
from tests.llm.test_secret_scan import base, more

from tests.llm.test_simhash import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents, and of what each stage makes of the written output of the one before."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(900, None, "en", "s", None), (901, "12 34", "en", "s", 5), (902, "", "de", "s", 0), (903, docs.first().text + "x", "en", "s", 1), (904, "Mixed words here token=abcdef12345 and more of them", None, None, 7), (904, "Mixed words here token=abcdef12345 and more of them", None, None, 7)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(str(top / "0"))
    out = [spark.read.parquet(str(top / "0")).collect()]
    for k, (_, stage) in enumerate(C.STAGES, 1):
        stage(spark, spark.read.parquet(str(top / str(k - 1))), "").write.parquet(str(top / str(k)))
        df = spark.read.parquet(str(top / str(k)))
        assert k == len(C.STAGES) or df.columns == COLUMNS
        out.append(df.collect())
    return out


def test_names():
    assert [n for n, _ in C.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "secret scans", "packing"]


def test_language_id_keeps_all_but_what_has_no_language(stages):
    want = [r for r in stages[0] if r.text is not None and L.has_letter(r.text.encode())]
    langs = {r.lang for r in stages[0]} - {None}
    key = lambda r: (r.doc_id, r.text, r.source, r.n_chars)
    assert sorted(map(str, map(key, stages[1]))) == sorted(map(str, map(key, want))) and len(want) == len(stages[0]) - 3
    was = {r.doc_id: r.lang for r in want}
    assert all(r.lang == was[r.doc_id] if was[r.doc_id] else r.lang in langs for r in stages[1])


def test_line_dedup(stages):
    stay = lines_that_stay(sorted({(r.doc_id, r.text) for r in stages[1]}))
    gone = {k for k, t in stay.items() if not t.strip()}
    assert sorted((r.doc_id, r.text, r.n_chars, r.source) for r in stages[2] if r.source) == sorted((r.doc_id, stay[r.doc_id], len(stay[r.doc_id]), r.source) for r in stages[1] if r.doc_id not in gone and r.source)
    assert sum(r.doc_id == 904 for r in stages[2]) == 2


def test_one_document_of_each_group_stays(stages):
    rows = stages[2]
    sets = [set(shingle_set(r.text.encode(), C.SHINGLE).tolist()) for r in rows]
    fps = [plain(r.text, C.SHINGLE) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (fps[a] ^ fps[b]).bit_count() <= 3 or 9 * both >= 4 * (len(sets[a]) + len(sets[b])) > 0:
                root[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r.doc_id)
    assert sorted(r.doc_id for r in stages[3]) == sorted(min(g) for g in groups.values())
    assert {str(r) for r in stages[3]} <= {str(r) for r in rows}


def test_secrets_are_masked_and_nothing_else(stages):
    def masked(text):
        out, at = [], 0
        b = base(text)
        for s, _, e in sorted(b + more(text, b)):
            if s >= at:
                out += [text[at:s], "[SECRET]"]
            at = max(at, e)
        return "".join(out) + text[at:]

    want = {r.doc_id: masked(r.text) for r in stages[3]}
    assert {r.doc_id: r.text for r in stages[4]} == want and all(r.n_chars == len(r.text) for r in stages[4])
    assert "[SECRET]" in want[904]


def test_packing(stages):
    from tokenizers import Tokenizer

    from parity.llm._vocab import vocabulary

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert check_packing(stages[5], {r.doc_id: r.text for r in stages[4]}, library) > 0.9


def test_run_does_the_same(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(str(tmp_path / "0"))
    for k, (_, stage) in enumerate(C.STAGES, 1):
        stage(spark, spark.read.parquet(str(tmp_path / str(k - 1))), sf).write.parquet(str(tmp_path / str(k)))
    want = spark.read.parquet(str(tmp_path / str(len(C.STAGES)))).collect()
    # which sequence a piece goes to depends on how rows lie in tasks; the pieces don't
    piece = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(piece, C.run(spark, sf).collect())) == sorted(map(piece, want)) and len(want) > 150


def test_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "0"))
    for k, (_, stage) in enumerate(C.STAGES, 1):
        stage(spark, spark.read.parquet(str(tmp_path / str(k - 1))), "").write.parquet(str(tmp_path / str(k)))
        assert spark.read.parquet(str(tmp_path / str(k))).count() == 0
