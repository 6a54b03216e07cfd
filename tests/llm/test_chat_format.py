import hashlib
import random

import duckdb

from parity.llm.chat_format import DELTA, ORACLE, as_events, as_log, chat_format, loss_spans, op7_chat_format, read_back, reconstruct, render


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, message_id long, seq long, event string, role string, text string")


def test_fold_of_deltas_edits_and_regenerations(spark):
    events = log(spark, [
        (1, 10, 1, "message", "user", "hi"), (1, 11, 2, "message", "assistant", ""), (1, 11, 3, "delta", None, "He"), (1, 11, 4, "delta", None, "llo"),
        (1, 11, 5, "regenerate", None, None), (1, 11, 6, "delta", None, "Good"), (1, 11, 7, "delta", None, " day"), (1, 10, 8, "edit", None, "hi!"),
        (2, 20, 1, "delta", "assistant", "a"), (2, 20, 2, "delta", "assistant", "b"), (2, 21, 0, "seen", "user", "x"), (None, 1, 1, "message", None, None),
    ])
    got = [(r.conv_id, r.role, r.text) for r in reconstruct(events).orderBy("conv_id", "seq").collect()]
    assert got == [(None, None, ""), (1, "user", "hi!"), (1, "assistant", "Good day"), (2, "assistant", "ab")]


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "%5BINST] 100% %25", "<s></s", "[INST", "", "[/INST]</s>%3C/s>", "é\n<s>[", "<</s>>"]
    conv = spark.createDataFrame([(1, i, "assistant" if i % 2 else "us[INST]er", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = read_back(render(reconstruct(as_events(conv)))).first()
    assert [(t.role, t.text) for t in out.turns] == [("assistant" if i % 2 else "us[INST]er", t) for i, t in enumerate(texts)]
    spans = loss_spans(render(reconstruct(as_events(conv)))).first()
    inside = [spans.formatted[s.start : s.end] for s in spans.spans]
    assert [x.replace("%3C", "<").replace("%5B", "[").replace("%25", "%") for x in inside] == texts[1::2]


def test_edges(spark):
    rows = [(1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (1, None, None, None, 2), (None, 1, "assistant", "x" * 100_000, 3)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message_id int")
    got = {r.conv_id: r for r in read_back(render(reconstruct(as_events(conv)))).collect()}
    assert len(got[1].turns) == 3 and got[None].turns[0].text == "x" * 100_000
    assert chat_format(as_events(conv.limit(0))).count() == 0


def test_fold_against_a_plain_version(spark):
    r, kinds = random.Random(3), ("message", "delta", "delta", "edit", "regenerate", "seen", None)
    rows = [(c, r.randrange(3), s, r.choice(kinds), r.choice((None, "user", "assistant")), r.choice((None, "a", "bc"))) for c in range(60) for s in range(r.randrange(12))]
    want = []
    for c, m in sorted({x[:2] for x in rows}):
        done = []
        for _, _, seq, kind, role, text in sorted(x for x in rows if x[:2] == (c, m)):
            if kind == "message" or (not done and kind in ("delta", "edit")):
                done.append([seq, role, text or ""])
            elif done and kind in ("delta", "edit", "regenerate"):
                old = done[-1]
                new = {"delta": old[2] + (text or ""), "edit": text or "", "regenerate": ""}[kind]
                done[-1] = [old[0], old[1] or role, new]
        want += [(c, m, part, *x) for part, x in enumerate(done)]
    got = reconstruct(log(spark, rows)).select("conv_id", "message_id", "part", "seq", "role", "text").collect()
    assert sorted(map(tuple, got), key=lambda x: x[:3]) == want


def test_log_of_repeated_rows_nulls_and_long_texts(spark):
    long = "".join(chr(0x1F600 + k % 50) for k in range(3 * DELTA + 5))
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "assistant", ""), (1, 3, None, None), (1, None, "assistant", "z")]
    events = as_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.event for r in events.collect()} == {"message", "delta", "regenerate", "edit"}
    turns = read_back(render(reconstruct(events))).first().turns
    assert [(t.role, t.text) for t in turns] == [(x[2] or "", x[3] or "") for x in rows]
    assert as_log(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = {r[0]: r for r in db.execute(f"select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from ({ORACLE})").fetchall()}
    got = op7_chat_format(spark, sf_dir).collect()
    assert {r.conv_id: tuple(r) for r in got} == want
    mine = next(r for r in got if r.conv_id == -7)
    own = "</s>[INST] ok [/INST]"
    assert mine.loss_sha256 == hashlib.sha256(own.encode()).hexdigest()
