"""Chat formatting: logs of events become messages by conversation and sequence, and messages become one text with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.llm._base import read, ship
from parity.llm._native import cut, let, sums, text_chunks

#: Control strings of the template: a turn is OPEN role SHUT text CLOSE.
OPEN, SHUT, CLOSE, BEGIN = "[INST]", "[/INST]", "</s>", "<s>"
CONTROLS = (BEGIN, CLOSE, OPEN, SHUT)
#: Roles whose texts the loss counts.
TRAINED = ("assistant",)
#: Code points of a delta, and of a draft, of the log that the query writes.
DELTA, DRAFT = 512, 48


def escape(text: Column) -> Column:
    """No control string is left, and ``unescape`` gives the text back: % and the first character of each control string are written as %XX."""
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c[0]):02X}{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for first in dict.fromkeys(c[0] for c in CONTROLS):
        out = F.replace(out, F.lit(f"%{ord(first):02X}"), F.lit(first))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, seq, message_id, part, role, text): the final messages of a log (conv_id, message_id, seq, event, role, text).

    Within a message, by ``seq`` (ties by event, role and text, so that repeated rows have one order): ``message`` begins
    a message; ``delta`` adds its text to the one at hand, beginning one if there is none; ``edit`` replaces the whole text, or begins
    one; ``regenerate`` drops the text, and later deltas build it anew. Other events change nothing. A second ``message``
    of the same id is a message of its own. Null texts are empty. A message has the first role that its events name and stands where its
    first event stands. ``seq`` may be of any type with an order.

    Events are gathered by conversation and message, so a conversation of any length is many small groups. The fold takes time in
    proportion to them: what follows the last event that replaces the text is joined once.
    """
    rank = F.when(F.col("event") == "message", 0).when(F.col("event") == "regenerate", 1).when(F.col("event") == "edit", 2).otherwise(3)
    each = F.struct("seq", rank.alias("rank"), "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("event", F.lit("")).alias("event"))

    def folded(log: Column) -> Column:
        last = F.array_max(F.transform(log, lambda x, i: F.when((i == 0) | x["event"].isin("message", "edit", "regenerate"), i).otherwise(0)))
        known = F.filter(log, lambda x: x["event"].isin("message", "delta", "edit", "regenerate") & x["role"].isNotNull())
        adds = lambda x: F.when(x["event"].isin("message", "delta", "edit"), x["text"]).otherwise("")
        text = F.array_join(F.transform(F.slice(log, last + 1, F.size(log)), adds), "")
        return F.struct(F.get(log, F.lit(0))["seq"].alias("seq"), F.get(known, F.lit(0))["role"].alias("role"), text.alias("text"))

    def messages(log: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(log))
        kind = lambda i: F.element_at(log, i)["event"]
        first = F.array_min(F.filter(places, lambda i: kind(i).isin("message", "delta", "edit")))
        begins = F.filter(places, lambda i: (kind(i) == "message") | (i == first))
        ends = lambda s: F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(log) + 1))
        parts = let(begins, lambda s: F.when(F.size(s) > 0, F.zip_with(s, ends(s), lambda i, j: let(F.slice(log, i, j - i), folded))))
        return parts

    return (
        events.groupBy("conv_id", "message_id")
        .agg(F.array_sort(F.collect_list(each)).alias("events"))
        .select("conv_id", "message_id", let(F.col("events"), messages).alias("messages"))
        .select("conv_id", "message_id", F.posexplode("messages").alias("part", "m"))
        .select("conv_id", "m.seq", "message_id", "part", "m.role", "m.text")
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted): one text per conversation, its turns by seq (nulls last), then part, then the rendered turn.

    Each turn is escaped and rendered by itself; only rendered turns are gathered, as the result is one value per conversation.
    """
    turn = F.concat(
        F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(SHUT), escape(F.coalesce("text", F.lit(""))), F.lit(CLOSE)
    )
    return (
        messages.select("conv_id", F.struct(F.col("seq").isNull().alias("none"), "seq", "part", turn.alias("turn")).alias("t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
        .select("conv_id", F.concat(F.lit(BEGIN), F.array_join(F.col("turns.turn"), "")).alias("formatted"))
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text, loss, start, end>>), parsed from the formatted text alone. ``start`` and ``end``
    are the stretch of the formatted text, in code points, that holds the escaped text of the turn."""
    body = F.substr("formatted", F.lit(len(BEGIN) + 1))
    # what follows the last CLOSE is empty
    pieces = let(F.split(body, r"\Q" + CLOSE + r"\E", -1), lambda p: F.slice(p, 1, F.size(p) - 1))

    def parse(piece: Column) -> Column:
        def parts(sides: Column) -> Column:
            role, head = unescape(F.element_at(sides, 1)), F.length(F.element_at(sides, 1)) + len(OPEN) + len(SHUT)
            text = unescape(F.element_at(sides, 2))
            return F.struct(role.alias("role"), text.alias("text"), role.isin(*TRAINED).alias("loss"), head.alias("head"), F.length(piece).alias("size"))

        return let(F.split(F.substr(piece, F.lit(len(OPEN) + 1)), r"\Q" + SHUT + r"\E", 2), parts)

    def placed(turns: Column) -> Column:
        before = sums(F.transform(turns, lambda t: t["size"] + len(CLOSE)))
        at = lambda t, x, end: (x + len(BEGIN) + t[end]).alias({"head": "start", "size": "end"}[end])
        return F.zip_with(turns, before, lambda t, x: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["loss"].alias("loss"), at(t, x, "head"), at(t, x, "size")))

    return formatted.select("conv_id", "formatted", let(F.transform(pieces, parse), placed).alias("turns"))


def loss_spans(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans array<struct<start, end>>): the stretches of the formatted text that the loss counts, in code points."""
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return read_back(formatted).select("conv_id", "formatted", "turns", spans.alias("spans")).select("conv_id", "formatted", "spans")


def masked(formatted: Column, spans: Column) -> Column:
    """What the spans cut out of the formatted text, each unescaped, in order, nothing between."""
    return let(text_chunks(formatted), lambda c: F.array_join(F.transform(spans, lambda s: unescape(cut(c, s["start"], s["end"]))), ""))


def chat_format(events: DataFrame) -> DataFrame:
    """Formatted conversations of a log, with their loss spans: (conv_id, formatted, spans).

    Nulls count as empty texts and roles; events without a conversation are one of their own (null). Repeated rows are turns
    of their own. An empty log gives no rows; columns besides those of the log are not looked at.
    """
    return loss_spans(render(reconstruct(events)))


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as a log in which each row is one whole message."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("message_id"), F.col("turn").cast("long").alias("seq"),
        F.lit("message").alias("event"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def as_log(conversations: DataFrame) -> DataFrame:
    """A table of turns as the log of a chat service. A turn of a trained role begins empty, streams a draft, is regenerated and streams its
    text in deltas of DELTA code points; any other begins with a draft, which an edit replaces when all turns have been streamed.

    Each row is a message of its own, whatever its turn, so repeated rows stay apart. Drafts are the first code points of the text, reversed.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("role").cast("string")
    draft, trained = F.reverse(F.substr(text, F.lit(1), F.lit(DRAFT))), F.coalesce(role.isin(*TRAINED), F.lit(False))

    def event(kind: str, content: Column, late: int, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("event"), content.alias("text"), F.lit(late).alias("late"), at.alias("at"))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    start = [event("message", F.lit(""), 0, F.lit(0)), event("delta", draft, 0, F.lit(1)), event("regenerate", F.lit(""), 0, F.lit(2))]
    streamed = F.concat(F.array(*start), F.transform(pieces, lambda x, i: event("delta", x, 0, i + 3)))
    edited = F.array(event("message", draft, 0, F.lit(0)), event("edit", text, 1, F.lit(0)))
    turn = F.col("turn").cast("long")
    # the number of a row is made before the row becomes several
    numbered = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.monotonically_increasing_id().alias("message_id"), turn.alias("turn"), role.alias("role"),
        F.when(trained, streamed).otherwise(edited).alias("events"),
    )
    return numbered.select("conv_id", "message_id", "turn", "role", F.explode("events").alias("e")).select(
        "conv_id", "message_id", F.struct("e.late", F.col("turn").isNull().alias("none"), "turn", "e.at").alias("seq"),
        "e.event", F.when(F.col("e.event") == "message", F.col("role")).alias("role"), "e.text",
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted text of every conversation, and of one made of control strings: each is written as a
    log of deltas, edits and regenerations, folded and rendered. Loss texts are cut out of the formatted text by their spans."""
    own = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    ship(spark)
    turns = read_back(render(reconstruct(as_log(rows.unionByName(more)))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked(F.col("formatted"), F.filter("turns", lambda t: t["loss"]))
    return turns.select("conv_id", "turns", "formatted", loss.alias("under_loss")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"), F.sha2("under_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: formatted_chars follows from the template: BEGIN once, 17 characters of control strings a turn, and 2 more for each escape.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(replace(replace(text, '%', '%25'), '<s>', '%3Cs>'), '</s>', '%3C/s>'), '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]')) AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(17 + length(role) + n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op7_chat_format": op7_chat_format}
ORACLES = {"op7_chat_format": ORACLE}
