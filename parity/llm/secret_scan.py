"""Secret scans: fixed patterns, and sliding-window entropy by character class, as DataFrame expressions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.llm._base import positional, read, ship
from parity.llm._native import empty, let, replaced, sums

#: Base patterns, leftmost and non-overlapping each. A match of ``assign`` counts where its second group has 6 characters or more;
#: for the two others the least length is part of the pattern, which finds the same spans, as their runs are maximal.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: A candidate is a whole run of these characters, of WINDOW or more, with a letter, and a digit or letters of both cases. Loops give
#: nothing back and hold no groups, so the engine of patterns needs no stack for them, however long a run is.
_RUN = r"A-Za-z0-9+/_=-"
WINDOW = 20
CANDIDATE = (
    rf"(?<![{_RUN}])(?=[{_RUN}]*+(?<=[{_RUN}]{{{WINDOW}}}))(?=[0-9+/_=-]*+[A-Za-z])"
    rf"(?:(?=[A-Za-z+/_=-]*+[0-9])|(?=[A-Z+/_=-]*+[a-z])(?=[a-z+/_=-]*+[A-Z]))[{_RUN}]++"
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes, the narrowest first: what a candidate must match as a whole, and the least entropy (bits) of its best window.
CLASSES = ((r"^[0-9a-fA-F]++$", 3.0), (r"^[A-Za-z0-9]++$", 3.5), (r"^[A-Za-z0-9+/_=-]++$", 3.8))
#: Candidates that are never reported for their entropy: ids of the usual forms, numbers, and stand-ins.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]*+$",
    r"(?i)example|sample|placeholder|changeme|dummy|x{6,}|0{8,}|1234567",
)
#: Words joined by signs, paths and the like: letters and signs, then up to four digits, and signs; allowed if a capital follows a small
#: letter no more often than in one of WORD_LETTERS characters, as in names that are made of words.
WORDS = r"^[A-Za-z+/_=-]*+[0-9]{0,4}+[+/_=-]*+$"
WORD_LETTERS = 6
#: Characters of a candidate whose entropy is taken at a time, with the window that they begin.
STRETCH = 4096


def _spans(kind: str, text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of the matches, by the lengths of what lies between and within them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.filter(
        F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), found.alias("value"), F.transform(inner, lambda x: F.length(x)).alias("inner")),
        lambda x: x["value"].isNotNull(),  # what follows the last match
    )

    def placed(p: Column) -> Column:
        before = sums(F.transform(p, lambda x: x["gap"] + F.length(x["value"])))
        spans = F.zip_with(p, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["inner"].alias("inner")))
        return F.transform(F.filter(spans, lambda x: x["inner"] >= least), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(empty("struct<start:int,kind:int,end:int,value:string>"))


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits a character, of any ``window`` (31 at most) neighbouring characters; 0 for a shorter string.

    One pass with incremental counts: each step takes one character in and lets one out, which changes two counts, kept in five
    bits each of a few whole numbers, and the sum of c * log2(c) by what these two add to it. Characters outside ALPHABET count
    as one. Long strings are taken in stretches that overlap by a window, so a step never looks at the whole.
    """
    each, n_words = 12, -(-(len(ALPHABET) + 1) // 12)
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    weight = lambda c: F.element_at(table, c + 1)
    words = [f"w{k}" for k in range(n_words)]

    def code(c: Column) -> Column:
        place = F.instr(F.lit(ALPHABET), c)
        return F.struct(F.floor(place / F.lit(each)).cast("int").alias("word"), ((place % each) * 5).alias("shift"))

    def count(a: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.element_at(F.array(*[a[w] for w in words]), x["word"] + 1), x["shift"]).bitwiseAND(F.lit(31)).cast("int")

    def step(a: Column, x: Column) -> Column:
        come, go = x["come"], x["go"]
        same = (come == go) & go.isNotNull()
        n_in, n_out = count(a, come), count(a, go)
        change = (weight(n_in + 1) - weight(n_in)) + F.when(go.isNotNull(), weight(n_out - 1) - weight(n_out)).otherwise(F.lit(0.0))
        total = F.when(same, a["total"]).otherwise(a["total"] + change)
        unit = lambda y, k: F.when(y["word"] == k, F.call_function("shiftleft", F.lit(1).cast("long"), y["shift"])).otherwise(F.lit(0).cast("long"))
        new = [(a[w] + unit(come, k) - unit(go, k)).alias(w) for k, w in enumerate(words)]
        best = F.when(a["i"] + 1 >= window, F.greatest(a["best"], F.lit(math.log2(window)) - total / window)).otherwise(a["best"])
        return F.struct(*new, (a["i"] + 1).alias("i"), total.alias("total"), best.alias("best"))

    start = F.struct(*[F.lit(0).cast("long").alias(w) for w in words], F.lit(0).alias("i"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))

    def of_stretch(stretch: Column) -> Column:
        def whole(codes: Column) -> Column:
            none = F.expr("cast(null as struct<word:int,shift:int>)")
            pairs = F.zip_with(codes, F.slice(F.concat(F.array_repeat(none, window), codes), F.lit(1), F.size(codes)), lambda c, g: F.struct(c.alias("come"), g.alias("go")))
            return F.aggregate(pairs, start, step, lambda a: a["best"])

        return let(F.transform(F.split(stretch, ""), code), whole)

    stretches = F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{1,{STRETCH + window - 1}}})).{{1,{STRETCH}}}"), F.lit(1))
    return F.aggregate(stretches, F.lit(0.0), lambda best, x: F.greatest(best, of_stretch(x)))


def _entropy_spans(text: Column, base: Column, allow: Sequence[str]) -> Column:
    def reported(x: Column) -> Column:
        value = x["value"]
        least = reduce(lambda rest, c: F.when(value.rlike(c[0]), F.lit(c[1])).otherwise(rest), reversed(CLASSES), F.lit(float("inf")))
        of_words = value.rlike(WORDS) & (F.regexp_count(value, F.lit("[a-z][A-Z]")) * WORD_LETTERS <= F.length(value))
        allowed = reduce(lambda a, b: a | b, [value.rlike(p) for p in allow], of_words)
        # the entropy last: it is looked at only where nothing else has decided
        return F.when(allowed, F.lit(False)).otherwise(window_entropy(value) >= least)

    # Base spans are blanked out, so that what is left of a run beside them is a candidate of its own.
    rest = replaced(text, F.array_sort(base), lambda x, at: F.repeat(F.lit("\0"), F.greatest(x["end"] - F.greatest(x["start"], at), F.lit(0))))
    return let(rest, lambda t: F.filter(_spans("entropy", t, CANDIDATE), reported))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", allow: Sequence[str] = ALLOW) -> DataFrame:
    """All columns of ``docs`` and ``secret_spans``: array<struct<start, kind, end, value>>, ordered by start, then kind.

    Places are code points, the end exclusive. Kinds 0, 1 and 2 are the base patterns; kind 3 are candidates beside
    the base spans that are on no allow-list and have a window of high entropy for their character class. A null text is
    empty and has no spans. An own column of that name is replaced. No shuffle and no Python: one pass of expressions.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.concat(_spans("assign", text, ASSIGN, 2, 6), _spans("access", text, ACCESS), _spans("hex", text, HEX))
    with_base = docs.withColumn("secret_spans", base)
    spans = F.col("secret_spans")
    return with_base.withColumn("secret_spans", F.array_sort(F.concat(spans, _entropy_spans(text, spans, allow))))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    As ``scan``; spans are kind:start:end, joined by commas, and base_sha256 is the digest of the base ones so joined.
    Repeated rows each get a row, an empty table gives none, and only the id and the text are looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = F.col("secret_spans")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    return scan(rows).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.filter(spans, lambda x: x["kind"] < 3)), 256).alias("base_sha256"), _joined(spans).alias("spans"), count(3).alias("n_entropy"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of text that spans cover replaced by ``mask``; rows and other columns stay. Null stays null."""
    flat, names = positional(docs)
    own = f"c{names.index(text_col)}"
    text = F.coalesce(F.col(own).cast("string"), F.lit(""))
    # Spans come by start; one that begins within what is already masked only carries the mask on.
    done = replaced(text, F.col("secret_spans"), lambda x, at: F.when(x["start"] < at, F.lit("")).otherwise(F.lit(mask)))
    new = F.when(F.size("secret_spans") > 0, done).otherwise(F.col(own))
    return scan(flat, own).withColumn(own, new).select(*flat.columns).toDF(*names)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES: dict[str, str] = {}
