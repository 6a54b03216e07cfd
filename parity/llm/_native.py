"""Array and text expressions that take time in proportion to their input: running sums, cuts and replacements of stretches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of a running value: within a block, and over the blocks, arrays are built element by element.
BLOCK = 256
#: Code points of a chunk of text: a cut looks at the chunks that it touches only.
TEXT_CHUNK = 4096


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is evaluated once however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of int what ``combine`` makes of 0 and all elements before it (sums, largest values)."""
    start = F.struct(F.lit(0).alias("at"), empty("int").alias("out"))

    def within(block: Column) -> Column:
        return F.aggregate(block, start, lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def joined(blocks: Column) -> Column:
        before = F.aggregate(blocks, start, lambda a, b: F.struct(combine(a["at"], b["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b["out"], lambda x: combine(at, x))))

    def whole(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(BLOCK)).cast("int"))
        return F.when(F.size(v) > 0, let(F.transform(numbers, lambda b: within(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))), joined)).otherwise(empty("int"))

    return let(values, whole)


def sums(values: Column) -> Column:
    return running(values, lambda a, x: a + x)


def largest(values: Column) -> Column:
    return running(values, F.greatest)


def text_chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_CHUNK}}}"), F.lit(0))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` (from 0) to ``end`` (exclusive) of the text that was cut into ``chunks``; empty if there are none."""
    first = F.floor(start / F.lit(TEXT_CHUNK)).cast("int")
    last = F.floor((end - 1) / F.lit(TEXT_CHUNK)).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substr(near, start - first * TEXT_CHUNK + 1, end - start)).otherwise("")


def replaced(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """``text`` with the stretches that ``spans`` (with start and end, ordered by start) cover taken out, and for each span what ``fill`` makes
    of it and of the greatest end before it."""

    def whole(p: Column) -> Column:
        before = largest(F.transform(p["spans"], lambda x: x["end"]))
        pieces = F.zip_with(p["spans"], before, lambda x, at: F.concat(cut(p["chunks"], at, x["start"]), fill(x, at)))
        return F.concat(F.array_join(pieces, ""), cut(p["chunks"], F.array_max(F.transform(p["spans"], lambda x: x["end"])), p["n"]))

    held = F.struct(spans.alias("spans"), text_chunks(text).alias("chunks"), F.length(text).alias("n"))
    return F.when(F.size(spans) > 0, let(held, whole)).otherwise(text)
