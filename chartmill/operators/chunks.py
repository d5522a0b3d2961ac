"""Chunks of whole texts as column expressions: sections under headings, greedily packed sentences, lines with overlap.

Places are folded over arrays of lengths, and the text of a chunk is a slice of the parts, so a text of any length is read once and only the
list of its chunks grows in the fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartmill.functions.scalars import without_markdown
from chartmill.functions.text import compact

#: The title of what stands before the first heading, a heading, and the end of a sentence.
OVERVIEW = "Document overview"
HEADING = r"^\s{0,3}#{1,4}\s+(.+?)\s*$"
SENTENCE_END = r"(?<=\.)\s+(?=[A-ZА-Я])"
#: Characters of a section or sentence chunk at least and at most, of a line chunk at most, and lines that two line chunks share.
LEAST, MOST, LINE_MOST, OVERLAP = 180, 1200, 3500, 20


def lines_of(text: Column) -> Column:
    """Lines without their ends; a text that ends in a line's end has no empty line after it, and no text has no lines."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]", "\n")
    split = F.split(F.regexp_replace(plain, r"\n\z", ""), "\n", -1)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(split)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it (also within lambdas)."""
    return F.transform(F.array(value), body)[0]


def packed(text: Column, most: int = MOST, least: int = LEAST) -> Column:
    """Array of chunks: sentences are added to a chunk while it stays within ``most`` characters; a longer one is cut to it.

    Chunks under ``least`` characters go. If none is left, the beginning of a text of ``least`` and more is the only chunk.
    """
    state = F.struct(F.array().cast("array<int>").alias("begins"), F.lit(0).alias("held"), F.lit(0).alias("at"))

    def add(s: Column, length: Column) -> Column:
        fits = (s["held"] > 0) & (s["held"] + length + 1 <= most)
        begins = F.when(fits, s["begins"]).otherwise(F.array_append(s["begins"], s["at"]))
        return F.struct(begins.alias("begins"), F.when(fits, s["held"] + 1 + length).otherwise(F.least(length, F.lit(most))).alias("held"), (s["at"] + 1).alias("at"))

    def chunk(parts: Column, a: Column, b: Column) -> Column:
        own = F.slice(parts, a + 1, b - a)
        return F.when(b - a == 1, F.substring(own[0], 1, most)).otherwise(F.array_join(own, " "))

    def chunks(parts: Column) -> Column:
        begins = F.aggregate(F.transform(parts, lambda p: F.char_length(p)), state, add)["begins"]
        return let(begins, lambda at: F.zip_with(at, F.array_append(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.size(parts)), lambda a, b: F.when(a.isNotNull(), chunk(parts, a, b))))

    def whole(plain: Column) -> Column:
        found = let(F.filter(F.split(plain, SENTENCE_END, -1), lambda p: p != ""), chunks)
        long = F.filter(found, lambda c: F.char_length(c) >= least)
        return let(long, lambda c: F.when((F.size(c) == 0) & (F.char_length(plain) >= least), F.array(F.substring(plain, 1, most))).otherwise(c))

    return let(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), whole)


def sections(text: Column, most: int = MOST, least: int = LEAST) -> Column:
    """Array of (title, body) of a Markdown text: what stands between headings of levels 1 to 4, cleaned; bodies under ``least`` characters go, and those of
    more than ``most`` come in packed chunks with numbered titles."""

    def titled(lines: Column, heads: Column) -> Column:
        first = F.array(F.struct(F.lit(-1).alias("at"), F.lit(OVERVIEW).alias("title")))
        named = F.concat(first, F.transform(heads, lambda h: F.struct(h["at"].alias("at"), compact(h["title"], 160).alias("title"))))
        after = F.array_append(F.transform(heads, lambda h: h["at"]), F.size(lines))
        return F.zip_with(named, after, lambda h, b: F.struct(h["title"].alias("title"), without_markdown(F.array_join(F.slice(lines, h["at"] + 2, b - h["at"] - 1), "\n")).alias("body")))

    def pieces(p: Column) -> Column:
        whole = F.array(F.struct(p["title"].alias("title"), p["body"].alias("body")))
        cut = F.transform(packed(p["body"], most, least), lambda c, k: F.struct(F.concat(p["title"], F.lit(" #"), (k + 1).cast("string")).alias("title"), c.alias("body")))
        return F.when(F.char_length(p["body"]) <= most, whole).otherwise(cut)

    def read(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, k: F.struct(k.alias("at"), F.regexp_extract(x, HEADING, 1).alias("title"))), lambda h: h["title"] != "")
        return let(heads, lambda h: F.flatten(F.transform(F.filter(titled(lines, h), lambda p: F.char_length(p["body"]) >= least), pieces)))

    return let(lines_of(text), read)


def line_chunks(text: Column, most: int = LINE_MOST, overlap: int = OVERLAP) -> Column:
    """Array of (first, last, text): lines, numbered from 1, that fit into ``most`` characters, of which the next chunk repeats the last ``overlap``.

    A longer line is a chunk of its own. The next chunk begins at least a line later; blank chunks go.
    """
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    state = F.struct(none.alias("done"), F.lit(0).alias("a"), F.lit(0).alias("at"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("tail"))
    last = lambda tail, q: F.slice(tail, F.size(tail) - q + 1, q)
    total = lambda lengths: F.aggregate(lengths, F.lit(0), lambda s, x: s + x)
    made = lambda done, a, at, held, tail: F.struct(done.alias("done"), a.cast("int").alias("a"), at.cast("int").alias("at"), held.cast("int").alias("held"), tail.alias("tail"))

    def shifted(s: Column, n: Column, begin: Column) -> Column:
        """The line doesn't fit: the full chunk ends, and so do those from ``begin`` on that have no room for the line either."""
        room = s["at"] - begin
        kept = F.when(room > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(room, F.lit(1))), lambda q: total(last(s["tail"], q)) + n <= most))).otherwise(0)

        def new(k: Column) -> Column:
            to, tail = s["at"] - k, last(s["tail"], k)
            between = F.when(to > begin, F.transform(F.sequence(begin, F.greatest(to - 1, begin)), lambda x: span(x, s["at"]))).otherwise(none)
            return made(F.concat(s["done"], F.array(span(s["a"], s["at"])), between), to, s["at"] + 1, total(tail) + n, F.array_append(tail, n))

        return let(kept, new)

    def add(s: Column, n: Column) -> Column:
        tail = F.when(F.size(s["tail"]) < overlap, s["tail"]).otherwise(last(s["tail"], F.lit(overlap - 1)))
        fits = (s["at"] == s["a"]) | (s["held"] + n <= most)
        begin = F.greatest(s["at"] - overlap, s["a"] + 1)
        return F.when(fits, made(s["done"], s["a"], s["at"] + 1, s["held"] + n, F.array_append(tail, n))).otherwise(let(begin, lambda b: shifted(s, n, b)))

    def read(lines: Column) -> Column:
        end = F.aggregate(F.transform(lines, lambda x: F.char_length(x) + 1), state, add)
        spans = let(end, lambda e: F.when(e["at"] > e["a"], F.array_append(e["done"], span(e["a"], e["at"]))).otherwise(e["done"]))
        said = lambda s: F.regexp_replace(F.array_join(F.slice(lines, s["a"] + 1, s["b"] - s["a"]), "\n"), r"(?U)\A\s+|\s+\z", "")
        texts = F.transform(spans, lambda s: F.struct((s["a"] + 1).alias("first"), s["b"].alias("last"), said(s).alias("text")))
        return F.filter(texts, lambda t: t["text"] != "")

    return let(lines_of(text), read)
