"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Lower-cased runs of Latin and Russian letters, digits and underscores, of two characters or more."""
    plain = F.lower(F.translate(F.coalesce(c, F.lit("")), "\u0130\u212a", "  "))  # the only other characters whose small letter is one of these
    return F.regexp_extract_all(plain, F.lit(r"([a-zа-я0-9_]{2,})"), F.lit(1))


def compact(c: Column, most: int) -> Column:
    """White space as one space, trimmed, and cut with an ellipsis at ``most`` characters."""
    plain = F.trim(F.regexp_replace(c, r"[\s]+", " "))
    return F.when(F.char_length(plain) <= most, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, most - 1)), F.lit("…")))


def slug(c: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, most)


def plain_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-zа-яё0-9]+", " "))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words of :func:`plain_words`; what follows them is not looked at."""
    word, gap = "[a-zа-яё0-9]", "[^a-zа-яё0-9]"
    return plain_words(F.regexp_extract(F.lower(c), rf"^{gap}*+((?:{word}++{gap}++){{0,{n - 1}}}+{word}*+)", 1))


def chunk_lines(c: Column, lines: int) -> Column:
    """Arrays of so many lines of a text, joined."""
    all_ = F.split(c, "\n")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / lines)), lambda k: F.array_join(F.slice(all_, (k * lines + 1).cast("int"), F.lit(lines)), "\n"))
