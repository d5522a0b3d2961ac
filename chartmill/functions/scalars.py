"""Numbers, answer tokens, names, markdown and labels inside texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of a number and of an answer, and the bounds of the bands of a score.
NUMBER = r"[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?"
ANSWER = r"@(\w+)\[([^\]]*)\]"
BANDS = ((0.85, "good"), (0.65, "fair"))


def numbers(text: Column) -> Column:
    """All numbers in a text; a comma is a decimal point."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))


def answers(text: Column) -> Column:
    """Map of the answers ``@key[value]`` in a text; the last one of a key holds."""
    said = F.coalesce(text, F.lit(""))
    keys, values = (F.regexp_extract_all(said, F.lit(ANSWER), F.lit(i)) for i in (1, 2))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.size(keys) + 1).alias("i")), lambda x: x["k"].isNotNull() & (F.array_position(F.reverse(keys), x["k"]) == F.size(keys) - x["i"] + 1))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], F.trim(x["v"]))))


def within(a: Column, b: Column, tolerance: float = 0.03) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance), F.abs(a) * tolerance)


def without_markdown(text: Column) -> Column:
    """Text without code fences, pictures, tags and marks of links and code, with single spaces."""
    for pattern, by in ((r"(?s)```.*?```", " "), (r"`([^`]*)`", "$1"), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", " "), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def human_name(name: Column) -> Column:
    """snake_case, kebab-case and camelCase as words with a capital each."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " "), r"[_\-\s]+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.char_length(w)))), " ")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def score_band(score: Column) -> Column:
    """Band of a score; scores above one are percentages."""
    unit = F.when(score > 1, score / 100).otherwise(score)
    out = F.when(unit.isNull(), None).otherwise(F.lit("poor"))
    for least, name in reversed(BANDS):
        out = F.when(unit >= least, name).otherwise(out)
    return out


def run_time(text: Column) -> Column:
    """Timestamps of ISO texts and of folder names, whose times are written with dashes; texts without a zone are UTC."""
    return F.try_to_timestamp(F.regexp_replace(text, r"T(\d{2})-(\d{2})-(\d{2})", "T$1:$2:$3"))


def seconds_of(seconds: Column, milliseconds: Column) -> Column:
    """Seconds, or milliseconds / 1000 where there are none; never below zero."""
    return F.greatest(F.lit(0.0), F.coalesce(seconds.cast("double"), milliseconds / 1000))
