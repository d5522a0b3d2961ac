"""Quality rules from tokeniser fertility.

Public vocabularies measure every text: characters per token of a piece and of a byte-level vocabulary, the share of byte-fallback tokens
and the entropy of the tokens. Each figure has a band around the median of each language, a multiple of the median absolute deviation wide and
wider for short texts, whose figures scatter more: characters per token are bounded on both sides (one vocabulary's approval is enough), the
byte share above and the entropy below. Both statistics cover all rows with enough tokens. Languages with few such rows share the limits of all.
The base rule (number of words, share of words in repeated five-word windows) comes first.

The rows need the columns doc_id, text and lang. Defined cases: null texts have no words and fail the base rule; texts with fewer than
``min_tokens`` tokens are judged by the byte share alone; a null language is a group of its own; repeated rows get equal results; a text of
any length is measured whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, durable, sized
from .sentencepiece_bpe import model as piece_model

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Widths in median absolute deviations, and fixed limits."""

    width: float = 6.0
    short_tokens: int = 200  # at this length the band of a text is wider by the square root of two
    min_tokens: int = 48
    min_rows: int = 50
    max_byte_share: float = 0.25  # for languages without bands of their own
    min_entropy: float = 2.5  # likewise
    least_chars: float = 0.01  # least deviations, by figure
    least_share: float = 0.02
    least_entropy: float = 0.25
    languages: int = 100_000  # bands of up to so many languages are sent to every task


class ByteLevel:
    """Token counts of a byte-level vocabulary, kept by word."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[bytes, int] = {}

    def count(self, words: list[bytes]) -> int:
        """Tokens of the words, each with a space before it."""
        cache, encode = self.cache, self.encoding.encode_ordinary
        if len(cache) > 500_000:
            cache.clear()
        for w in {w for w in words if w not in cache}:  # a difference with the keys would walk the whole cache
            cache[w] = len(encode(" " + w.decode()))
        return sum(map(cache.__getitem__, words))


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur at least twice."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(32)
    n = len(words) - size + 1
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key = key * np.uint64(0xC2B2AE3D27D4EB4F) + ids[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    edge[starts] += 1
    edge[starts + size] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_figures(text: str) -> tuple[list[bytes], int, int, int, int]:
    """Words, their characters, symbols, repeated lines and repeated words."""
    data = text.encode()
    words = data.split()
    breaks = sum(data.count(bytes([c])) for c in (32, 9, 10, 11, 12, 13))
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return words, len(text) - breaks, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def measure(docs: DataFrame, piece_path: str, byte_path: str) -> DataFrame:
    """Base and fertility figures of every row, with its language."""

    def figures(batch):
        pieces, bytewise = piece_model(piece_path), byte_level(byte_path)
        rows, texts = [], [t or "" for t in batch.column("text").to_pylist()]
        for text, encoded in zip(texts, pieces.encode(texts), strict=True):  # the new words of many texts in one go
            words, chars, symbols, lines, repeats = base_figures(text)
            ids = np.frombuffer(encoded, "<u4")[1:-1]
            n = len(ids)
            if n:
                counts = np.bincount(ids)
                p = counts[counts > 0] / n
                share, entropy = float(pieces.is_byte[ids].mean()), float(-(p * np.log2(p)).sum())
                rows.append((len(words), chars, symbols, lines, repeats, n, chars / n, chars / max(1, bytewise.count(words)), share, entropy))
            else:
                rows.append((len(words), chars, symbols, lines, repeats, 0, 0.0, 0.0, 0.0, 0.0))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIGURES]

    types = ["long"] * 6 + ["double"] * 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return beside(rows, ["doc_id", "lang"], dict(zip(FIGURES, types, strict=True)), figures)


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "piece_chars", "byte_chars", "byte_share", "entropy"]
CHARS = ("piece_chars", "byte_chars")
JUDGED = (*CHARS, "byte_share", "entropy")


def judge(figures: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``base_failed`` and ``kept`` from the figures, and the reason of a rejection.

    Medians and deviations are percentile sketches, merged before the shuffle; the table of bands has a row for each language and, once it
    is counted, goes to the rows, so a language that holds most rows is no hot group.
    """
    whole = figures.where(F.col("n_tokens") >= bands.min_tokens)
    group = F.coalesce("lang", F.lit(""))
    middle = lambda c: F.percentile_approx(c, 0.5, 10_000)
    medians = durable(whole.groupBy(group.alias("g")).agg(*(middle(c).alias(f"mid_{c}") for c in JUDGED), F.count("*").alias("n")))
    off = whole.withColumn("g", group).join(sized(medians, bands.languages), "g")
    spreads = off.groupBy("g").agg(*(middle(F.abs(F.col(c) - F.col(f"mid_{c}"))).alias(f"dev_{c}") for c in JUDGED))
    own = durable(medians.join(spreads, "g").where(F.col("n") >= bands.min_rows).drop("n"))
    overall = whole.agg(*(F.percentile_approx(c, [0.01, 0.5, 0.99], 10_000).alias(f"all_{c}") for c in CHARS))
    judged = figures.withColumn("g", group).join(sized(own, bands.languages), "g", "left").crossJoin(F.broadcast(overall))  # one row
    wider = F.sqrt(1 + bands.short_tokens / F.greatest("n_tokens", F.lit(1)))
    room = lambda c, least: bands.width * F.greatest(F.col(f"dev_{c}"), F.lit(least)) * wider
    banded = F.col(f"mid_{CHARS[0]}").isNotNull()
    inside = F.lit(False)  # one vocabulary's approval is enough
    for c in CHARS:
        near = F.when(banded, F.abs(F.col(c) - F.col(f"mid_{c}")) <= room(c, bands.least_chars)).otherwise(
            F.col(c).between(F.col(f"all_{c}")[0] / 2, F.col(f"all_{c}")[2] * 2)
        )
        inside |= F.coalesce(near, F.lit(True))
    most_bytes = F.when(banded, F.col("mid_byte_share") + room("byte_share", bands.least_share)).otherwise(F.lit(bands.max_byte_share))
    least_entropy = F.when(banded, F.col("mid_entropy") - room("entropy", bands.least_entropy)).otherwise(F.lit(bands.min_entropy))
    short = F.col("n_tokens") < bands.min_tokens
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    reason = (
        F.when(failed, "base")
        .when(F.col("byte_share") > most_bytes, "byte share")
        .when(~short & (F.col("entropy") < least_entropy), "entropy")
        .when(~short & ~inside, "characters per token")
    )
    return judged.select("doc_id", *FIGURES[:5], failed.alias("base_failed"), reason.isNull().alias("kept"), reason.alias("reason"), *FIGURES[5:])


def quality(docs: DataFrame, piece_path: str, byte_path: str, bands: Bands = Bands()) -> DataFrame:
    return judge(durable(measure(docs, piece_path, byte_path)), bands)
