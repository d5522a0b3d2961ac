"""Removal of repeated passages, by suffix automata of reference shards.

A window of ``size`` consecutive words that starts at more than one place of the corpus (the same document included) is repeated; every
word under such a window goes. The reference that documents are held against is the set of repeated passages, each once:

1. Seeds. A document's seeds are the least hashes of its 8-word sequences in each window, so equal windows have equal seeds. Seeds
   are counted over the corpus; only windows with a seed that occurs twice can be repeated.
2. Reference. The windows that are left are counted by hash with sums before the shuffle. Of a repeated window the first document (by
   row key) gives the words, from one place: its runs of such windows are the passages. They are dealt into shards of about
   ``shard_words`` words by document (long documents by parts of ``PART`` words), so that near copies meet few shards.
3. Streaming. A document streams to a shard the runs of its windows that the shard holds, and nothing else, so what is streamed grows
   with the repeated words and not with the number of shards. The shard's passages go to every task that streams for it, and the
   task builds the shard's suffix automaton. Rows arrive sorted, the reference first, and the documents pass by in batches, so a
   task holds one automaton and one batch whatever the number of documents; a shard that many documents need is streamed in many
   tasks. Matching statistics of at least ``size`` words mark the maximal spans that go.

Nothing is paired within a group of copies: seeds, windows and spans are grouped by sums, and joins have one row on one side.

Defined cases: a null text has no words; texts shorter than the window keep everything; repeated rows (and rows that repeat only the text) are
occurrences of their own, so both lose the passage; a null doc_id is a document like any other; an empty table gives no rows; extra columns
are carried by :func:`remove_repeats` and :func:`cut_repeats` under their names, but columns of the names that :func:`remove_repeats` adds
are replaced. Spans are told apart by 128 bits of doc_id and text, windows by a 64-bit hash of the words (a collision of windows can only
send a document to a shard that doesn't match it: what goes is settled by the automaton).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import beside, discard, release, words_of, written

SEED = 8  # words of a seed
#: Words of a reference shard, about, and repeated words that one task streams for a shard.
SHARD_WORDS, STREAM_WORDS = 250_000, 1_000_000
#: Words of a document whose passages go to one shard; most words of a passage's piece; words that are hashed at once; rows that a task gathers before it hands them on.
PART, PIECE, BLOCK_WORDS, OUT_ROWS = 25_000, 1024, 200_000, 200_000
_M = 0x9E3779B97F4A7C15
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _join(left: np.ndarray, right: np.ndarray, words: int) -> np.ndarray:
    """Hashes of sequences from those of their left part and of their right part of so many words."""
    return left * np.uint64(pow(_M, words, 1 << 64)) + right


def _sequences(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position, by doubling; the last size - 1 positions have none."""
    powers = {1: h}
    k = 1
    while 2 * k <= size:
        powers[2 * k] = _join(powers[k][:-k], powers[k][k:], k)
        k *= 2
    out, done = powers[k], k
    while done < size:
        while done + k > size:
            k //= 2
        part = powers[k][done:]
        out = _join(out[: len(part)], part, k)
        done += k
    return out


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """Least or greatest of ``size`` values from each position, by doubling."""
    k = 1
    while 2 * k <= size:
        values = best(values[:-k], values[k:])
        k *= 2
    return best(values[: len(values) - (size - k)], values[size - k :]) if k < size else values


def hashes_of(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def window_seeds(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed of each window of a document of word hashes ``h`` (not shorter than a window), and the hashes that the seeds are the least of."""
    seed = min(SEED, size)
    g = _sequences(h, seed)
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return _sliding(g, size - seed + 1, np.minimum), g


def _hashed(texts: list[str | None], size: int):
    """Index and word hashes of each text that has a window; short texts are hashed many at once."""
    held: list[tuple[int, int]] = []
    words: list[bytes] = []
    for k, text in enumerate(texts):
        own = words_of(text)
        if len(own) < size:
            continue
        held.append((k, len(own)))
        words += own
        if len(words) >= BLOCK_WORDS:
            yield from _cut_hashes(held, words)
            held, words = [], []
    yield from _cut_hashes(held, words)


def _cut_hashes(held, words):
    h, at = hashes_of(words), 0
    for k, n in held:
        yield k, h[at : at + n]
        at += n


def _gathered(parts, rows: int):
    """Frames of about ``rows`` rows from a stream of columns of equal lengths."""
    held: dict[str, list] = {}
    total = 0
    for part in parts:
        for name, values in part.items():
            held.setdefault(name, []).append(values)
        total += len(next(iter(part.values())))
        if total >= rows:
            yield pd.DataFrame({c: np.concatenate(v) for c, v in held.items()})
            held, total = {}, 0
    if total:
        yield pd.DataFrame({c: np.concatenate(v) for c, v in held.items()})


def _seeds(rows: DataFrame, size: int) -> DataFrame:
    """(k, seed, n): the distinct seeds of each row, and at how many places of it they are."""

    def each(batches):
        for pdf in batches:
            keys = pdf["k"].to_numpy()
            for i, h in _hashed(pdf["text"].tolist(), size):
                least, all_ = window_seeds(h, size)
                distinct, n = np.unique(all_[np.isin(all_, least[np.r_[True, least[1:] != least[:-1]]])], return_counts=True)
                yield {"k": np.full(len(distinct), keys[i]), "seed": distinct.view(np.int64), "n": n}

    return rows.select("k", "text").mapInPandas(lambda batches: _gathered(each(batches), OUT_ROWS), "k long, seed long, n long")


def _candidates(words: list[bytes], seeds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose seed is one of ``seeds``, and the hashes of those windows."""
    h = hashes_of(words)
    starts = np.flatnonzero(np.isin(window_seeds(h, size)[0], np.asarray(seeds, np.int64).view(np.uint64)))
    return starts, _sequences(h, size)[starts].view(np.int64)


def _windows(marked: DataFrame, size: int) -> DataFrame:
    """(w, k, at) of each window that may be repeated."""

    def each(batches):
        for pdf in batches:
            for k, text, seeds in zip(pdf["k"], pdf["text"], pdf["seeds"], strict=True):
                starts, w = _candidates(words_of(text), seeds, size)
                yield {"w": w, "k": np.full(len(w), k), "at": starts.astype(np.int32)}

    return marked.select("k", "text", "seeds").mapInPandas(lambda batches: _gathered(each(batches), OUT_ROWS), "w long, k long, at int")


def _runs(windows: DataFrame, size: int, *group: str) -> DataFrame:
    """Per group (part of one document): ``firsts`` and ``lasts`` window starts of its runs of consecutive windows, and their words ``n``."""
    starts = windows.groupBy(*group).agg(F.array_sort(F.collect_set("at")).alias("starts"))
    near = F.col("starts")
    firsts = F.filter(near, lambda at, i: F.coalesce(at - F.get(near, i - 1) > 1, F.lit(True)))
    lasts = F.filter(near, lambda at, i: F.coalesce(F.get(near, i + 1) - at > 1, F.lit(True)))
    n = F.size("starts") + F.size("firsts") * F.lit(size - 1)
    return starts.select(*group, "starts", firsts.alias("firsts"), lasts.alias("lasts")).select(*group, "firsts", "lasts", n.cast("long").alias("n"))


def _pieces(firsts, lasts, size: int):
    """Word spans of the runs, in pieces of at most ``PIECE`` words; every window lies whole in a piece."""
    step = max(1, PIECE - size + 1)  # window starts of a piece
    for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
        for at in range(first, last + 1, step):
            yield at, min(at + step - 1, last) + size


def _said(placed: DataFrame, size: int) -> DataFrame:
    """(shard, salt, role, k, k2, at, words): the pieces of each document for the places on its ``routes``."""

    def run(batches):
        for pdf in batches:
            out, total = [], 0
            for k, k2, text, routes in zip(pdf["k"], pdf["k2"], pdf["text"], pdf["routes"], strict=True):
                words = words_of(text)
                for r in routes:
                    for a, b in _pieces(np.asarray(r["firsts"]), np.asarray(r["lasts"]), size):
                        out.append((int(r["shard"]), int(r["salt"]), int(r["role"]), k, k2, a, b" ".join(words[a:b]).decode()))
                        total += b - a
                if total > 2 * BLOCK_WORDS:
                    yield pd.DataFrame(out, columns=columns)
                    out, total = [], 0
            yield pd.DataFrame(out, columns=columns)

    columns = ["shard", "salt", "role", "k", "k2", "at", "words"]
    return placed.mapInPandas(run, "shard int, salt int, role int, k long, k2 long, at int, words string")


def _held_against(passages: DataFrame, size: int) -> DataFrame:
    """(k, k2, first, after): spans that the automaton of a shard matches."""

    def run(batches):
        place, reference, automaton = None, [], None
        seen: dict[str, list] = {}  # copies stream once
        held = 0
        for pdf in batches:
            out = []
            for shard, salt, role, k, k2, at, words in pdf.itertuples(index=False):
                if (shard, salt) != place:
                    place, reference, automaton, seen, held = (shard, salt), [], None, {}, 0
                if role == 0:
                    reference.append(words)
                    continue
                if automaton is None:
                    automaton, reference = SuffixAutomaton(w.split(" ") for w in reference), []
                found = seen.get(words)
                if found is None:
                    found, held = automaton.spans(words.split(" "), size), held + len(words)
                    if held > 2_000_000:
                        seen, held = {}, len(words)
                    seen[words] = found
                out += [(k, k2, at + a, at + b) for a, b in found]
            yield pd.DataFrame(out, columns=["k", "k2", "first", "after"])

    ordered = passages.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "role")
    return ordered.mapInPandas(run, "k long, k2 long, first int, after int")


def mark_repeats(docs: DataFrame, size: int = 35, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row: ``rest`` (a struct of the columns other than text), ``text`` and ``spans`` (array of first and after, in words; null if none)."""
    spark = docs.sparkSession
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    k2 = F.xxhash64(F.lit("key"), "doc_id", "text")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("k"), k2.alias("k2"), rest.alias("rest"), F.col("text").cast("string").alias("text"))
    seeds = written(_seeds(rows, size))
    twice = seeds.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed")
    by_row = seeds.join(twice, "seed").groupBy("k").agg(F.collect_set("seed").alias("seeds"))
    kept = written(rows.join(by_row, "k", "left"), "zstd")  # whole texts, held to the end
    discard(seeds)
    release(spark)
    marked = kept.where("seeds is not null")

    windows = _windows(marked, size)
    owned = windows.groupBy("w").agg(F.count("*").alias("n"), F.min("k").alias("k"), F.min_by("at", "k").alias("at")).where("n > 1")
    repeated = written(owned.select("w", "k", "at", F.expr(f"at div {PART}").cast("int").alias("part")))
    release(spark)
    reference = written(_runs(repeated, size, "k", "part"))
    shards = max(1, -(-(reference.agg(F.sum("n")).first()[0] or 0) // shard_words))
    shard = F.pmod(F.xxhash64("k", "part"), F.lit(shards)).cast("int").alias("shard")
    routes = written(_runs(windows.join(repeated.select("w", shard), "w"), size, "k", "shard"))
    discard(repeated)
    release(spark)
    salts = routes.groupBy("shard").agg(F.ceil(F.sum("n") / STREAM_WORDS).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("k", F.lit("salt")), "salts").cast("int").alias("salt")
    each = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")  # the reference goes to all tasks of its shard

    def placed(parts: DataFrame, salt, role: int) -> DataFrame:
        """Documents with the runs that they send to a shard; those of one document are fewer than its windows."""
        route = F.struct("shard", salt, F.lit(role).alias("role"), "firsts", "lasts")
        at_places = parts.groupBy("k").agg(F.collect_list(route).alias("routes"))
        return _said(marked.select("k", "k2", "text").join(at_places, "k"), size)

    once = F.lit(0).alias("salt")  # of repeated rows one gives the reference
    own = placed(reference.select("k", shard, "firsts", "lasts"), once, 0).drop("salt").dropDuplicates(["k", "at"])
    sent = own.join(salts, "shard").select("shard", each, "role", "k", "k2", "at", "words")
    streamed = placed(routes.join(salts, "shard"), salt, 1)
    spans = _held_against(sent.unionByName(streamed), size).groupBy("k", "k2").agg(F.array_sort(F.collect_set(F.struct("first", "after"))).alias("spans"))
    found = written(spans)
    discard(routes, reference)
    release(spark)
    no_spans = F.lit(None).cast("array<struct<first:int,after:int>>").alias("spans")
    return marked.join(found, ["k", "k2"], "left").select("rest", "text", "spans").unionByName(kept.where("seeds is null").select("rest", "text", no_spans))


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans if spans is not None else ():
        a, b = s["first"], s["after"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_words(words: list, spans: list[tuple[int, int]]) -> list:
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    return out + words[at:]


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space inside them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b][0] if b < len(places) else len(text)
    return "".join(out) + text[at:]


def _cut(marked: DataFrame) -> DataFrame:
    """``rest``, ``text`` without the spans, and how many words it had and lost."""

    def run(batches):
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                spans = merged(spans)
                texts.append(cut_text(text, spans) if spans else text)
                counts.append(len(words_of(text)))
                gone.append(sum(b - a for a, b in spans))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=["rest", "text", "n_words", "n_removed"])

    return marked.mapInArrow(run, marked.select("rest", "text").schema.add("n_words", "long").add("n_removed", "long"))


def _columns(docs: DataFrame, without: tuple[str, ...] = ()):
    return [F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns if c not in without]


def remove_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from ``text``, and the columns ``n_words`` and ``n_removed`` (in place of any of these names)."""
    added = ("n_words", "n_removed")
    return _cut(mark_repeats(docs, size)).select(*_columns(docs, added), *added)


def cut_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from ``text``, without those of which nothing is left; columns unchanged."""
    return _cut(mark_repeats(docs, size)).where("n_removed < n_words or n_removed = 0").select(*_columns(docs))


def removal_digest(docs: DataFrame, size: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    marked = mark_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size).select(F.col("rest")["doc_id"].alias("doc_id"), "text", "spans")

    def digests(batch):
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = words_of(text)
            kept = kept_words(words, merged(spans))
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return [[o[i] for o in out] for i in range(3)]

    return beside(marked, ["doc_id"], {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}, digests)
