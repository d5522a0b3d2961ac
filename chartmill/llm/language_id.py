"""Language identification with spans: script ranges, word scores and Viterbi with a switching penalty.

Learning counts hashed character n-grams of words for every language, and letters for every language and script, over all labelled
training rows; the counts are summed in Spark, so the model has a fixed size for each language whatever the corpus.

Prediction: the script of a word (by code point ranges) leaves the languages that use it; each of those scores the word with smoothed
n-gram log-probabilities; Viterbi then labels the words of a text, paying a penalty for each switch of language. The predicted
language is that of most letters and the score is its share of the letters. Scores are looked up once for each distinct word; the recursion
runs over all texts of a batch at once.

Defined cases: null texts and texts without a letter give ``und`` and score 0; so does everything if nothing was learned. Ties go
to the language that sorts first. A text in a script that no learned language uses gets the commonest language with score 0. Rows are
independent, so repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, blocks

UNKNOWN = "und"
#: Hash buckets of n-grams.
BUCKETS = 1 << 15
#: Cost of a change of language between two words, in units of log-probability.
SWITCH = 12.0
#: A language uses a script if at least this share of its training letters is written in it.
SCRIPT_SHARE = 0.02
#: Characters of text scored at once, and distinct words kept by a Python worker.
BLOCK_CHARS, CACHE_WORDS = 1_000_000, 150_000
_RUN = re.compile(r"[^\W\d_]+")
#: Odd multipliers of the n-gram hash; the last two tell lengths apart.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)

#: First and last code points of scripts (Unicode blocks).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
NAMES = [*SCRIPTS, "other"]
_RANGES = sorted((a, b, k) for k, name in enumerate(SCRIPTS) for a, b in SCRIPTS[name])
_STARTS = [r[0] for r in _RANGES]


def script_of(word: str) -> int:
    """Index of the script of a word's first letter."""
    point = ord(word[0])
    k = bisect_right(_STARTS, point) - 1
    return _RANGES[k][2] if k >= 0 and point <= _RANGES[k][1] else len(SCRIPTS)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams (1 to 3, ends marked) and of each whole word, flat, and the number of them for each word.

    The buckets of a word lie together: its n-grams position by position, then the word.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    inside = np.arange(len(points)) - np.repeat(starts, lengths)
    left = np.repeat(lengths, lengths) - inside  # characters from here to the end
    padded = np.concatenate([points, np.zeros(2, np.uint64)])
    one = points * _MIX[0]
    two = one + padded[1:-1] * _MIX[1] + _MIX[4]
    three = one + padded[1:-1] * _MIX[1] + padded[2:] * _MIX[2] + _MIX[5]
    whole = np.add.reduceat(points * _MIX[3] ** (inside + 1).astype(np.uint64), starts)
    table = np.stack([one, two, three], 1)
    keep = np.stack([(inside > 0) & (left > 1), left > 1, left > 2], 1)
    n = np.add.reduceat(keep.sum(1), starts)
    flat = np.insert(table[keep], np.cumsum(n), whole)
    return ((flat ^ (flat >> np.uint64(29))) * _MIX[0] >> np.uint64(49)).astype(np.int64), n + 1


def letters(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(_RUN.findall(token)).lower()


def learn(labelled: DataFrame) -> dict:
    """Model from rows with ``text`` and ``lang``; rows that lack either teach nothing."""

    def run(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang", sort=False)["text"]:
                words: Counter = Counter()
                for text in texts:
                    words.update(text.split())
                pure: Counter = Counter()
                for token, n in words.items():
                    pure[letters(token)] += n
                pure.pop("", None)
                if not pure:
                    continue
                times = np.fromiter(pure.values(), np.float64, len(pure))
                sums = np.zeros(BUCKETS + len(NAMES))
                for part in range(0, len(pure), 50_000):
                    some, n = list(pure)[part : part + 50_000], times[part : part + 50_000]
                    buckets, each = grams(some)
                    sums += np.bincount(buckets, np.repeat(n, each), len(sums))
                    sums += np.bincount([BUCKETS + script_of(w) for w in some], n * [len(w) for w in some], len(sums))
                found = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "feature": found.astype(np.int32), "n": sums[found].astype(np.int64)})

    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInPandas(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS + len(NAMES), len(langs)))
    table[counts["feature"].to_numpy(int), counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = counts["n"]
    seen, scripts = table[:BUCKETS], table[BUCKETS:]
    logs = np.log((seen + 0.1) / (seen.sum(0) + 0.1 * BUCKETS))
    share = scripts / np.maximum(scripts.sum(0), 1)
    return {"langs": langs, "logs": logs.astype(np.float32), "uses": share >= SCRIPT_SHARE, "usual": int(scripts.sum(0).argmax()) if langs else 0}


class Labeller:
    """Word scores of a model, kept by word, and Viterbi over batches of texts."""

    def __init__(self, model: dict):
        self.model, self.size = model, len(model["langs"])
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.scores = np.zeros((1, self.size), np.float32)
        self.n_letters = np.zeros(1, np.int64)
        self.scored = np.zeros(1, bool)

    def add(self, tokens: list[str]) -> None:
        pure = [letters(t) for t in tokens]
        for k, token in enumerate(tokens):
            self.index[token] = len(self.n_letters) + k
        lengths = np.fromiter(map(len, pure), np.int64, len(pure))
        worded = np.flatnonzero(lengths)
        scores, scored = np.zeros((len(tokens), self.size), np.float32), np.zeros(len(tokens), bool)
        for part in range(0, len(worded), 20_000):
            at = worded[part : part + 20_000]
            words = [pure[k] for k in at.tolist()]
            buckets, each = grams(words)
            s = np.add.reduceat(self.model["logs"][buckets], np.cumsum(each) - each, axis=0)
            uses = self.model["uses"][[script_of(w) for w in words]]
            any_use = uses.any(1)
            s = np.where(uses, s, s.min(1, keepdims=True) - 50)
            scores[at] = np.where(any_use[:, None], s - s.max(1, keepdims=True), 0)
            scored[at] = any_use
        self.scores = np.concatenate([self.scores, scores])
        self.n_letters = np.concatenate([self.n_letters, lengths])
        self.scored = np.concatenate([self.scored, scored])

    def label(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language of each word of the token lists: flat labels, letters and whether a word counts."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        new = list({w for words in texts for w in words if w not in self.index})
        if new:
            self.add(new)
        lengths = np.array([len(w) for w in texts], np.int64)
        place = np.fromiter((self.index[w] for words in texts for w in words), np.int64, int(lengths.sum()))
        offsets = np.cumsum(lengths) - lengths
        by_length = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        active = np.searchsorted(-lengths[by_length], -np.arange(longest), side="left")  # texts longer than t
        ends = np.cumsum(active)
        rank = np.empty(len(texts), np.int64)
        rank[by_length] = np.arange(len(texts))
        doc = np.repeat(np.arange(len(texts)), lengths)
        t_of = np.arange(len(place)) - offsets[doc]
        step = (ends - active)[t_of] + rank[doc] if longest else t_of  # places of the words when they lie by t, then by length of text
        words = np.empty(len(place), np.int64)
        words[step] = place
        value = np.zeros((len(texts), self.size), np.float32)
        stay, best = np.empty((len(place), self.size), bool), np.empty(len(place), np.int16)
        bar = np.float32(-SWITCH)  # the best value of every text is 0 at each t
        spans = list(zip((ends - active).tolist(), ends.tolist(), active.tolist(), strict=True))
        for a, b, n in spans:
            v = value[:n]
            v.argmax(1, out=(top := np.empty(n, np.intp)))
            best[a:b] = top
            np.greater_equal(v, bar, out=stay[a:b])
            np.maximum(v, bar, out=v)
            v += self.scores[words[a:b]]
            v -= v.max(1, keepdims=True)
        state = value.argmax(1).astype(np.int16)
        found, own = np.empty(len(place), np.int16), np.arange(len(texts))
        for a, b, n in reversed(spans):
            s = state[:n]
            found[a:b] = s
            state[:n] = np.where(stay[a:b][own[:n], s], s, best[a:b])
        labels = found[step]
        return labels, self.n_letters[place], self.scored[place]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int]]]]:
        """Language, score and spans (language, words) of each text."""
        out: list = []
        for part in blocks(texts, BLOCK_CHARS):
            out += self._block([t.split() if t else [] for t in part])
        return out

    def _block(self, tokens: list[list[str]]) -> list[tuple[str, float, list[tuple[str, int]]]]:
        langs = self.model["langs"]
        if not self.size:
            return [(UNKNOWN, 0.0, [])] * len(tokens)
        labels, n, scored = self.label(tokens)
        lengths = np.array([len(w) for w in tokens])
        doc = np.repeat(np.arange(len(tokens)), lengths)
        sums = np.bincount(doc * self.size + labels, n * scored, len(tokens) * self.size).reshape(-1, self.size)
        total = np.bincount(doc, n, len(tokens))
        change = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])]) if len(labels) else np.zeros(0, int)
        spans: list[list[tuple[str, int]]] = [[] for _ in tokens]
        for a, b in zip(change.tolist(), [*change[1:].tolist(), len(labels)], strict=False):
            spans[doc[a]].append((langs[labels[a]], b - a))
        out = []
        for k in range(len(tokens)):
            if not total[k]:
                out.append((UNKNOWN, 0.0, []))
            else:
                best = int(sums[k].argmax()) if sums[k].any() else self.model["usual"]
                out.append((langs[best], float(sums[k][best] / total[k]), spans[k]))
        return out


def predictor(model: dict):
    """``Labeller(model).predict``, with the labeller made when a task first needs it and kept for its batches."""
    held: list[Labeller] = []

    def predict(texts):
        if not held:
            held.append(Labeller(model))
        return held[0].predict(texts)

    return predict


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and spans (array of lang and words), in place of any columns of these names."""

    predict = predictor(model)

    def labels(batch):
        found = predict(batch.column(text).to_pylist())
        return [f[0] for f in found], [f[1] for f in found], [[{"lang": a, "words": b} for a, b in f[2]] for f in found]

    added = {"lang_pred": "string", "score": "double", "spans": "array<struct<lang:string,words:long>>"}
    return beside(docs, [c for c in docs.columns if c not in added], added, labels)


def remainder(by: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % by


def identify_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows whose crc32(doc_id) mod 3 is not 1."""
    held = remainder(3) == 1
    model = learn(docs.where(~held))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")

    predict = predictor(model)

    def labels(batch):
        found = predict(batch.column("text").to_pylist())
        return [f[0] for f in found], [f[1] for f in found]

    return beside(rows, ["doc_id", "held_out"], {"lang_pred": "string", "score": "double"}, labels)


def keep_identified(docs: DataFrame, model: dict, share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose main language has at least ``share`` of their letters; columns unchanged."""

    def run(batches):
        labeller = Labeller(model)
        for batch in batches:
            found = labeller.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([f[0] != UNKNOWN and f[1] >= share for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
