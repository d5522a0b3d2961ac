"""Scoring of whole texts with a gated recurrent language model, trained in Spark tasks.

1. Token counts over all training rows (sums before the shuffle); words are carried as 64-bit hashes.
2. The most frequent words, ``LISTED`` at most, go to every task; see :mod:`.gru` for the model. Their least count comes from a histogram
   of the counts, so only the listed words themselves ever reach the driver. All texts are then encoded once, as word numbers.
3. Training: every task runs truncated backpropagation over its training rows, starting from the common parameters; the tasks' parameters,
   weighted by their tokens, are averaged in two levels. ``ROUNDS`` rounds use disjoint rows (dealt by a hash) and together all training rows.
4. Scoring: all rows, with the state carried from the first to the last token. Words beyond the list are joined with the corpus
   counts, so every word's probability rests on its count over the whole corpus.

The probabilities of the known words and one unknown word sum to one, as those of the base score do.

Defined cases: null and empty texts are the end token alone; a null doc_id is a training row; without training rows every token is
unknown and scores 0 in both; repeated rows are scored each; a text of any length is scored whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, release, written
from .gru import Gru, Shape, Vocabulary
from .language_id import remainder
from .substring import hashes_of

LISTED = 65_536
ROUNDS = 2
#: Characters whose words are hashed at once; tokens that are learned or scored at once; parameters of a chunk in the averaging; tasks
#: averaged at the first level; steps of the histogram of counts for each doubling.
BLOCK_CHARS, BLOCK_TOKENS, CHUNK, FAN_IN, STEPS = 1_000_000, 1_000_000, 16_384, 32, 64
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only) and the end."""
    words = text.encode().lower().split() if isinstance(text, str) else []
    words.append(END)
    return words


def hashed_texts(texts: list[str | None]):
    """Token hashes of each text, block by block."""
    for part in blocks(texts, BLOCK_CHARS):
        tokens = [tokens_of(t) for t in part]
        flat = hashes_of([w for words in tokens for w in words])
        stops = np.cumsum([len(t) for t in tokens])
        yield from np.split(flat, stops[:-1])


def token_counts(rows: DataFrame) -> DataFrame:
    """(h, c) over the texts of ``rows``."""

    def run(batches):
        for pdf in batches:
            for part in blocks(pdf["text"].tolist(), 16 * BLOCK_CHARS):
                h, c = np.unique(np.concatenate(list(hashed_texts(part))), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "c": c})

    return rows.select("text").mapInPandas(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def round_of():
    """The round in which a row is learned; copies of a text under other ids are dealt apart."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit("draw")), F.lit(ROUNDS))


def listed_words(counts: DataFrame, listed: int) -> pd.DataFrame:
    """The most frequent words (h, c), by falling count: as many whole steps of the histogram of counts as fit into ``listed``."""
    step = F.floor(F.log2("c") * STEPS)
    words, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # some thousand steps at most
        words += r["n"]
        if words > listed:
            break
        least = r["step"]
    top = counts.where(step >= F.lit(least)).toPandas() if least is not None else pd.DataFrame({"h": [], "c": []})
    return top.sort_values(["c", "h"], ascending=[False, True])


def number_texts(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """k, doc_id, held_out, draw (the round), the word numbers, and what the base score needs: counts, logarithms, words beyond the list."""
    logs = np.r_[np.log10(words.counts + 0.5), 0.0]

    def run(batches):
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            for part in blocks(texts, BLOCK_CHARS):
                out: dict[str, list] = {c: [] for c in ("ids", "n_tokens", "listed", "logs", "tail", "times")}
                for h in hashed_texts(part):
                    own = words.ids(h)
                    beyond = np.flatnonzero(own == words.size)
                    tail, times = np.unique(h[beyond].view(np.int64), return_counts=True)
                    for c, v in zip(out, (own, len(own), len(own) - len(beyond), float(logs[own].sum()), tail, times), strict=True):
                        out[c].append(v)
                keys = (task << 40) + done + np.arange(len(part))
                head = batch.slice(at, len(part)).select(["doc_id", "held_out", "draw"])
                arrays = [pa.array(keys), *head.columns, *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "doc_id", "held_out", "draw", *out])
                at, done = at + len(part), done + len(part)

    kinds = [pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    schema = "k long, doc_id long, held_out boolean, draw int, ids array<int>, n_tokens long, listed long, logs double, tail array<long>, times array<long>"
    return rows.mapInArrow(run, schema)


def numbers_in(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("ids")
    stops = np.asarray(column.offsets)
    return np.split(column.values.to_numpy()[: stops[-1]], stops[1:-1]) if len(batch) else []


def train(rows: DataFrame, words: Vocabulary, numbered: bool = False) -> np.ndarray:
    """Parameters after ``ROUNDS`` rounds of averaged local training on rows of :func:`number_texts` (``numbered``) or of texts."""
    flat = Gru(words).flat
    for k in range(ROUNDS):
        now = flat

        def run(batches, now=now):
            model, seen = Gru(words, now.copy()), 0
            held, total = [], 0
            for batch in batches:  # learned in blocks of tokens, however the rows arrive
                for text in numbers_in(batch):
                    held.append(text)
                    total += len(text)
                    if total >= BLOCK_TOKENS:
                        seen += model.train(held)
                        held, total = [], 0
            if held:
                seen += model.train(held)
            if seen:
                task = TaskContext.get().partitionId()
                parts = [model.flat[a : a + CHUNK] for a in range(0, len(model.flat), CHUNK)]
                frame = pd.DataFrame({"chunk": range(len(parts)), "task": task // FAN_IN, "weight": float(seen), "part": [p.tobytes() for p in parts]})
                yield pa.RecordBatch.from_pandas(frame, pa.schema([("chunk", pa.int32()), ("task", pa.int32()), ("weight", pa.float64()), ("part", pa.binary())]))

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p, np.float32) * np.float64(w) for p, w in zip(pdf["part"], pdf["weight"], strict=True))
            weight = pdf["weight"].sum()
            return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "task": 0, "weight": weight, "part": [(total / weight).astype(np.float32).tobytes()]})

        schema = "chunk int, task int, weight double, part binary"
        if numbered:
            chosen = rows.where(F.col("draw") == k).select("ids")
        else:
            texts = rows.where(round_of() == k).select(F.lit(0).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), F.lit(k).alias("draw"), "text")
            chosen = number_texts(texts, words).select("ids")
        means = chosen.mapInArrow(run, schema).groupBy("chunk", "task").applyInPandas(mean, schema).groupBy("chunk").applyInPandas(mean, schema)
        got = {r["chunk"]: np.frombuffer(bytes(r["part"]), np.float32) for r in means.collect()}  # the parameters, of a fixed size
        if got:
            flat = np.concatenate([got[c] for c in sorted(got)])
    return flat


def score(docs: DataFrame, training, listed: int = LISTED, shape: Shape = Shape()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; ``training``: a condition on the rows that teach."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = written(token_counts(rows.where(training)))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = listed_words(counts, listed)
    head = top["c"].to_numpy(np.int64)
    rest = float(n - head.sum() + 0.5 * (v - len(head)) + 0.5)
    words = Vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), head.astype(np.float64), rest, shape)
    numbered = written(number_texts(rows.select("doc_id", (~training).alias("held_out"), round_of().cast("int").alias("draw"), "text"), words))
    release(docs.sparkSession)
    flat = train(numbered.where("not held_out"), words, numbered=True)

    def run(batches):
        model = Gru(words, flat)
        for batch in batches:
            ids, scores, total, at = numbers_in(batch), [], 0, 0
            for stop, text in enumerate(ids, 1):
                total += len(text)
                if total >= BLOCK_TOKENS or stop == len(ids):
                    scores.append(model.score(ids[at:stop]) / np.log(10))
                    at, total = stop, 0
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*keys, "own"])

    keys = ["k", "doc_id", "held_out", "n_tokens", "listed", "logs"]
    scored = written(numbered.select(*keys, "ids").mapInArrow(run, "k long, doc_id long, held_out boolean, n_tokens long, listed long, logs double, own double"))
    each = numbered.select("k", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("k", F.col("x.tail").alias("h"), F.col("x.times").alias("n"))
    met = each.join(counts, "h", "left")
    sums = met.groupBy("k").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"))
    sums = written(sums)
    discard(numbered, counts)
    whole = float(np.log10(n + 0.5 * (v + 1)))
    tail_logs = F.coalesce("more", F.lit(0.0))
    return scored.join(sums, "k", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("listed") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + tail_logs - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("own") + tail_logs - (F.col("n_tokens") - F.col("listed")) * float(np.log10(rest))).alias("score"),
    )


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 5 is not 1."""
    return score(docs, remainder(5) != 1)
