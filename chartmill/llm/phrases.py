"""Collocations: phrases of two and three words that occur together more than their parts would.

1. Blocks. Texts become rows of about ``BLOCK`` words of one language, encoded by a dictionary of the block's own. A text longer than a block
   goes on in the next, which begins with the last two words as context, so no phrase is lost or counted twice.
2. Dictionary. Block dictionaries are summed by (language, word); words of ``least`` occurrences and more get numbers from 1 without gaps.
   Each block gets the numbers of its own words back by a join, so no task holds the whole dictionary.
3. Counting. Numbers of two and three neighbours, broken at delimiters and rare words, are packed into a key of fixed width (64 bits where
   three numbers fit, else 128), scrambled by a bijection and sorted by radix in the block, equal keys reduced to their count. Ranges of
   the scrambled keys are the buckets: a frequent phrase comes once for each block, and distinct phrases spread evenly. A bucket is sorted
   by radix and its runs are summed.
4. Scores. Counts of parts are joined to phrases, arithmetic is decimal; a phrase within a longer candidate of half its count goes.

Defined cases: a null text is empty, a null language is ``und``; empty and blank texts and an empty table give nothing; repeated rows count as
often as they occur; ties of the score go by a, then by the phrase's bytes; a null doc_id and extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written
from .exchange import REQUEST, by_bucket, radix_order, request, starts

#: Words of one block.
BLOCK = 2_000_000
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
#: Words, phrases and numbers that may be broadcast; larger tables are joined by shuffle.
BROADCAST = 200_000
#: Keys of one bucket, about; parts in which the keys of a block are sorted.
BUCKET, RANGES = 1_000_000, 16

#: A-Z to a-z; every delimiter to a comma; tab to space.
CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz ,,,,,,,,,")
BLOCKS = "block long, lang string, size long, context int, tokens binary, words array<string>, counts array<long>"


def slices(data: bytes):
    """Parts of about :data:`SLICE` bytes, cut at spaces and delimiters; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b",", at, end))
            if cut < at:
                after = [p for p in (data.find(b" ", end), data.find(b",", end)) if p >= 0]
                cut = min(after) if after else len(data)
            end = cut + 1
        yield data[at:end]
        at = end


class Block:
    """Tokens of one language: 0 for a break, else the number of a word in the block's dictionary."""

    def __init__(self, context: list[bytes] = ()):
        self.numbers: dict[bytes, int] = {b",": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.context = len(context)
        if context:
            self.add(context)

    def add(self, words: list[bytes]) -> None:
        number, numbers = self.numbers.setdefault, self.numbers
        self.parts.append(np.array([number(w, len(numbers)) for w in words], np.uint32))
        self.size += len(words)

    def row(self, block: int, lang: str) -> tuple:
        tokens = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        counts = np.bincount(tokens[self.context :], minlength=len(self.numbers))[1:]
        narrow = tokens.astype(np.uint16) if len(self.numbers) < 1 << 16 else tokens
        return block, lang, self.size - self.context, self.context, narrow.tobytes(), [w.decode() for w in self.numbers][1:], counts

    def last(self, n: int) -> list[bytes]:
        words, tail = list(self.numbers), []
        for part in reversed(self.parts):
            tail = [*part[max(0, len(part) - n + len(tail)) :].tolist(), *tail]
            if len(tail) >= n:
                break
        return [words[k] for k in tail[-n:]]


def encoded(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        base, made, open_ = TaskContext.get().partitionId() << 32, 0, {}

        def out(langs):
            nonlocal made
            rows = []
            for lang in langs:
                rows.append(open_[lang].row(base + made, lang))
                made += 1
            names = [f.split()[0] for f in BLOCKS.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for words in slices((text.as_py() or "").encode().translate(CLEAN)):
                    own = open_.setdefault(lang, Block())
                    tokens = words.replace(b",", b" , ").split()
                    while tokens:
                        own.add(tokens[: size - own.size + own.context])
                        tokens = tokens[len(own.parts[-1]) :]
                        if own.size - own.context >= size:
                            yield out([lang])
                            own = open_[lang] = Block(own.last(2))
                if lang in open_:
                    open_[lang].add([b","])
            if sum(b.size for b in open_.values()) >= size:
                yield out(list(open_))
                open_ = {}
        if open_:
            yield out(list(open_))

    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(run, BLOCKS)


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with ``id`` from 1 without gaps; the driver sees one number for each partition."""
    placed = written(words.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))))
    before, first = 0, []
    for r in sorted(placed.groupBy("part").agg((F.max("place") + 1).alias("n")).collect()):
        first.append((r["part"], before))
        before += r["n"]
    offsets = words.sparkSession.createDataFrame(first, "part long, before long")
    return placed.join(F.broadcast(offsets), "part").select("lang", "word", "n", (F.col("before") + F.col("place") + 1).alias("id"))


def bits_of(most: int) -> int:
    return max(1, most.bit_length())


def pack(first: np.ndarray, second: np.ndarray, third: np.ndarray, bits: int) -> list[np.ndarray]:
    """Key words, most significant first: one of 3 ``bits`` where 64 hold them, else two. A pair has 0 in the first place."""
    if 3 * bits <= 64:
        return [first << np.uint64(2 * bits) | second << np.uint64(bits) | third]
    return [first << np.uint64(24) | second >> np.uint64(16), (second & np.uint64(0xFFFF)) << np.uint64(40) | third]


def unpack(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    if len(words) == 1:
        mask = np.uint64((1 << bits) - 1)
        return [words[0] >> np.uint64(2 * bits), words[0] >> np.uint64(bits) & mask, words[0] & mask]
    high, low = words
    return [high >> np.uint64(24), (high & np.uint64(0xFFFFFF)) << np.uint64(16) | low >> np.uint64(40), low & np.uint64((1 << 40) - 1)]


class Scramble:
    """A bijection of numbers of so many bits, which spreads neighbouring keys over the whole range: xor by the upper half, times an odd number, twice."""

    FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self, bits: int):
        self.mask, self.half = (1 << bits) - 1, np.uint64((bits + 1) // 2)
        self.forth = [np.uint64(f & self.mask | 1) for f in self.FACTORS]
        self.back = [np.uint64(pow(int(f), -1, 1 << bits)) for f in self.forth]
        self.mask = np.uint64(self.mask)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for f in self.forth:
            x = (x ^ x >> self.half) * f & self.mask
        return x ^ x >> self.half

    def undo(self, x: np.ndarray) -> np.ndarray:
        for f in reversed(self.back):
            x = (x ^ x >> self.half) * f & self.mask
        return x ^ x >> self.half


def key_bits(bits: int) -> int:
    """Bits of the first key word."""
    return 3 * bits if 3 * bits <= 64 else 64


def reduced(words: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = radix_order(words)
    words = [w[order] for w in words]
    at = starts(words)
    sums = np.diff(np.append(at, len(order))) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    return [w[at] for w in words], sums


def phrase_counts(blocks: DataFrame, bits: int, buckets: int, least: int, parts: int) -> DataFrame:
    """(a_id, b_id, c_id, n) of all pairs (a_id 0) and triples of at least ``least`` occurrences. ``blocks`` has the numbers of its words in ``ids``
    and their number, the rare ones included, in ``vocabulary``."""
    shift = np.uint64(max(0, key_bits(bits) - bits_of(buckets - 1))) if buckets > 1 else None

    def deal(batches):
        mix = Scramble(key_bits(bits))
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in ("block", "context", "tokens", "at", "ids", "vocabulary")}
                table = np.zeros(row["vocabulary"].as_py() + 1, np.uint64)
                if row["at"].is_valid:
                    table[np.asarray(row["at"].values) + 1] = np.asarray(row["ids"].values)
                raw = row["tokens"].as_py()
                tokens = np.frombuffer(raw, np.uint16 if len(table) < 1 << 16 else np.uint32)
                ids, skip = table[tokens], row["context"].as_py()
                two = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                three = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))
                two, three = two[two >= skip - 1], three[three >= skip - 2]
                keys = [np.concatenate(x) for x in zip(pack(np.zeros(len(two), np.uint64), ids[two], ids[two + 1], bits), pack(ids[three], ids[three + 1], ids[three + 2], bits), strict=True)]
                del ids, two, three
                if not len(keys[0]):
                    continue
                keys[0] = mix(keys[0] ^ (keys[1] * np.uint64(Scramble.FACTORS[0]) if len(keys) > 1 else np.uint64(0)))
                for own in ranges(keys, shift, buckets):
                    words, counts = reduced(own)
                    bucket = (words[0] >> shift).astype(np.int64) if shift is not None else np.zeros(len(counts), np.int64)
                    edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=bucket[-1] + 1))
                    pieces = [packed([w[a:b] for w in words], counts[a:b], shift) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                    yield request(row["block"].as_py(), bucket[edge[:-1]].tolist(), pieces)

    def count(bucket, _, payloads):
        mix = Scramble(key_bits(bits))
        width = 1 if 3 * bits <= 64 else 2
        read = [unpacked(p, width, bucket, shift) for p in payloads]
        words, n = reduced([np.concatenate([r[0][k] for r in read]) for k in range(width)], np.concatenate([r[1] for r in read]))
        kept = n >= least
        words, n = [w[kept] for w in words], n[kept]
        words[0] = mix.undo(words[0]) ^ (words[1] * np.uint64(Scramble.FACTORS[0]) if width > 1 else np.uint64(0))
        ids = [x.astype(np.int64) for x in unpack(words, bits)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(n.astype(np.int64))], ["a_id", "b_id", "c_id", "n"])

    dealt = blocks.select("block", "context", "tokens", "at", "ids", "vocabulary").mapInArrow(deal, REQUEST)
    return by_bucket(dealt, parts, count, "a_id long, b_id long, c_id long, n long")


def ranges(keys: list[np.ndarray], shift: np.uint64 | None, buckets: int):
    """The keys in parts of whole buckets, ``RANGES`` at most: what sorting takes is held for one part, not for a block."""
    parts = min(RANGES, buckets)
    if parts < 2:
        yield keys
        return
    part = (keys[0] >> (shift + np.uint64(bits_of(buckets // parts) - 1))).astype(np.uint8)
    for k in range(parts):
        own = part == k
        if own.any():
            yield [w[own] for w in keys]


def packed(words: list[np.ndarray], counts: np.ndarray, shift: np.uint64 | None) -> bytes:
    """Keys (the first word without the bits that the bucket gives, in as few bytes as hold it), those that occur once before the others, then the others' counts."""
    once = counts == 1
    order = np.argsort(~once, kind="stable")
    low = words[0] & np.uint64((1 << int(shift)) - 1) if shift is not None else words[0]
    width = -(-int(shift) // 8) if shift is not None else 8
    head = np.array([len(order), once.sum()], "<u8").tobytes()
    first = low[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return head + first + b"".join(w[order].tobytes() for w in words[1:]) + counts[order][once.sum() :].astype("<u8").tobytes()


def unpacked(payload: bytes, words: int, bucket: int, shift: np.uint64 | None) -> tuple[list[np.ndarray], np.ndarray]:
    n, once = (int(x) for x in np.frombuffer(payload, "<u8", 2))
    width = -(-int(shift) // 8) if shift is not None else 8
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = np.frombuffer(payload, np.uint8, n * width, 16).reshape(width, n).T
    first = low.reshape(-1).view("<u8") | (np.uint64(bucket) << shift if shift is not None else np.uint64(0))
    at = 16 + n * width
    more = [np.frombuffer(payload, "<u8", n, at + 8 * n * k) for k in range(words - 1)]
    counts = np.ones(n, np.int64)
    counts[once:] = np.frombuffer(payload, "<u8", n - once, at + 8 * n * (words - 1))
    return [first, *more], counts


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)); a decimal of 38 digits holds the products of counts up to 10^16."""
    a, left, right = (x.cast("decimal(38,0)") for x in (a, left, right))
    return F.call_function("div", (a * a).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(38,0)"), (left * right).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, share: int = 50, block: int = BLOCK, wide: bool = False) -> DataFrame:
    """Per language the first ``most`` phrases: lang, rank, phrase, a, l, r, n, score. ``wide`` forces keys of 128 bits."""
    spark = docs.sparkSession
    blocks = written(encoded(docs, block))
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n"))
    own = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    words = own.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n")).where(F.col("n") >= least)
    known = written(numbered(words))
    size, occurrences = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = 40 if wide else bits_of(size)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << bits_of(max(4 * parts, 2 * occurrences // BUCKET) - 1)
    found = own.select("block", "at", "lang", F.col("w.words").alias("word")).join(known.select("lang", "word", "id"), ["lang", "word"])
    per_block = found.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("found")).select("block", F.col("found.at").alias("at"), F.col("found.id").alias("ids"))
    plain = blocks.select("block", "context", "tokens", F.size("words").alias("vocabulary"))  # the words themselves stay behind
    counted = written(phrase_counts(plain.join(per_block, "block"), bits, buckets, least, parts))

    one = known.select("id", "lang", "word", F.col("n").alias("f"))
    two = counted.where("a_id = 0").select(F.col("b_id").alias("x"), F.col("c_id").alias("y"), "n")
    three = counted.where("a_id > 0").select(F.col("a_id").alias("x"), F.col("b_id").alias("y"), F.col("c_id").alias("z"), "n")

    def word(table: DataFrame, column: str, name: str) -> DataFrame:
        return table.join(sized(one.select(F.col("id").alias(column), F.col("f").alias(f"f_{name}"), F.col("word").alias(name), F.col("lang").alias(f"lang_{name}")), BROADCAST), column)

    def pair(table: DataFrame, x: str, y: str, name: str) -> DataFrame:
        return table.join(sized(two.select(F.col("x").alias(x), F.col("y").alias(y), F.col("n").alias(name)), BROADCAST), [x, y])

    longer = three.select("x", "y", "n").unionByName(three.select(F.col("y").alias("x"), F.col("z").alias("y"), "n")).groupBy("x", "y").agg(F.max("n").alias("longer"))
    pairs = two.join(longer, ["x", "y"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n"))).drop("longer")
    pairs = word(word(pairs, "x", "first"), "y", "second")
    pairs = pairs.select(F.col("lang_first").alias("lang"), F.concat_ws(" ", "first", "second").alias("phrase"), F.col("n").alias("a"), F.col("f_first").alias("l"), F.col("f_second").alias("r"), exact_score(F.col("n"), F.col("f_first"), F.col("f_second")).alias("score"))
    triples = pair(pair(word(word(word(three, "x", "first"), "y", "second"), "z", "third"), "x", "y", "xy"), "y", "z", "yz")
    triples = triples.withColumn("s1", exact_score(F.col("n"), F.col("f_first"), F.col("yz"))).withColumn("s2", exact_score(F.col("n"), F.col("xy"), F.col("f_third")))
    early = F.col("s1") <= F.col("s2")
    triples = triples.select(
        F.col("lang_first").alias("lang"), F.concat_ws(" ", "first", "second", "third").alias("phrase"), F.col("n").alias("a"),
        F.when(early, F.col("f_first")).otherwise(F.col("xy")).alias("l"), F.when(early, F.col("yz")).otherwise(F.col("f_third")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
