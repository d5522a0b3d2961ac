"""Removal of byte strings that repeat, by a distributed suffix array built over a difference cover.

Suffixes are sorted where content says so: at boundaries, the positions whose 16-byte hash is the least of ``SPAN`` in a row. Equal strings have
the same boundaries, so every window of ``size`` bytes belongs to the boundary that is the least of its own first hashes, in all its
occurrences, and a text is a string of phrases (the hashes of the bytes between boundaries), some thirty times shorter.

1. Runs. Each window has an anchor, the least hash of all in it; only windows whose anchor occurs twice can repeat. They are cut out of one copy
   of every text, with the bytes they cover, into blocks.
2. Sampled triples. Of the phrases of a run those at places 1 and 2 modulo 3 (a difference cover) are the sample. Their triples are sorted over
   ranges of buckets and named by their rank.
3. Recursion on names. Names at distances of 3, 9, ... form the next triples, until a name covers more than a window in every run.
4. Remaining suffixes. Any two places have a common distance of at most 2 to sampled ones. So the suffixes at places 0 and 1 are sorted by (phrase,
   name of the next), those at 0 and 2 by (two phrases, name of the one after), those at 1 and 2 by their names, and every pair meets in one order.
5. Adjacent prefixes. In each order, neighbours are compared on the phrases that all windows of a boundary share, and on all the bytes that its
   windows cover together. If the first are unequal on both sides, no window of the boundary repeats; if the second are equal, all do.
6. Windows at the ends of repeats, where neither holds, are counted one by one, by 128 bits of their own, with one copy of those they may equal.

Blocks, buckets and replies are those of :mod:`.exchange`: a block sends a record once however often it holds it, so a passage of a third of all
documents comes to its bucket once for each block. Strings are told apart by 128 bits.

Defined cases: a null text is empty; a text shorter than ``size`` keeps everything; repeated rows (and rows that repeat only the text) are
occurrences of their own, so all lose everything from ``size`` bytes on; matches never cross documents; a null doc_id is a document like any
other; an empty table gives no rows; extra columns are kept by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with, text_key, written
from .exchange import REQUEST, by_bucket, request, starts, with_replies

#: Hashes of which a boundary is the least; bytes of a hash at a boundary, and at an anchor.
SPAN, GRAM, ANCHOR = 64, 16, 32
#: Bytes of one block, about.
BLOCK = 4_000_000
#: Phrases for one bucket, at least and at most, about.
LEAST, MOST = 25_000, 200_000
#: Records of the sample that sets the ranges of the buckets.
SAMPLE = 40_000
OPEN, ALL, SHOWN = np.uint8(1), np.uint8(2), np.uint8(4)
U = np.uint64
PLACE = U((1 << 24) - 1)
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(31)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(29)) * U(0x94D049BB133111EB)
    return x ^ x >> U(32)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (a multiple of 8) from each position on."""
    words = np.ndarray((max(0, data.size - 7),), "<u8", data, strides=(1,)).copy() if data.size >= 8 else np.zeros(0, U)
    n = max(0, data.size - size + 1)
    h = words[:n] * U(ODD[0])
    for k in range(8, size, 8):
        h = (h ^ h >> U(29)) * U(ODD[1]) + words[k : k + n]
    return mixed(h)


def least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many hashes the place of its least one (by its upper 40 bits), the first of equals."""
    n, step = hashes.size - width + 1, 1 << 22
    if n > step:
        return np.concatenate([least(hashes[a : a + step + width - 1], width) + a for a in range(0, n, step)])
    if n < 1:
        return np.zeros(0, np.int64)
    key = hashes & ~PLACE | np.arange(hashes.size, dtype=U)
    reach = 1
    while 2 * reach <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[: key.size - (width - reach)], key[width - reach :])
    return (key & PLACE).astype(np.int64)


def changes(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return starts([values]) if len(values) else np.zeros(0, np.int64)


class Prints:
    """Hashes of any stretch of a sequence of numbers, from running sums: two of 64 bits."""

    powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, values: np.ndarray, ways: int = 2):
        if not self.powers or len(self.powers[0][0]) <= len(values):
            n = max(1 << 16, 2 * len(values))
            Prints.powers = [tuple(np.multiply.accumulate(np.full(n, f, U)) for f in (odd, pow(odd, -1, 1 << 64))) for odd in ODD]
        self.sums = [np.concatenate(([U(0)], np.cumsum((mixed(values + U(k)) if k else values) * self.powers[k][0][: len(values)], dtype=U))) for k in range(ways)]

    def of(self, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [mixed((s[end] - s[begin]) * self.powers[k][1][begin]) for k, s in enumerate(self.sums)]


def anchors_of(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash) of each anchor."""
    h = grams(data, ANCHOR)
    at = least(h, size - ANCHOR + 1)
    first = changes(at)
    return first, np.append(first[1:], len(at)) - 1, h[at[first]]


def parsed(data: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Boundaries and phrases of a run, and of each boundary with windows (a unit): its first and last window, and the hashes that are compared."""
    h = grams(data, GRAM)
    at = least(h, SPAN)
    bounds = at[changes(at)]
    sums = Prints(h, 1)
    phrase = np.append(sums.of(bounds[:-1], bounds[1:])[0] | U(1), U(0))
    own = at[: data.size - size + 1]
    first = changes(own)
    last = np.append(first[1:], len(own)) - 1
    unit = np.searchsorted(bounds, own[first])
    f = bounds[unit]
    # all windows of f begin after f - SPAN, so they cover what decides the boundary of the hashes from here on
    shared = at[f + (size + 2 - 2 * SPAN - GRAM)]
    common = sums.of(f, shared)[0]
    every = mixed(sums.of(first, last + size - GRAM + 1)[0] + (f - first).astype(U) * U(ODD[0]) + (last - first).astype(U) * U(ODD[1]))
    return {"bounds": bounds, "phrase": phrase, "unit": unit, "first": first, "last": last, "common": common, "every": every}


def key_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)


def anchor_table(texts: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            seen, found = set(), []
            for k1, k2, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                key = (k1.as_py(), k2.as_py())
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                if key not in seen and data.size >= size:
                    seen.add(key)
                    found.append((key, anchors_of(data, size)))
            if found:
                n = [len(a[0]) for _, a in found]
                first, last, h = (np.concatenate([a[k] for _, a in found]) for k in range(3))
                text = np.repeat(np.arange(len(found)), n)
                order = np.lexsort((h, text))
                same = np.zeros(len(h) + 1, bool)
                same[1:-1] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
                twice = np.zeros(len(h), bool)
                twice[order] = same[1:] | same[:-1]
                keys = [pa.array(np.repeat(np.array([k[i] for k, _ in found], np.int64), n)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64)), pa.array(h.view(np.int64)), pa.array(twice)], ["k1", "k2", "first", "last", "h", "twice"])

    return texts.mapInArrow(run, "k1 long, k2 long, first long, last long, h long, twice boolean")


RUNS = ["block", "k1", "k2", "start", "length", "raw"]


def run_blocks(texts: DataFrame, size: int) -> DataFrame:
    """Texts with ``found`` (the windows that may repeat) to blocks of runs. Copies of a text follow each other and are taken once."""

    def run(batches):
        from pyspark import TaskContext

        base, made, before, k1s, k2s, at, raw = TaskContext.get().partitionId() << 32, 0, None, [], [], [], []

        def out():
            packed = [np.array(x, np.int64).tobytes() for x in (k1s, k2s, at, [len(r) for r in raw])]
            return key_batch([(base + made, *packed, b"".join(raw))], RUNS, [pa.int64()] + [pa.binary()] * 5)

        held = 0
        for batch in batches:
            for k1, k2, text, found in zip(*(batch.column(i) for i in range(4)), strict=True):
                key = (k1.as_py(), k2.as_py())
                if key == before:
                    continue
                before, data = key, text.as_py().encode()
                first, last = (np.asarray(found.values.field(i)) for i in (0, 1))
                order = np.argsort(first, kind="stable")
                first, last = first[order], last[order]
                new = np.append(True, first[1:] > last[:-1] + 1)
                for a, b in zip(first[new].tolist(), last[np.append(new[1:], True)].tolist(), strict=True):
                    k1s.append(key[0])
                    k2s.append(key[1])
                    at.append(a)
                    raw.append(data[a : b + size])
                    held += b + size - a
                if held >= BLOCK:
                    yield out()
                    made, held, k1s, k2s, at, raw = made + 1, 0, [], [], [], []
        if raw:
            yield out()

    return texts.select("k1", "k2", "text", "found").mapInArrow(run, "block long, k1 binary, k2 binary, start binary, length binary, raw binary")


def runs_of(row: dict) -> list[np.ndarray]:
    ends = np.cumsum(np.frombuffer(row["length"], np.int64))
    return np.split(np.frombuffer(row["raw"], np.uint8), ends[:-1])


def rows_in(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


PARSED = ["counts", "names", "unit", "first", "last", "common", "every", "units"]


def parse_table(runs: DataFrame, size: int, levels: int) -> DataFrame:
    """Phrases and units of each block, and ``cover``: the fewest bytes that 3, 9, 27, ... phrases cover."""

    def run(batches):
        for row in rows_in(batches):
            found, cover, base = [], np.full(levels, 1 << 40), 0
            for data in runs_of(row):
                p = parsed(data, size)
                for k in range(levels):
                    if 3 ** (k + 1) < len(p["bounds"]):
                        cover[k] = min(cover[k], int((p["bounds"][3 ** (k + 1) :] - p["bounds"][: -(3 ** (k + 1))]).min()))
                p["unit"] = p["unit"] + base
                base += len(p["bounds"])
                found.append(p)
            join = lambda name, kind: np.concatenate([p[name] for p in found]).astype(kind).tobytes()
            counts = np.array([len(p["bounds"]) for p in found], np.int64).tobytes()
            units = np.array([len(p["unit"]) for p in found], np.int64).tobytes()
            packed = [counts, join("phrase", U), join("unit", np.int32), join("first", np.int32), join("last", np.int32), join("common", U), join("every", U), units]
            yield key_batch([(row["block"], *packed, cover.tolist())], ["block", *PARSED, "cover"], [pa.int64()] + [pa.binary()] * 8 + [pa.list_(pa.int64())])

    return runs.mapInArrow(run, "block long, " + ", ".join(f"{c} binary" for c in PARSED) + ", cover array<long>")


class Places:
    """Places of a block's phrases in their runs."""

    def __init__(self, counts: bytes):
        counts = np.frombuffer(counts, np.int64)
        self.end = np.repeat(np.cumsum(counts), counts)
        self.at = np.arange(len(self.end))
        self.third = (self.at - np.repeat(np.cumsum(counts) - counts, counts)) % 3

    def ahead(self, values: np.ndarray, by: int) -> np.ndarray:
        """What stands ``by`` places further on in the run; 0 beyond its end."""
        to = self.at + by
        return np.where(to < self.end, values[np.minimum(to, max(0, len(values) - 1))], U(0)) if len(values) else values

    def triples(self, names: np.ndarray, by: int) -> tuple[np.ndarray, list[np.ndarray]]:
        sample = np.flatnonzero(self.third)
        return sample, [names[sample], self.ahead(names, by)[sample], self.ahead(names, 2 * by)[sample]]


def unique(words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct records in order, the number of each record among them, and how often each occurs."""
    order = np.lexsort(words[::-1])
    words = [w[order] for w in words]
    at = starts(words)
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
    return [w[at] for w in words], number, np.diff(np.append(at, len(order)))


def cuts(words: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """Where sorted records pass each splitter."""
    found = []
    for s in splitters:
        a, b = 0, len(words[0])
        for w, x in zip(words, s, strict=True):
            a, b = a + np.searchsorted(w[a:b], x, "left"), a + np.searchsorted(w[a:b], x, "right")
        found.append(a)
    return np.array([0, *found, len(words[0])], np.int64)


def ranges(state: DataFrame, records, buckets: int, blocks: int) -> np.ndarray:
    """Splitters from a bounded sample of the records of a bounded sample of the blocks. ``records(row)``: lists of words."""
    each = max(8, SAMPLE // max(1, blocks))

    def run(batches):
        for row in rows_in(batches):
            for kind, words in enumerate(records(row)):
                if n := len(words[0]):
                    chosen = np.random.default_rng(row["block"]).integers(0, n, min(n, each))
                    yield request(row["block"], [kind], [np.stack([w[chosen] for w in words[:3]]).tobytes()])

    some = state if blocks * 8 <= SAMPLE else state.sample(SAMPLE / (8 * blocks), seed=0)
    found: dict[int, list[np.ndarray]] = {}
    for r in some.mapInArrow(run, REQUEST).select("bucket", "payload").collect():
        found.setdefault(r["bucket"], []).append(np.frombuffer(r["payload"], U).reshape(3, -1).T)
    out = []
    for kind in range(max(found, default=0) + 1):
        rows = np.concatenate(found.get(kind, [np.zeros((0, 3), U)]))
        rows = rows[np.lexsort(rows.T[::-1])]
        out.append(rows[np.linspace(0, len(rows) - 1, min(buckets, len(rows)) + 1).astype(int)[1:-1]] if len(rows) > 1 else rows[:0])
    return out


def dealt(row_block: int, words: list[np.ndarray], more: np.ndarray, splitters: np.ndarray, base: int):
    """Requests of sorted records with one byte each, by ranges of their first three words; buckets without records are left out."""
    edge = cuts(words[:3], splitters)
    full = np.flatnonzero(np.diff(edge))
    return request(row_block, (full + base).tolist(), [b"".join([more[a:b].tobytes(), *(w[a:b].tobytes() for w in words)]) for a, b in ((edge[k], edge[k + 1]) for k in full)])


def read_dealt(payloads: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Words and the byte of all records, and where each payload ends."""
    sizes = [len(p) // (1 + 8 * width) for p in payloads]
    words = [np.concatenate([np.frombuffer(p, U, n, n + 8 * n * k) for p, n in zip(payloads, sizes, strict=True)]) for k in range(width)]
    return words, np.concatenate([np.frombuffer(p, np.uint8, n) for p, n in zip(payloads, sizes, strict=True)]), np.cumsum(sizes)


def named(state: DataFrame, by: int, buckets: int, blocks: int, parts: int) -> DataFrame:
    """One level of names: ``state`` is (block, counts, names); a name is (bucket, rank in it), so names order as their triples do."""

    def triples(row):
        return Places(row["counts"]).triples(np.frombuffer(row["names"], U), by)

    splitters = ranges(state, lambda row: [triples(row)[1]], buckets, blocks)[0]

    def ask(batches):
        for row in rows_in(batches):
            words, _, n = unique(triples(row)[1])
            if len(n):
                yield dealt(row["block"], words, np.zeros(len(n), np.uint8), splitters, 0)

    def answer(bucket, who, payloads):
        words, _, ends = read_dealt(payloads, 3)
        names = U(bucket) << U(40) | (unique(words)[1] + 1).astype(U)
        for block, own in zip(who, np.split(names, ends[:-1]), strict=True):
            yield request(block, [bucket], [own.tobytes()])

    def apply(batches):
        for row in rows_in(batches):
            sample, words = triples(row)
            names = np.zeros(len(row["names"]) // 8, U)
            if len(sample):
                names[sample] = np.frombuffer(b"".join(r["payload"] for r in row["replies"]), U)[unique(words)[1]]
            yield key_batch([(row["block"], row["counts"], names.tobytes())], ["block", "counts", "names"], [pa.int64(), pa.binary(), pa.binary()])

    replies = by_bucket(state.mapInArrow(ask, REQUEST), parts, answer, REQUEST)
    return written(with_replies(state, replies).mapInArrow(apply, "block long, counts binary, names binary"))


def orders(row: dict) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """The three orders of a block's units: (numbers of the units, [three words of the key, the common hash, the hash of everything])."""
    places, phrase, names, unit = Places(row["counts"]), np.frombuffer(row["names"], U), np.frombuffer(row["ranks"], U), np.frombuffer(row["unit"], np.int32)
    common, every = np.frombuffer(row["common"], U), np.frombuffer(row["every"], U)
    third = places.third[unit]
    zero, out = np.zeros(len(names), U), []
    keys = [(phrase, places.ahead(names, 1), zero), (phrase, places.ahead(phrase, 1), places.ahead(names, 2)), (names, zero, zero)]
    for left_out, key in zip((2, 1, 0), keys, strict=True):
        chosen = np.flatnonzero(third != left_out)
        out.append((chosen, [*(k[unit[chosen]] for k in key), common[chosen], every[chosen]]))
    return out


def compared(state: DataFrame, buckets: int, blocks: int, parts: int) -> DataFrame:
    """(block, status): for each unit the bits OPEN (a window may repeat), ALL (they all do) and SHOWN (its windows are counted for others that are open)."""
    splitters = ranges(state, lambda row: [words for _, words in orders(row)], buckets, blocks)

    def ask(batches):
        for row in rows_in(batches):
            for kind, (_, words) in enumerate(orders(row)):
                distinct, _, n = unique(words)
                if len(n):
                    yield dealt(row["block"], distinct, (n > 1).astype(np.uint8), splitters[kind], kind * buckets)

    def answer(bucket, who, payloads):
        words, twice, ends = read_dealt(payloads, 5)
        order = np.lexsort(words[2::-1])
        common, every = words[3][order], words[4][order]
        at = changes(common)
        n = np.diff(np.append(at, len(common)))
        group = np.repeat(np.arange(len(at)), n)
        open_ = (n > 1)[group] | (twice[order] > 0)
        edge = (group == 0) | (group == len(at) - 1)  # the next bucket may go on with it
        open_ |= edge
        within = np.lexsort((every, group))
        same = np.zeros(len(group) + 1, bool)
        same[1:-1] = (every[within][1:] == every[within][:-1]) & (group[within][1:] == group[within][:-1])
        all_ = np.zeros(len(group), bool)
        all_[within] = same[1:] | same[:-1]
        status = np.zeros(len(group), np.uint8)
        all_ |= twice[order] > 0
        first = np.empty(len(group), bool)
        first[within] = ~same[:-1]
        mixed_group = edge | (np.bincount(group, open_ & ~all_, len(at)) > 0)[group]
        status[order] = np.where(open_, OPEN, 0) | np.where(all_, ALL, 0) | np.where(open_ & first & mixed_group, SHOWN, 0)
        for block, own in zip(who, np.split(status, ends[:-1]), strict=True):
            yield request(block, [bucket], [own.tobytes()])

    def apply(batches):
        for row in rows_in(batches):
            status, at = np.zeros(len(row["unit"]) // 4, np.uint8), 0
            found = np.frombuffer(b"".join(r["payload"] for r in row["replies"] or []), np.uint8)
            for chosen, words in orders(row):
                distinct, number, _ = unique(words)
                own = found[at : at + len(distinct[0])]
                at += len(own)
                np.bitwise_or.at(status, chosen, own[number])
            yield key_batch([(row["block"], status.tobytes(), row["first"], row["last"], row["units"])], ["block", "status", "first", "last", "units"], [pa.int64()] + [pa.binary()] * 4)

    replies = by_bucket(state.mapInArrow(ask, REQUEST), parts, answer, REQUEST)
    return written(with_replies(state, replies).mapInArrow(apply, "block long, status binary, first binary, last binary, units binary"))


def spread(row: dict, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each run of a block: the status of each window."""
    out, units = [], np.cumsum(np.frombuffer(row["units"], np.int64))
    for status, first, last, length in zip(*(np.split(np.frombuffer(row[c], k), units[:-1]) for c, k in (("status", np.uint8), ("first", np.int32), ("last", np.int32))), np.frombuffer(row["length"], np.int64), strict=True):
        out.append(np.repeat(status, last - first + 1)[: length - size + 1])
    return out


def counted(status: np.ndarray) -> np.ndarray:
    return (status & SHOWN > 0) | (status & (OPEN | ALL) == OPEN)


def open_windows(row: dict, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Status by run, and the 128-bit hashes of the windows that are counted, in the order of the runs."""
    status, prints = spread(row, size), [np.zeros((2, 0), U)]
    for data, s in zip(runs_of(row), status, strict=True):
        at = np.flatnonzero(counted(s))
        if len(at):
            prints.append(np.stack(Prints(grams(data, GRAM)).of(at, at + size - GRAM + 1)))
    return status, list(np.concatenate(prints, axis=1))


def spans(runs: DataFrame, units: DataFrame, size: int, buckets: int, parts: int) -> DataFrame:
    """(k1, k2, begin, end): what goes of each text."""
    state = runs.join(units, "block")
    shift = U(64 - max(1, (buckets - 1).bit_length()))

    def ask(batches):
        for row in rows_in(batches):
            distinct, _, n = unique(open_windows(row, size)[1])
            edge = np.searchsorted((distinct[0] >> shift).astype(np.int64), np.arange(buckets + 1))
            edge[-1] = len(n)
            full = np.flatnonzero(np.diff(edge))
            if len(full):
                yield request(row["block"], full.tolist(), [b"".join([(n[a:b] > 1).astype(np.uint8).tobytes(), *(w[a:b].tobytes() for w in distinct)]) for a, b in ((edge[k], edge[k + 1]) for k in full)])

    def answer(bucket, who, payloads):
        words, twice, ends = read_dealt(payloads, 2)
        _, number, n = unique(words)
        for block, own in zip(who, np.split(((n > 1)[number] | (twice > 0)).astype(np.uint8), ends[:-1]), strict=True):
            yield request(block, [bucket], [own.tobytes()])

    def apply(batches):
        for row in rows_in(batches):
            status, prints = open_windows(row, size)
            found = np.frombuffer(b"".join(r["payload"] for r in row["replies"] or []), np.uint8)
            repeated, at, rows = found[unique(prints)[1]] if len(found) else found, 0, []
            k1, k2, start = (np.frombuffer(row[c], np.int64) for c in ("k1", "k2", "start"))
            for r, s in enumerate(status):
                asked = np.flatnonzero(counted(s))
                gone = s & ALL > 0
                gone[asked] |= repeated[at : at + len(asked)] > 0
                at += len(asked)
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                rows += [(int(k1[r]), int(k2[r]), int(start[r] + a), int(start[r] + b) + size - 1) for a, b in edge.reshape(-1, 2)]
            yield key_batch(rows, ["k1", "k2", "begin", "end"], [pa.int64()] * 4)

    replies = by_bucket(state.mapInArrow(ask, REQUEST), parts, answer, REQUEST)
    return with_replies(state, replies).mapInArrow(apply, "k1 long, k2 long, begin long, end long")


def repeats(docs: DataFrame, size: int) -> DataFrame:
    """(k1, k2, whole, spans) of the texts of which something goes: texts that occur twice go as a whole, of the others the spans."""
    if size < 2 * SPAN + GRAM:
        raise ValueError(f"strings of {2 * SPAN + GRAM} bytes and more")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k1, k2 = text_key(F.col("text"))
    texts = docs.where(F.octet_length("text") >= size).select(k1.alias("k1"), k2.alias("k2"), "text")
    anchors = written(anchor_table(texts, size))
    several = (F.max("twice")) | (F.min("k1") < F.max("k1")) | (F.min("k2") < F.max("k2"))
    shared = written(anchors.groupBy("h").agg(several.alias("several")).where("several").select("h"))
    windows = anchors.join(shared, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    runs = written(run_blocks(texts.join(windows, ["k1", "k2"]).sortWithinPartitions("k1", "k2"), size))
    levels = 1
    while 3**levels < size + SPAN:
        levels += 1
    tables = written(parse_table(runs, size, levels))
    seen = tables.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("names") / 8), F.lit(0)), *(F.min(F.col("cover")[k]) for k in range(levels))).first()
    blocks, phrases = seen[0], int(seen[1])
    copies = texts.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2", F.lit(True).alias("whole"), F.lit(None).cast("struct<begin:long,end:long>").alias("span"))
    if not blocks:
        return copies.select("k1", "k2", "whole", F.array().cast("array<struct<begin:long,end:long>>").alias("spans"))
    enough = next((k for k in range(levels) if seen[2 + k] >= size + SPAN), levels - 1) + 1
    buckets = max(1, min(4 * parts, phrases // LEAST), phrases // MOST)
    state = tables.select("block", "counts", "names")
    for level in range(enough):
        state = named(state, 3**level, buckets, blocks, parts)
    ranked = tables.drop("cover").join(state.select("block", F.col("names").alias("ranks")), "block")
    units = compared(ranked, buckets, blocks, parts)
    found = spans(runs, units, size, buckets, parts).select("k1", "k2", F.lit(False).alias("whole"), F.struct("begin", "end").alias("span"))
    return written(found.unionByName(copies).groupBy("k1", "k2").agg(F.max("whole").alias("whole"), F.collect_set("span").alias("spans")))


def marked(docs: DataFrame, size: int) -> DataFrame:
    k1, k2 = text_key(F.col("text"))
    names = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in names)).alias("rest"), k1.alias("k1"), k2.alias("k2"))
    return rows.join(repeats(docs, size), ["k1", "k2"], "left").select("text", "rest", "whole", "spans")


def united(whole: bool | None, found: list[dict] | None, length: int) -> list[tuple[int, int]]:
    if whole:
        return [(0, length)]
    out: list[tuple[int, int]] = []
    for s in sorted((s["begin"], s["end"]) for s in found or []):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def left_over(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in gone:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def answered(rows: DataFrame, kinds: dict[str, pa.DataType], make) -> DataFrame:
    """``rest`` as it is, and the columns that ``make(bytes, spans)`` gives."""

    def run(batches):
        for batch in batches:
            out = []
            for text, whole, found in zip(batch.column("text"), batch.column("whole").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                out.append(make(data, united(whole, found, len(data))))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *(pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True))], ["rest", *kinds])

    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return rows.mapInArrow(run, schema_with(rows.select("rest"), *((name, sql[k]) for name, k in kinds.items())))


def remove_repeats(docs: DataFrame, size: int = 400) -> DataFrame:
    """``docs`` with ``kept`` (binary: a cut may fall within a character), ``n_bytes`` and ``n_removed``; columns of these names are replaced."""
    kinds = {"kept": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64()}
    out = answered(marked(docs, size), kinds, lambda data, gone: (left_over(data, gone), len(data), sum(b - a for a, b in gone)))
    return out.select(*(F.col(f"rest.`{c}`") for c in docs.columns if c != "text" and c not in kinds), *kinds)


def removal_digest(docs: DataFrame, size: int = 400) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    out = answered(marked(docs.select("doc_id", "text"), size), kinds, lambda data, gone: (len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left_over(data, gone)).hexdigest()))
    return out.select("rest.doc_id", *kinds)
