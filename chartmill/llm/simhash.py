"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit for each bit that is set in over half of the hashes (XXH64, seed 42, unsigned) of a text's word shingles. Two texts
are linked if their fingerprints differ in at most ``radius`` bits. Equal fingerprints are one node, so copies of any number cost a group-by.
The 64 bits are cut into ``radius + 2`` blocks; within the radius at least two blocks agree, so every link shows in a bucket of one
of the block pairs. Large buckets are cut into chunks and every pair of chunks is compared on its own, so no bucket is bound to one task.

Fingerprints are stored vertically: one bit plane for each bit, 64 of them in a word. In a large bucket a query XORs its bits with the planes;
of small buckets the pairs of many are laid out in common planes. Differences are counted in carry-save counters, many at once; once every
counter of a block of 64 is beyond the radius, the block is abandoned.
A bucket returns a spanning forest of its links, never all pairs; star joins then give the components.

Defined cases: a text without words (or null) has fingerprint zero and is linked like any other; texts shorter than a shingle hash as the
whole sequence; repeated rows are repeated in the result; a null doc_id takes part in links and is never a component's id unless
all of its ids are null; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, durable, words_of
from .components import connected_components

#: Fingerprints of a bucket that one comparison takes; larger buckets are compared chunk by chunk.
CHUNK = 2048
#: Up to this size the pairs of buckets are laid out side by side, many buckets in one run of planes; larger ones have planes of their own.
SMALL = 24


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    words = words_of(text.translate(_LOWER)) if text else []
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    hashes = np.array([xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, ``fp`` (signed) and the keys of each row."""

    def prints(batch):
        return [np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("k"), row_check().alias("k2"))
    return beside(rows, ["doc_id", "k", "k2"], {"fp": "long"}, prints)


def row_key():
    """64 bits that stand for a row's doc_id and text."""
    return F.xxhash64("doc_id", "text")


def row_check():
    """Another 64 bits of the same, for joins that must not confuse rows."""
    return F.xxhash64(F.lit("key"), "doc_id", "text")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words: bit i of every value, 64 values in a word."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    pad = -len(values) % 64
    bits = np.pad(bits, ((0, 0), (0, pad)))
    return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view(np.uint64)


def _count_beyond(rows, shape: tuple[int, int], radius: int) -> np.ndarray:
    """Lanes where at least one of the 64-lane words of a column has at most ``radius`` (one less than a power of two) of 64 set bits: a
    mask of the counters that stayed within it, word by word. ``rows(i, columns)`` gives bit i of the differences; a column (64 targets) is
    abandoned as soon as all its counters are beyond the radius."""
    full = ~np.uint64(0)
    columns = np.arange(shape[1])
    counters = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    beyond = np.zeros(shape, np.uint64)
    for i in range(64):
        carry = rows(i, columns)
        for c in counters:
            over = c & carry
            c ^= carry
            carry = over
        beyond |= carry
        if i % 8 == 7:
            alive = (beyond != full).any(0)
            if not alive.all():
                columns, beyond = columns[alive], beyond[:, alive]
                counters = [c[:, alive] for c in counters]
                if not len(columns):
                    break
    within = np.zeros(shape, np.uint64)
    within[:, columns] = ~beyond
    return within


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def sliced_matches(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Boolean (queries, n): at most ``radius`` bits differ."""
    full = ~np.uint64(0)
    differ = lambda i, at: planes[i][at][None, :] ^ np.where((queries >> np.uint64(i)) & np.uint64(1), full, np.uint64(0))[:, None]
    return _lanes(_count_beyond(differ, (len(queries), planes.shape[1]), radius), n)


def sliced_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Boolean (n): at most ``radius`` bits differ between the fingerprints of one place of both arrays."""
    if not len(left):
        return np.zeros(0, bool)
    planes = bit_planes(left ^ right)
    return _lanes(_count_beyond(lambda i, at: planes[i][at][None, :], (1, planes.shape[1]), radius), len(left))[0]


def bucket_forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links inside ``left``, or between ``left`` and ``right``."""
    nodes = left if right is None else np.concatenate([left, right])
    at = 0 if right is None else len(left)
    target = left if right is None else right
    planes, label, edges = bit_planes(target), np.arange(len(nodes)), []
    for k in range(0, len(left), 64):
        hit = sliced_matches(left[k : k + 64], planes, len(target), radius)
        for q in np.flatnonzero(hit.any(1)):
            i = k + q
            found = np.flatnonzero(hit[q]) + at
            others = label[found]
            others = others[others != label[i]]
            while len(others):
                j = found[label[found] == others[0]][0]
                edges.append((int(nodes[i]), int(nodes[j])))
                label[label == others[0]] = label[i]
                others = others[others != others[0]]
    return edges


def link_edges(nodes: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect just what links of the distinct ``fp`` connect."""
    blocks = radius + 2
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for pair in combinations(range(blocks), 2):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in pair)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))
    rows = nodes.select("fp", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk)
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), chunks)
    parts = (
        rows.join(sizes, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        .select("fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))
    )

    def compare(fp, key, second, sizes_):
        """Edges of whole parts, of which ``sizes_`` are the lengths."""
        edges = []
        big = sizes_ > SMALL
        inside = np.repeat(~big, sizes_)
        small, small_key, small_second = fp[inside], key[inside], second[inside]
        for d in range(1, SMALL):
            if len(small) <= d:
                break
            same = np.flatnonzero((small_key[d:] == small_key[:-d]))
            if not len(same):
                break
            near = same[sliced_pairs(small[same], small[same + d], radius)]
            edges += zip(small[near].tolist(), small[near + d].tolist(), strict=True)
        stops = np.cumsum(sizes_)
        for stop, n in zip(stops[big].tolist(), sizes_[big].tolist(), strict=True):
            part, right = fp[stop - n : stop], second[stop - n : stop]
            edges += bucket_forest(part[~right], part[right], radius) if right.any() else bucket_forest(part, None, radius)
        return forest(edges)

    def run(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) < 20_000:
                continue
            last = held.iloc[-1]
            tail = ((held["key"] == last["key"]) & (held["i"] == last["i"]) & (held["j"] == last["j"])).to_numpy()
            whole, held = held[~tail], held[tail]
            if len(whole):
                yield finish(whole)
        if held is not None and len(held):
            yield finish(held)

    def finish(pdf):
        part = pdf.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
        sizes_ = np.bincount(part)
        edges = compare(pdf["fp"].to_numpy().view(np.uint64), part, pdf["second"].to_numpy(bool), sizes_)
        return pd.DataFrame(np.array(edges, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    # parts that no longer need a comparison across chunks are whole; `second` tells the sides of two chunks apart
    ordered = parts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInPandas(run, "a long, b long").distinct()


def forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The edges that connect something new, as (node, root)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def labelled(docs: DataFrame, radius: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints (doc_id, fp, k, k2) of all rows, and (fp, root, component_id) of the distinct fingerprints."""
    prints = durable(fingerprints(docs, size))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    members = connected_components(link_edges(nodes.select("fp"), radius))
    rooted = nodes.join(members, nodes["fp"] == members["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints, rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """Per row: doc_id, fp, component_id."""
    prints, labels = labelled(docs, radius, size)
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """One row of each component: that of the smallest doc_id, nulls last, and of its repeated rows any one. Columns unchanged."""
    prints, labels = labelled(docs, radius, size)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k", "k2")).alias("first")
    return rows_of(docs, prints.join(labels, "fp").groupBy("root").agg(first).select("first.k", "first.k2"))


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (k, k2), columns unchanged."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key().alias("k"), row_check().alias("k2"))
    return row.join(chosen, ["k", "k2"]).dropDuplicates(["k", "k2"]).select("row.*")
