"""One document of each group of near-duplicates, by exact Jaccard similarity of word shingles (the pipeline's use of SimHash).

Two texts are linked if the sets of their ``size``-word shingles have a Jaccard similarity of ``SHARE`` (a ratio of whole numbers) or more. Texts of
one set are one node. A similarity of 0.8 leaves about ten of 64 bits of a SimHash different, so no radius that a block scheme can search
finds all links; SimHash finds most, and a prefix filter the rest:

1. Fingerprints of the shingle sets are linked by the bit-sliced comparison of :mod:`.simhash`; links that the whole sets confirm are kept.
2. What isn't connected then is found by a prefix filter, which misses no pair: in any common order of the shingles, two linked sets
   share a shingle among the first n - ceil(SHARE n) + 1 of each. The order here is by a table of counts of a fixed size, so that common
   lines come last; counts that share a cell only cost time. Every candidate that isn't already connected is compared by its whole sets.

Shingles that the same nodes share count once: whichever of them is taken, the pairs are the same. The nodes of a shared shingle meet in a
task (large groups in salted blocks, every pair of blocks by itself) and pairs are compared there, so no pair is ever a row: a task returns a
spanning forest of what it links. That is done twice. At first the sketches alone decide: a bit of a sketch tells whether an odd number of
shingles falls on it, so two sets differ in at least as many shingles as their sketches in bits; what they may link is confirmed by the
whole sets. Then only nodes that still may have a link to another component meet once more, with their whole sets, which decide pair by pair.

Defined cases: texts without words (or null) have the empty set and are one node; texts shorter than a shingle have their whole sequence as their only
shingle; repeated rows are copies; a null doc_id is kept only if all of its component's ids are null; columns are unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, blocks, discard, durable, release, sized, words_of, written
from .components import connected_components
from .simhash import _LOWER, link_edges, row_check, row_key, rows_of
from .substring import hashes_of

#: Similarity from which texts are linked, as numerator and denominator.
SHARE = (4, 5)
#: Cells of the table of counts, and cells of a part of it in the sum; characters hashed at once; nodes, and shingles, of a block in the comparison of the rest.
CELLS, PART, BLOCK_CHARS, BLOCK, BLOCK_SHINGLES = 1 << 20, 1 << 16, 1_000_000, 512, 1_000_000
RADIUS = 3
#: 64-bit parts of a small set's sketch; sets of more shingles than it has bits have one twice as long, and so on. Rows that a task gives out at once.
SKETCH, ROWS = 8, 10_000
#: Rows of a table that is broadcast.
SENT = 200_000


def shingle_sets(texts: list[str | None], size: int):
    """The sorted distinct shingle hashes of each text."""
    for part in blocks(texts, BLOCK_CHARS):
        yield from _sets(part, size)


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position."""
    found = np.full(max(len(h) - n + 1, 0), n, np.uint64)
    for i in range(n):
        found = (found ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found


def _sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    words = [words_of(t.translate(_LOWER)) if isinstance(t, str) else [] for t in texts]
    flat = hashes_of([w for own in words for w in own])
    rolled, at, out = _rolled(flat, size), 0, []  # of the whole block; places across two texts are not read
    for own in words:
        n = len(own)
        whole = rolled[at : at + n - size + 1] if n >= size else _rolled(flat[at : at + n], n) if n else flat[:0]
        out.append(np.unique(whole))
        at += n
    return out


def simhash_of(found: np.ndarray) -> np.uint64:
    """A bit for each bit that is set in over half of the hashes."""
    mixed = found * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(mixed), 1 << 16):
        ones += np.unpackbits(mixed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0]


def sketch_of(found: np.ndarray) -> np.ndarray:
    """A bit for each cell on which an odd number of the hashes falls: as many cells as hashes or more, a power of two."""
    bits = max(64 * SKETCH, 1 << max(len(found) - 1, 0).bit_length())
    cells = ((found * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").view(np.int64)


def folded(sketch: np.ndarray) -> np.ndarray:
    """The sketch of the same set in half as many bits."""
    half = len(sketch) // 2
    return sketch[:half] ^ sketch[half:]


def cells_of(found: np.ndarray) -> np.ndarray:
    return ((found * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64)


def common_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many texts have a shingle of each cell: an array of a fixed size."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for pdf in batches:
            for part in blocks(pdf["text"].tolist(), BLOCK_CHARS):
                total += np.bincount(cells_of(np.concatenate([np.zeros(0, np.uint64), *_sets(part, size)])), minlength=CELLS)
        if total.any():
            yield pd.DataFrame({"part": range(CELLS // PART), "counts": [total[a : a + PART].astype(np.int32).tobytes() for a in range(0, CELLS, PART)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in pdf["counts"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    schema = "part int, counts binary"
    got = docs.select("text").mapInPandas(run, schema).groupBy("part").applyInPandas(add, schema).collect()  # of a fixed size
    total = np.zeros(CELLS, np.int32)
    for r in got:
        total[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(bytes(r["counts"]), np.int32)
    return total


def prefixes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, k, k2, node (a hash of the set), n (its size), its SimHash, the shingles of its prefix in the common order and its sketch."""
    from xxhash import xxh64_intdigest

    counts = docs.sparkSession.sparkContext.broadcast(common_counts(docs, size))
    up, down = SHARE

    def sets(batch):
        out = []
        for found in shingle_sets(batch.column("text").to_pylist(), size):
            n = len(found)
            order = np.argsort(counts.value[cells_of(found)], kind="stable")[: n - -(-up * n // down) + 1]
            out.append((np.uint64(xxh64_intdigest(found.tobytes(), 7)).view(np.int64), n, simhash_of(found).view(np.int64), found[order].view(np.int64), sketch_of(found)))
        return [[o[i] for o in out] for i in range(5)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("k"), row_check().alias("k2"))
    return beside(rows, ["doc_id", "k", "k2"], {"node": "long", "n": "long", "fp": "long", "prefix": "array<long>", "sketch": "array<long>"}, sets)


def may_link(n: np.ndarray, at: np.ndarray, sketches: list[np.ndarray], apart):
    """(i, others): for places i the places whose sketches, and the places ``at`` of the shingle that they share, leave room for the similarity.

    ``apart(i)`` gives the places that i has to be compared with; every pair of them is met at least once.
    """
    up, down = SHARE
    width = np.fromiter(map(len, sketches), np.int64, len(sketches))
    for w in np.unique(width):  # sets of similar sizes have sketches of one length, or of one and its double
        row = np.flatnonzero((width == w) | (width == 2 * w))
        bits = np.stack([sketches[k] if width[k] == w else folded(sketches[k]) for k in row]).view(np.uint64)  # numpy counts the bits of a signed number's absolute value
        place = np.full(len(width), -1)
        place[row] = np.arange(len(row))
        for i in np.flatnonzero(width == w):
            others = apart(i)
            others = others[place[others] >= 0]
            # what they share besides lies before the shingle in both, or after it
            room = np.minimum(n[i] - at[i], n[others] - at[others]) + np.minimum(at[i], at[others])
            others = others[(up + down) * room >= up * (n[i] + n[others])]
            if len(others):
                differ = np.bitwise_count(bits[place[others]] ^ bits[place[i]]).sum(1, dtype=np.int64)
                others = others[(up + down) * differ <= (down - up) * (n[i] + n[others])]
            if len(others):
                yield i, others


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    up, down = SHARE
    if len(one) > len(other):
        one, other = other, one
    at = np.minimum(np.searchsorted(other, one), len(other) - 1)
    return (up + down) * int((other[at] == one).sum()) >= up * (len(one) + len(other))


def whole_parts(batches):
    """One record batch for each part (key, i, j) of a stream in their order."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        stops = [*(np.flatnonzero((part[:, 1:] != part[:, :-1]).any(0)) + 1), batch.num_rows]
        if held and (part[:, 0] != last).any():
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        for a, b in zip([0, *stops], stops):
            if a:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(a, b - a))
        last = part[:, -1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def lists_in(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    values, stops = column.values.to_numpy(), np.asarray(column.offsets)
    return [values[a:b] for a, b in zip(stops[:-1], stops[1:])]


def met(entries: DataFrame, parts, likely: bool = False) -> DataFrame:
    """Pairs (a, b) of a spanning forest of what links the nodes of a key over their roots, or with ``likely`` the (key, node) that may have a link.

    ``entries``: key, node, n, at, root, sketch, and for links by the whole sets (else the sketches decide) found; ``parts``: blocks of the key.
    """
    columns = ["key", "i", "j", "second", *(c for c in ("node", "n", "at", "root", "sketch", "found") if c in entries.columns)]
    dealt = entries.withColumn("_own", F.pmod(F.xxhash64("node"), parts)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other"), "second": (F.col("_own") > F.col("_other")).cast("int")}).select(*columns)
    names = ["key", "node"] if likely else ["a", "b"]

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                x = p
            return x

        def links(part):
            key, second, node, n, at = (part.column(c).to_numpy() for c in ("key", "second", "node", "n", "at"))
            label = part.column("root").to_numpy().copy()
            if parent:
                label = np.array([root(r) for r in label.tolist()])
            across, found, marked = second.any(), [f.view(np.uint64) for f in lists_in(part, "found")] if "found" in columns else None, np.zeros(len(node), bool)
            if len(node) > 1 and (label != label[0]).any():
                where = (lambda i: np.flatnonzero((label != label[i]) & (second != second[i]))) if across else (lambda i: np.flatnonzero(label != label[i]))
                for i, others in may_link(n, at, lists_in(part, "sketch"), where):
                    if likely:
                        marked[i] = marked[others] = True
                        continue
                    while len(others):
                        k = others[0]
                        if found is not None and not similar(found[i], found[k]):
                            others = others[1:]
                            continue
                        yield node[i], node[k]
                        gone, stays = label[k], label[i]
                        parent[int(gone)] = int(stays)
                        label[label == gone] = stays
                        others = others[label[others] != stays]
            yield from zip(key[marked], node[marked])

        held = []
        for part in whole_parts(batches):
            held += links(part)
            if len(held) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names)

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def distinct_groups(rest: DataFrame) -> DataFrame:
    """``rest`` (key, x) with one key of those that the same nodes share; they are told by count and 128 bits."""
    said = (F.count("*").alias("c"), F.bit_xor(F.xxhash64("x.node")).alias("s"), F.bit_xor(F.xxhash64(F.lit("key"), "x.node")).alias("s2"))
    return rest.join(rest.groupBy("key").agg(*said).groupBy("c", "s", "s2").agg(F.min("key").alias("key")).select("key"), "key")


def whole_sets(chosen: DataFrame, docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, found) of the chosen nodes: all their shingles."""
    wanted = written(chosen.distinct().join(nodes, "node").select("node", "k", "k2"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "found": [f.view(np.int64) for f in shingle_sets(pdf["text"].tolist(), size)]})

    texts = docs.select(row_key().alias("k"), row_check().alias("k2"), "text").join(sized(wanted, SENT), ["k", "k2"]).dropDuplicates(["node"])
    sets = written(texts.select("node", "text").mapInPandas(run, "node long, found array<long>"))
    release(docs.sparkSession)  # the shuffled texts
    discard(wanted)
    return sets


def linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar."""
    pairs = written(pairs.distinct())
    sets = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, nodes, size)
    left, right = (sets.select(F.col("node").alias(c), F.col("found").alias(f"set_{c}")) for c in "ab")
    up, down = SHARE
    both = F.size(F.array_intersect("set_a", "set_b"))
    found = written(pairs.join(left, "a").join(right, "b").where((up + down) * both >= up * (F.size("set_a") + F.size("set_b"))).select("a", "b"))
    discard(sets, pairs)
    return found


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of nodes: stars of equal fingerprints, and the links of the distinct ones."""
    chief = nodes.groupBy("fp").agg(F.min("node").alias("chief"))
    stars = nodes.join(chief, "fp").where("node <> chief").select(F.col("chief").alias("a"), F.col("node").alias("b"))
    left, right = (chief.select(F.col("fp").alias(f"fp_{c}"), F.col("chief").alias(c)) for c in "ab")
    links = link_edges(chief.select("fp"), RADIUS).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return stars.unionByName(links.join(left, "fp_a").join(right, "fp_b").select("a", "b"))


def components(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, root) of the nodes that have a link."""
    edges = linked(simhash_pairs(nodes), docs, nodes, size)
    members = durable(connected_components(edges))
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    member = F.struct("node", "n", "at")
    shared = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    every = written(entries.join(shared, "key").select("key", member.alias("x")))
    release(docs.sparkSession)
    rest = written(distinct_groups(every))
    discard(every)
    sketches = nodes.select("node", "sketch")
    for step in ("sketches", "sets"):
        named = rest.join(members.withColumnRenamed("node", "_node"), F.col("x.node") == F.col("_node"), "left")
        rooted = named.select("key", "x.*", F.coalesce("root", "x.node").alias("root"))
        groups = rooted.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        groups = groups.where("lo <> hi").select("key", "c")  # the others are connected
        apart = written(rooted.join(groups, "key"))
        if apart.isEmpty():
            break
        sketched, by_count = apart.join(sketches, "node"), F.ceil(F.col("c") / BLOCK)
        if step == "sketches":
            found = linked(met(sketched, by_count), docs, nodes, size)
        else:
            likely = written(met(sketched, by_count, likely=True).distinct())
            sizes = likely.join(nodes.select("node", "n"), "node").groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("shingles"))
            sets = whole_sets(likely.select("node"), docs, nodes, size)
            by_size = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("shingles") / BLOCK_SHINGLES))
            found = written(met(sketched.drop("c").join(likely, ["key", "node"]).join(sizes, "key").join(sets, "node"), by_size).distinct())
            discard(likely, sets)
        discard(apart)
        if not found.isEmpty():
            edges = edges.unionByName(found)
            members = durable(connected_components(edges))
        release(docs.sparkSession)
    discard(rest)
    return members


def keep_one_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row of each component: that of the smallest doc_id, nulls last, and of its repeated rows any one. Columns unchanged."""
    prints = written(prefixes(docs, size))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k", "k2")).alias("first")
    firsts = prints.groupBy("node").agg(first, F.min(F.struct("n", "fp", "prefix", "sketch")).alias("p"))
    nodes = written(firsts.select("node", "first", "first.k", "first.k2", "p.n", "p.fp", "p.prefix", "p.sketch"))
    discard(prints)
    release(docs.sparkSession)
    members = components(docs, nodes.drop("first"), size)
    rooted = nodes.join(members.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(F.coalesce("root", "node").alias("root"), "first")
    return rows_of(docs, rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.k", "first.k2"))
