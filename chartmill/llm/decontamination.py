"""Benchmark decontamination by spaced seeds (DataFrame functions only).

Words are runs of letters, marks and digits, lower-cased. A seed is the hash of the words at the fixed positions of a mask, counted from a place; the
words between are ignored, so a seed survives substitutions there. The two masks together hit every aligned stretch of 13 words with at most two
substitutions. Seeds of documents and of test items are joined; each hit gives an item and an offset, and there the item and the document are compared
word for word: the overlap is the most equal words of an aligned stretch of ``stretch`` words, and a document is contaminated from
``least`` equal words. Items shorter than the stretch (and of ``min_words`` or more) are compared as a whole: their seed is the whole
sequence. Shorter items say too little to tell a leak from a common phrase; :func:`short_items` lists them.

The seeds of the test set are broadcast only after they have been counted (``BROADCAST_SEEDS``); a larger set is joined by shuffle. Hits of a
document are reduced to (item, offset) before they are compared, so a passage in many documents costs each of them the same; a document's
words are hashed once for all of its hits, and each hit takes only the words beside its item along.

Defined cases: null texts have no words and null or repeated item texts change nothing (items of equal words count once, under the smallest
id); repeated rows get equal results; a null doc_id is kept; an empty test set contaminates nothing; extra columns are ignored or kept as they are
by :func:`remove_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, written
from .simhash import row_check, row_key

#: Word positions of the masks.
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 6, 8, 9))
STRETCH, LEAST, MIN_WORDS = 13, 11, 8
#: Largest test set (rows of 24 bytes) whose seeds, and largest number of items whose words, are sent to every executor.
BROADCAST_SEEDS, BROADCAST_ITEMS = 2_000_000, 50_000
NOT_A_WORD = r"[^\p{L}\p{M}\p{N}]+"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _mask_seeds(hashes: str, mask: tuple[int, ...], number: int) -> Column:
    """Seeds of a mask at all places of a word array (none if it is shorter than the mask)."""
    n = F.size(hashes) - mask[-1]
    at = lambda i: F.xxhash64(F.lit(number), *(F.get(hashes, i + o) for o in mask))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<long>"))


def seeds(rows: DataFrame, masks: list[tuple[int, ...]], *carried: str) -> DataFrame:
    """(carried, seed, at) from rows with ``hashes``: one row for each seed."""
    each = [f"_seeds{m}" for m in range(len(masks))]
    wide = rows.select(*carried, *(_mask_seeds("hashes", mask, m).alias(c) for (m, mask), c in zip(enumerate(masks), each, strict=True)))
    flat = wide.select(*carried, *(F.size(c).alias(f"_n{c}") for c in each[:-1]), F.posexplode(F.concat(*each)).alias("at", "seed"))
    before, steps = F.lit(0), []
    for c in each[:-1]:
        steps.append((before + F.col(f"_n{c}"), before))
        before = before + F.col(f"_n{c}")
    place = F.col("at") - before
    for end, start in reversed(steps):
        place = F.when(F.col("at") < end, F.col("at") - start).otherwise(place)
    return flat.select(*carried, "seed", place.alias("at"))


def equal_words(beside: Column, item: Column, offset: Column) -> Column:
    """For each word of the item 1 if the document has it at the same place, else 0; ``beside``: the document's words from ``offset`` (or 0) on."""
    before = F.array_repeat(F.lit(None).cast("long"), F.greatest(-offset, F.lit(0)))
    return F.slice(F.zip_with(item, F.concat(before, beside), lambda w, d: F.when(w == d, 1).otherwise(0)), F.lit(1), F.size(item))


def contamination(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, least: int = LEAST, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, k2, items, overlap) for the contaminated rows; ``k`` and ``k2`` are 128 bits of doc_id and text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text").cast("string")).alias("hashes"))
    items = items.groupBy("hashes").agg(F.min("item_id").alias("item_id")).where(F.size("hashes") >= min_words)
    items = written(items)
    masks = list(MASKS)
    for n in sorted(r[0] for r in items.where(F.size("hashes") < stretch).select(F.size("hashes")).distinct().collect()):  # stretch - min_words lengths at most
        masks.append(tuple(range(n)))
    wanted = items.withColumn("short", F.size("hashes") < stretch)
    long_seeds = seeds(wanted.where("not short"), masks, "item_id")
    own = F.coalesce(*(F.when(F.size("hashes") == mask[-1] + 1, F.get(_mask_seeds("hashes", mask, m), F.lit(0))) for m, mask in list(enumerate(masks))[len(MASKS) :]), F.lit(None).cast("long"))
    short_seeds = wanted.where("short").select("item_id", own.alias("seed"), F.lit(0).alias("at"))
    test = written(long_seeds.unionByName(short_seeds).select("item_id", "seed", F.col("at").alias("j")).distinct())
    side = sized(test, BROADCAST_SEEDS)

    keys = [row_key().alias("k"), row_check().alias("k2")]
    rows = docs.select(*keys, word_hashes(F.col("text").cast("string")).alias("hashes"))
    hits = seeds(rows, masks, "k", "k2").join(side, "seed").select("k", "k2", "item_id", (F.col("at") - F.col("j")).alias("off")).distinct()
    lengths = sized(items.select("item_id", F.size("hashes").alias("n")), BROADCAST_SEEDS)
    hits = written(hits.join(lengths, "item_id"))
    if hits.isEmpty():
        return spark.createDataFrame([], "k long, k2 long, items array<long>, overlap int")
    by_doc = hits.groupBy("k", "k2").agg(F.collect_list(F.struct("item_id", "off", "n")).alias("hits"))  # at most a document's places times the items at one
    met = docs.select(*keys, F.col("text").cast("string").alias("text")).join(by_doc, ["k", "k2"])
    beside = lambda h: F.struct(h["item_id"].alias("item_id"), h["off"].alias("off"), F.slice("hashes", F.greatest(h["off"], F.lit(0)) + 1, h["n"]).alias("beside"))
    each = met.select("k", "k2", word_hashes(F.col("text")).alias("hashes"), "hits").select("k", "k2", F.explode(F.transform("hits", beside)).alias("h"))
    narrow = written(each.select("k", "k2", "h.*")).join(sized(items.withColumnRenamed("hashes", "item"), BROADCAST_ITEMS), "item_id")
    equal = equal_words(F.col("beside"), F.col("item"), F.col("off"))
    compared = narrow.select("k", "k2", "item_id", equal.alias("equal"))
    width = F.least(F.size("equal"), F.lit(stretch))
    same = lambda j: F.aggregate(F.slice("equal", j, width), F.lit(0), lambda s, x: s + x)
    most = F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - width + 1), same))
    found = compared.select("k", "k2", "item_id", most.alias("most"), F.when(width < stretch, width).otherwise(F.lit(least)).alias("need"))
    return found.where("most >= need").groupBy("k", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("most").cast("int").alias("overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, items (ids, sorted), overlap of each row."""
    found = contamination(docs, benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), row_check().alias("k2"))
    none = F.array().cast("array<long>")
    return rows.join(found, ["k", "k2"], "left").select(
        "doc_id", F.col("overlap").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"), F.coalesce("overlap", F.lit(0)).alias("overlap")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the test set, columns unchanged."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key().alias("k"), row_check().alias("k2"))
    return row.join(contamination(docs, benchmark).select("k", "k2"), ["k", "k2"], "left_anti").select("row.*")


def short_items(benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, n_words) of the items that have too few words to be looked for."""
    n = F.size(word_hashes(F.col("text").cast("string")))
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), n.alias("n_words")).where(F.col("n_words") < min_words)
