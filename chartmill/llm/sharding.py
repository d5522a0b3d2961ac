"""Balanced label propagation into shards (DataFrame operations only).

Equal texts are linked. A link costs if it crosses from one shard to another, so the documents of a group should share a shard while the
shards keep equal numbers of documents (law ``rows``: at most one apart).

Every document starts in the shard of its hash. In a round each group (by the neighbours of its members: counts of the group by shard) names
the shard that holds most of it, and members elsewhere ask to move there. Between two shards as many may move one way as move the other, plus
the room that the linked documents leave (those without a link give way for nothing); who moves is decided on hash buckets, with running sums over a table of a fixed size, so no
shard's applicants meet in one task. Groups larger than a shard are first cut into equal parts by document, as no shard could hold them.
What belongs to a group reaches its documents by a join; the few groups above a share of all documents are sent to every task instead, so
no task gets all copies of one text.

At the end every shard ranks its documents, linked ones first, and those beyond its exact share (documents without a link, unless there are
too few) fill the places left in other shards. Ranks come from counts of hash buckets and ranks within a bucket.

Defined cases: a null text is the empty text with size 1 and links to other null and empty texts; repeated rows are separate documents;
a null doc_id is allowed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_key

#: Hash buckets in which moves are granted.
GRANT_BUCKETS = 512
#: Documents for each bucket of the final ranking.
RANK_ROWS = 2000
#: Groups of more than one in so many documents (``HOT_ROWS`` at least) are hot; there can't be more of them than this.
HOT_SHARE, HOT_ROWS = 50_000, 1000


def _join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row for each of ``keys``, and its number of rows ``n``); the hot ones are broadcast."""
    hot = F.col("n") > max(HOT_ROWS, total // HOT_SHARE)
    values = [c for c in groups.columns if c not in keys]
    first = rows.join(F.broadcast(groups.where(hot)), keys, "left")
    met = F.col("n").isNotNull()
    apart = [F.when(met, F.xxhash64("row", F.lit(c))).otherwise(F.col(c).cast("long")).alias(f"_{c}") for c in keys]  # what is met goes anywhere; a hash fits no narrower type
    rest = groups.where(~hot).select(*(F.col(c).cast("long").alias(f"_{c}") for c in keys), *(F.col(c).alias(f"_{c}") for c in values))
    second = first.select("*", met.alias("_met"), *apart).join(rest, [f"_{c}" for c in keys], "left")
    return second.select(*rows.columns, *(F.when(F.col("_met"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in values))


def _group_parts(docs: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """Narrow rows with the group each document belongs to (null if it has no link)."""
    said = F.coalesce("text", F.lit(""))
    rows = durable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(said) + 1).cast("long").alias("size"),
            F.crc32(said.cast("binary")).alias("text_crc32"),
            *(k.alias(n) for k, n in zip(text_key(said), ("t1", "t2"), strict=True)),
            F.monotonically_increasing_id().alias("row"),  # fixed by the checkpoint
        )
    )
    total = rows.count()
    groups = rows.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1")
    most = max(1, total // shards)
    parts = F.ceil(F.col("n") / most)
    linked = _join_groups(rows, groups, ["t1", "t2"], total)
    part = F.when(F.col("n").isNotNull(), F.xxhash64("t1", "t2", F.pmod(F.xxhash64("doc_id", "row", F.lit("part")), parts)))
    start = F.pmod(F.xxhash64("doc_id", "t1", F.lit("start")), F.lit(shards)).cast("int")
    return linked.select("doc_id", "size", "text_crc32", "row", part.alias("g"), start.alias("shard")), total


def _grant(asking: DataFrame, loads: dict[int, int], shards: int, capacity: int) -> DataFrame:
    """Of the moves asked for (g, shard, to, b, n rows each), the buckets (shard, to, b) that are granted."""
    flow = {(r["shard"], r["to"]): r["n"] for r in asking.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}  # shards squared at most
    quota = {}
    room = {s: max(0, capacity - loads.get(s, 0)) for s in range(shards)}
    for (a, b), n in sorted(flow.items()):
        back = min(n, flow.get((b, a), 0))
        extra = min(n - back, room[b] // max(1, sum(1 for (x, y) in flow if y == b and flow[x, y] > flow.get((y, x), 0))))
        quota[a, b] = back + extra
    limit = F.create_map(*(x for (a, b), q in quota.items() for x in (F.lit(a * shards + b), F.lit(q))))
    buckets = asking.groupBy("shard", "to", "b").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy("shard", "to").orderBy("n", "b"))  # GRANT_BUCKETS rows for each pair of shards; a large bucket doesn't hold up the others
    return buckets.withColumn("running", running).where(F.col("running") <= F.element_at(limit, F.col("shard") * shards + F.col("to"))).select("shard", "to", "b")


def propagate(rows: DataFrame, total: int, shards: int, rounds: int = 5) -> DataFrame:
    """Counts of linked documents move, group by group: (g, shard, n, to) says where the members of a group that leave a shard end up."""
    state = rows.where("g is not null").groupBy("g", "shard").agg(F.count("*").alias("n"))
    state = durable(state.withColumn("to", F.col("shard")))  # (g, first shard) -> shard now
    capacity = total // shards
    tie = F.pmod(F.xxhash64("g", F.lit("tie")) + F.col("to"), F.lit(shards))
    for k in range(rounds):
        held = state.groupBy("g", "to").agg(F.sum("n").alias("m"))
        target = held.groupBy("g").agg(F.max_by("to", F.struct("m", -tie)).alias("best"))
        loads = {r["to"]: r["n"] for r in state.groupBy("to").agg(F.sum("n").alias("n")).collect()}
        bucket = F.pmod(F.xxhash64("g", F.lit(k)), F.lit(GRANT_BUCKETS))
        wishes = state.join(target, "g").withColumn("b", bucket)
        asking = wishes.where("best <> to").select(F.col("to").alias("shard"), F.col("best").alias("to"), "b", "n")
        if asking.isEmpty():
            break
        granted = _grant(asking, loads, shards, capacity).select(F.col("shard").alias("to"), F.col("to").alias("best"), "b", F.lit(True).alias("yes"))
        moved = wishes.join(F.broadcast(granted), ["to", "best", "b"], "left")  # shards x shards x buckets rows at most
        state = durable(moved.select("g", "shard", "n", F.when(F.col("yes"), F.col("best")).otherwise(F.col("to")).cast("int").alias("to")))
    return state.where("to <> shard")


def _ranked(rows: DataFrame, shard: str, buckets: int, order: Column, name: str) -> DataFrame:
    """Rank from 0 within the shard as column ``name``: rows of lower ``order`` (0 or 1) first, then by hash bucket."""
    bucket = order * buckets + F.pmod(F.xxhash64("g", "row"), F.lit(buckets))
    rows = rows.withColumn("b", bucket)
    sizes = rows.groupBy(shard, "b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(shard).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))  # a row for each bucket
    offsets = sizes.select(shard, "b", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(shard, "b").orderBy("g", "doc_id", "row"))
    return rows.withColumn("r", within).join(offsets, [shard, "b"]).withColumn(name, F.col("before") + F.col("r") - 1).drop("b", "r", "before")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't ``key``)."""
    rows, total = _group_parts(docs, shards)
    rows = durable(rows)
    moves = propagate(rows, total, shards)
    placed = _join_groups(rows, moves, ["g", "shard"], total).withColumn("at", F.coalesce("to", "shard")).drop("to", "shard", "n")
    buckets = max(1, math.ceil(total / shards / RANK_ROWS))
    ranked = durable(_ranked(placed, "at", buckets, F.col("g").isNull().cast("int"), "rank"))
    counts = {r["at"]: r["n"] for r in ranked.groupBy("at").agg(F.count("*").alias("n")).collect()}
    base, more = divmod(total, shards)
    fuller = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))[:more]
    share = {s: base + (s in fuller) for s in range(shards)}
    as_map = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.lit(v).cast("long"))))
    surplus, lack, first = 0, [], {}
    for s in range(shards):
        first[s] = surplus - share[s]  # the number of an extra document is this plus its rank
        surplus += max(0, counts.get(s, 0) - share[s])
    taken = 0
    for s in range(shards):
        if (n := share[s] - counts.get(s, 0)) > 0:
            lack.append((s, taken, taken + n))
            taken += n
    extra = F.col("rank") >= F.element_at(as_map(share), F.col("at"))
    number = F.col("rank") + F.element_at(as_map(first), F.col("at"))
    shard, slot = F.col("at"), F.col("rank")
    for s, low, high in lack:
        here = extra & (number >= low) & (number < high)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, number - low + counts.get(s, 0)).otherwise(slot)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
