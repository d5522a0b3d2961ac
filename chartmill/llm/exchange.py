"""Packed records: tasks deal records out to buckets as blocks of bytes, so a shuffle moves a few large rows and numpy sorts a bucket.

A block is the part of a table that one row holds. A request is (block, bucket, payload): the records of a block that belong to a bucket, each
once, so a record that every document has comes to its bucket once for each block and not once for each document. A bucket is read by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUEST = "block long, bucket int, payload binary"


def request(block: int, buckets: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block] * len(buckets), pa.int64()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], ["block", "bucket", "payload"])


def by_bucket(requests: DataFrame, parts: int, answer: Callable[[int, list[int], list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``answer(bucket, blocks, payloads)`` for every bucket, whose requests come in the order of their blocks; a task holds one bucket at a time."""

    def stream(batches):
        bucket, blocks, payloads = None, [], []
        for batch in batches:
            for b, k, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != bucket and blocks:
                    yield from answer(bucket, blocks, payloads)
                    blocks, payloads = [], []
                bucket = k
                blocks.append(b)
                payloads.append(p)
        if blocks:
            yield from answer(bucket, blocks, payloads)

    return requests.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(stream, schema)


def with_replies(state: DataFrame, replies: DataFrame) -> DataFrame:
    """``state`` (one row for each block) with ``replies``: the structs (bucket, payload) of its block in order; null where there are none."""
    gathered = replies.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "payload"))).alias("replies"))
    return state.join(gathered, "block", "left")


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """The order of records given as unsigned 64-bit words, the most significant first: least significant digits of 16 bits first, each by a stable counting sort."""
    order = None
    for word in reversed(digits):
        most = int(word.max(initial=0))
        for shift in range(0, most.bit_length(), 16):
            digit = ((word if order is None else word[order]) >> np.uint64(shift)).astype(np.uint16)
            step = np.argsort(digit, kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(digits[0])) if order is None else order


def starts(words: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal records begin in sorted records."""
    new = np.ones(len(words[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
    return np.flatnonzero(new)
