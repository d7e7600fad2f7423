"""Minimal perfect hashing of distinct 64-bit keys, in buckets that tasks build and blocks that tasks are sent.

A bucket's function is a row of bit tables.  In each table a bit is set where
exactly one of the bucket's remaining keys falls; that key is settled, the others
go on to the next table.  The number of a key is the number of set bits before
its own, so n keys get the numbers 0 to n - 1.  Keys are stored by number, and a
looked-up key is compared with the stored one, so foreign keys are noticed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ripestream.llm.text import mix

#: Keys of a bucket, which one task builds, and of a block, which tasks are sent as a whole.
BUCKET_KEYS, BLOCK_KEYS = 1 << 16, 1 << 22
#: Bits of a table for each key that comes to it.
ROOM = 1.5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.array([bin(i).count("1") for i in range(256)], np.int64)

SCHEMA = "bucket long, sizes array<int>, bits binary, keys binary"


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ _ODD) % np.uint64(buckets)).astype(np.int64)


def place(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return (mix(keys.view(np.uint64) + np.uint64((level + 1) * int(_ODD) & (1 << 64) - 1)) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(bits of each table, all tables, keys by number) of distinct ``keys``."""
    sizes, tables, settled, rest = [], [], [], keys
    while len(rest):
        size = -(-int(ROOM * len(rest) + 8) // 8) * 8
        at = place(rest, len(sizes), size)
        once = np.bincount(at, minlength=size) == 1
        alone = once[at]
        settled.append(rest[alone][np.argsort(at[alone])])
        sizes.append(size)
        tables.append(np.packbits(once, bitorder="little"))
        rest = rest[~alone]
    return sizes, np.concatenate(tables).tobytes() if tables else b"", np.concatenate(settled) if settled else keys


def functions(keys: DataFrame, buckets: int) -> DataFrame:
    """One function a bucket, of the distinct column ``key``."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column(0).to_numpy(), buckets)), batch.column(0)], names=["bucket", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        here = None

        def row() -> pa.RecordBatch:
            sizes, bits, own = build(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([here]), pa.array([sizes], pa.list_(pa.int32())), pa.array([bits]), pa.array([own.tobytes()])], names=["bucket", "sizes", "bits", "keys"])

        for batch in batches:
            b, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)]):
                if held and here != int(b[lo]):
                    yield row()
                    held = []
                here = int(b[lo])
                held.append(k[lo:hi])
        if held:
            yield row()

    return keys.select("key").mapInArrow(deal, "bucket long, key long").repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(run, SCHEMA)


class Block:
    """Functions of consecutive buckets as one: numbers run from 0 to n - 1 over all of them."""

    def __init__(self, rows: list, buckets: int) -> None:
        self.buckets, self.low, self.high = buckets, rows[0]["bucket"], rows[-1]["bucket"]
        deep = max(len(r["sizes"]) for r in rows)
        self.size, self.base = (np.zeros((self.high - self.low + 1, deep), np.int64) for _ in range(2))
        at = 0
        for r in rows:
            for level, size in enumerate(r["sizes"]):
                self.size[r["bucket"] - self.low, level], self.base[r["bucket"] - self.low, level] = size, at
                at += size
        self.bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8)
        self.before = np.concatenate([[0], np.cumsum(_BITS[self.bits])])
        self.keys = np.frombuffer(b"".join(r["keys"] for r in rows), np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for keys that aren't in this block."""
        out = np.full(len(keys), -1, np.int64)
        bucket = bucket_of(keys, self.buckets)
        todo = np.flatnonzero((bucket >= self.low) & (bucket <= self.high))
        for level in range(self.size.shape[1]):
            size = self.size[bucket[todo] - self.low, level]
            todo, size = todo[size > 0], size[size > 0]
            if not len(todo):
                break
            bit = self.base[bucket[todo] - self.low, level] + place(keys[todo], level, size)
            byte, mask = self.bits[bit >> 3], np.left_shift(1, bit & 7)
            hit = (byte & mask) > 0
            out[todo[hit]] = self.before[bit[hit] >> 3] + _BITS[byte[hit] & (mask[hit] - 1)]
            todo = todo[~hit]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        out[~known] = -1
        return out
