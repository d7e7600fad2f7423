"""Shards of equal bytes by a histogram sort.

Every document gets a 63-bit key: its upper 27 bits are a hash of the text, so
equal texts are neighbours, the next 18 a hash of text and id and the lowest 18
one of the row's address, so a group of copies, and one of equal rows, can be cut
anywhere.  Splitters between shards are found by probing: in
each round the tasks count the exact bytes between candidate boundaries, the
driver adds the counts (a fixed number of them) and refines the probes inside
the bracket of each splitter until the bytes below it are within ``TOLERANCE``
of a shard's share, or the bracket holds a single document.  Then the documents
are exchanged once.  Within a shard they are numbered from 0; the numbering
runs in slices of a shard, so no task holds more than a slice.

Cases: a null text counts ``overhead`` bytes, as an empty one does.  Null ids are
hashed like any value.  Repeated rows are dealt like others, by their places in
the files; a document's shard doesn't depend on the files, its slot does.  Fewer documents than shards leave some shards empty; an empty table
gives an empty result.  The input's columns are kept; columns named ``shard`` or
``slot``, in any case of letters, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripestream.llm.common import addressed, inner_prefix, others, stage

SHARDS, OVERHEAD = 40, 16
PROBES = 64
#: Of a shard's share.
TOLERANCE = 0.001
SLICE_BYTES = 64 << 20
_TOP = (1 << 63) - 1
_PART = 18


def text_bytes(text: str, overhead: int = OVERHEAD) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


def sort_key(text: str, doc_id: str, *address: str) -> Column:
    """Text, then id, then address: 27, 18 and 18 bits."""
    bits = lambda h, n: F.shiftrightunsigned(h, 64 - n)
    high = F.shiftleft(bits(F.xxhash64(F.coalesce(text, F.lit(""))), 63 - 2 * _PART), 2 * _PART)
    middle = F.shiftleft(bits(F.xxhash64(F.col(doc_id), F.col(text)), _PART), _PART)
    return high.bitwiseOR(middle).bitwiseOR(bits(F.xxhash64(*address), _PART))


def counted(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rows) of ``keys`` below each probe: one pass over (key, size), one number pair a probe to the driver."""
    sent = keys.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        size, rows = np.zeros(len(p) + 1, np.int64), np.zeros(len(p) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(p, batch.column(0).to_numpy(), side="right")
            rows += np.bincount(at, minlength=len(rows))
            size += np.bincount(at, weights=batch.column(1).to_numpy().astype(np.float64), minlength=len(size)).astype(np.int64)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows[full])], names=["i", "bytes", "rows"])

    got = keys.select("key", "size").mapInArrow(run, "i long, bytes long, rows long").groupBy("i").agg(F.sum("bytes"), F.sum("rows")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for i, b, r in got:
        size[i], rows[i] = b, r
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, shards: int, total: int, tolerance: float = TOLERANCE) -> list[int]:
    """The ``shards`` - 1 keys at which a new shard begins."""
    goals = [total * i // shards for i in range(1, shards)]
    brackets = {i: (0, _TOP) for i in range(len(goals))}
    best: dict[int, tuple[int, int]] = {}
    while brackets:
        probes = _probes(brackets, shards)
        below, rows = counted(keys, probes)
        for i, (lo, hi) in list(brackets.items()):
            nearest = int(np.argmin(np.abs(below - goals[i])))
            miss = abs(int(below[nearest]) - goals[i])
            if i not in best or miss < best[i][0]:
                best[i] = (miss, int(probes[nearest]))
            under = int(np.searchsorted(below, goals[i], side="right")) - 1
            new_lo = max(lo, int(probes[under])) if under >= 0 else lo
            new_hi = min(hi, int(probes[under + 1])) if under + 1 < len(probes) else hi
            inside = under >= 0 and under + 1 < len(probes) and rows[under + 1] - rows[under] <= 1
            if best[i][0] <= tolerance * total / shards or inside or new_hi - new_lo <= 1 or (new_lo, new_hi) == (lo, hi):
                del brackets[i]
            else:
                brackets[i] = (new_lo, new_hi)
    return sorted(best[i][1] for i in range(len(goals)))


def _probes(brackets: dict[int, tuple[int, int]], shards: int) -> np.ndarray:
    """Evenly spaced keys inside every open bracket; the first round, with one bracket for all, gets as many as later ones."""
    spans = set(brackets.values())
    each = PROBES * (shards if len(spans) == 1 and len(brackets) > 1 else 1)
    out = {lo + (hi - lo) * j // (each + 1) for lo, hi in spans for j in range(1, each + 1)}
    out |= {hi for _, hi in spans} | {lo for lo, _ in spans}
    return np.array(sorted(out), dtype=np.int64)


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    p, named = inner_prefix(docs), others(docs, "shard", "slot")
    rows = addressed(docs, "shard-documents", f"{p}file", f"{p}place")
    key, size = sort_key(text, doc_id, f"{p}file", f"{p}place"), text_bytes(text, overhead)
    keys = stage(rows.select(key.alias("key"), size.alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(keys, shards, total, tolerance) if total and shards > 1 else []
    # ``slices`` grows with the data, so that a slice stays near SLICE_BYTES
    slices = max(8, -(-total // (shards * SLICE_BYTES)))
    at = lambda k: F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col(k))) if cuts else F.lit(0)
    part = lambda k: F.pmod(F.xxhash64(k), F.lit(slices))
    counts = keys.select(at("key").alias("shard"), part("key").alias("slice")).groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias(f"{p}shard"), F.col("slice").alias(f"{p}slice"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{p}offset"))
    placed = rows.select(*named, key.alias(f"{p}key")).withColumns({f"{p}shard": at(f"{p}key"), f"{p}slice": part(f"{p}key")})
    inner = Window.partitionBy(f"{p}shard", f"{p}slice").orderBy(f"{p}key")
    return (placed.withColumn(f"{p}nth", F.row_number().over(inner)).join(offsets, [f"{p}shard", f"{p}slice"])
            .select(*named, F.col(f"{p}shard").alias("shard"), (F.col(f"{p}offset") + F.col(f"{p}nth") - 1).alias("slot")))
