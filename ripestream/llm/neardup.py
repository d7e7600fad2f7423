"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct word shingles.  ``PERMUTATIONS`` hash
functions run over the set once; each gives two signature values, its minimum
and its maximum.  Both agree for two sets with probability equal to their
Jaccard similarity, so 128 evaluations make a signature of 256 values.  Bands
of ``ROWS`` values form buckets: at similarity 0.8 a pair shares no bucket with
probability (1 - 0.8**6)**42 < 3e-6.

Equal sets collapse into one node first.  The links are found in two steps:

1. In every bucket each member is compared with the bucket's smallest node.
   This connects most of a group of copies with one comparison a member.
2. Only buckets whose members still lie in several components remain.  Their
   nodes get a finer signature (``FINE`` further hash functions), and members of
   different components are matched on it, in cells of at most 2 * ``CELL``
   members, so that no task holds a whole bucket.  Only links leave a cell.

So every candidate pair is either compared or already in one component.  Pairs
whose signatures agree too little (six standard deviations below the threshold)
are dropped; all others are confirmed on their full shingle sets, read again from
the texts of the documents concerned.  Rows are told apart by their address, never
by their id.

Cases: a text that is null or has no words has no set, links with nothing and
is its own component.  Fewer words than a shingle: the whole sequence is the
one shingle.  A null doc_id takes part; a component's id is its smallest
non-null doc_id, and rows without an id are kept only if no row of their
component has one.  Rows that repeat an id and text share ``kept``; ``chosen``
marks exactly one row of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripestream.llm import text as tx
from ripestream.llm.common import addressed, inner_prefix, stage
from ripestream.llm.graph import components

PERMUTATIONS, ROWS = 128, 6
VALUES = 2 * PERMUTATIONS
BANDS = VALUES // ROWS
#: Members of one node that a task compares; more are dealt to several tasks, each with the node's set.
SHARE = 512
#: Hash functions of the finer signature; members and shingles of a slice of a bucket, two of which meet in a cell.
FINE, CELL, CELL_SHINGLES = 384, 1024, 1 << 20

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**31, PERMUTATIONS + FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, PERMUTATIONS + FINE, dtype=np.uint32)
_K = np.uint64(0xBF58476D1CE4E5B9)


def shingle_sets(page: tx.Page, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of every text, in text order."""
    h, at = page.grams(k)
    d = page.doc[at]
    for short in range(1, k):
        own = np.flatnonzero(page.counts == short)
        if len(own):
            firsts = np.concatenate([[0], np.cumsum(np.full(len(own), short))])
            idx = (page.first[own][:, None] + np.arange(short)).ravel()
            g, _ = tx.grams(page.words[idx], firsts, short)
            h, d = np.concatenate([h, g]), np.concatenate([d, own])
    _, one = np.unique(tx.salted(h, d), return_index=True)
    one = one[np.argsort(d[one], kind="stable")]
    return h[one], d[one]


def signatures(h: np.ndarray, starts: np.ndarray, first: int = 0, count: int = PERMUTATIONS) -> np.ndarray:
    """One row of minima and maxima under ``count`` hash functions for each segment of ``h``."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), 2 * count), np.uint32)
    y = np.empty_like(x)
    for p in range(count):
        np.multiply(x, _A[first + p], out=y)
        y += _B[first + p]
        out[:, p] = np.minimum.reduceat(y, starts)
        out[:, count + p] = np.maximum.reduceat(y, starts)
    return out


def low_bytes(sig: np.ndarray) -> np.ndarray:
    """One byte of each value: enough to tell how many agree."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    v = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), v.shape[:2]).copy()
    for j in range(ROWS):
        key = tx.mix(key * _K + v[:, :, j])
    return key.view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def set_digest(h: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, a, b): 128 bits that only depend on the set of each text."""
    size = np.bincount(d, minlength=n).astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    out = []
    for salt in (_K, np.uint64(0x94D049BB133111EB)):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(h ^ salt))])
        out.append((c[edge[1:]] - c[edge[:-1]]).view(np.int64))
    return size, *out


SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                       T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])


def sketches(docs: DataFrame, doc_id: str, text: str, k: int, address: tuple[str, ...] = ()) -> DataFrame:
    """Set size, set digest, band keys and one byte of each signature value of every document, with its ``address`` columns."""
    schema = T.StructType([*SKETCH.fields, *[docs.schema[c] for c in address]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tx.pieces(batch.column(1)):
                page = tx.Page(data, offs, tx.INKED, lower=True)
                h, d = shingle_sets(page, k)
                size, a, b = set_digest(h, d, page.n)
                full = np.flatnonzero(size)
                sig = np.zeros((page.n, VALUES), np.uint32)
                if len(full):
                    sig[full] = signatures(h, (np.cumsum(size) - size)[full])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, page.n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band_keys(sig).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(a), pa.array(b), bands, _binary(low_bytes(sig)),
                                                   *[c.slice(lo, hi - lo) for c in batch.columns[2:]]], names=schema.names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *address).mapInArrow(run, schema)


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y) whose signatures don't rule the threshold out."""
    least = threshold - 6 * (threshold * (1 - threshold) / VALUES) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, VALUES) for i in (2, 3))
                ok = (left == right).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["x", "y"])

    sig = nodes.select("node", "sig")
    joined = pairs.join(sig.select(F.col("node").alias("x"), F.col("sig").alias("sx")), "x").join(sig.select(F.col("node").alias("y"), F.col("sig").alias("sy")), "y")
    return joined.select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long")


def full_sets(nodes: DataFrame, docs: DataFrame, text: str, k: int, address: tuple[str, ...]) -> DataFrame:
    """(node, members): the sorted shingle hashes of the given nodes (node, address), from their rows' texts."""
    texts = docs.select(F.col(text).alias("text"), *address).join(nodes.select("node", *address), list(address)).select("text", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tx.pieces(batch.column(0)):
                page = tx.Page(data, offs, tx.INKED, lower=True)
                h, d = shingle_sets(page, k)
                edge = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=page.n))])
                sets = [np.sort(h[x:y]).tobytes() for x, y in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["node", "members"])

    return texts.mapInArrow(run, "node long, members binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` with 100 * intersection >= percent * union on their full sets."""
    parts = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("parts"))
    dealt = pairs.join(parts, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("parts")).alias("part"))
    places = dealt.select(F.col("y").alias("node"), "x", "part", F.lit(1).alias("role")).unionByName(
        dealt.select(F.col("x").alias("node"), "x", "part", F.lit(0).alias("role")).distinct())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for x, part, role, y, members in zip(*(c.to_pylist() for c in batch.columns)):
                members = np.frombuffer(members, np.uint64)
                if role == 0:
                    at, own = (x, part), members
                elif at == (x, part):
                    if similar(own, members, percent):
                        good.append((x, y))
            yield pairs_batch(good)

    placed = places.join(sets, "node").select("x", "part", "role", F.col("node").alias("y"), "members")
    return placed.repartition("x", "part").sortWithinPartitions("x", "part", "role").mapInArrow(compare, "x long, y long")


def fine_signatures(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, fine, short): bytes of the finer signature and the low halves of the band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                members = [np.frombuffer(m, np.uint64) for m in part.column(1).to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(m) for m in members])])[:-1]
                fine = low_bytes(signatures(np.concatenate(members), starts, PERMUTATIONS, FINE))
                keys = part.column(2).flatten().to_numpy().astype(np.int32).reshape(-1, BANDS)
                yield pa.RecordBatch.from_arrays([part.column(0), _binary(fine), _binary(keys.view(np.uint8).reshape(len(keys), -1))], names=["node", "fine", "short"])

    return sets.join(nodes.select("node", "bands"), "node").select("node", "members", "bands").mapInArrow(run, "node long, fine binary, short binary")


def linked(live: DataFrame, fine: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between different components in the buckets of ``live`` (key, node, root, n_shingles).

    A bucket is cut into slices, and every two slices meet in a cell.  Inside a
    cell, pairs whose finer signatures agree are compared on their full sets in
    their first shared bucket, unless a link found before has connected them;
    only links leave the cell.
    """
    values, threshold = 2 * FINE, percent / 100
    least = threshold - 6 * (threshold * (1 - threshold) / values) ** 0.5
    slices = live.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL), F.ceil(F.sum("n_shingles") / CELL_SHINGLES)).alias("slices"))
    sliced = live.join(slices, "key").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    cells = sliced.select("key", "node", "root", "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("other")).select(
        "key", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "node", "root")

    def links(group: list[tuple]) -> list[tuple[int, int]]:
        key, i, j = group[0][:3]
        part, node = (np.array([g[c] for g in group], np.int64) for c in (3, 4))
        comp = np.unique(np.array([g[5] for g in group], np.int64), return_inverse=True)[1]
        if not comp.any():
            return []
        sig = np.frombuffer(b"".join(g[6] for g in group), np.uint8).reshape(-1, values)
        short = np.frombuffer(b"".join(g[7] for g in group), np.int32).reshape(-1, BANDS)
        members = [np.frombuffer(g[8], np.uint64) for g in group]
        here = np.int64(key).astype(np.int32)
        out = []
        for a in range(len(group) - 1):
            rest = np.flatnonzero((comp[a + 1 :] != comp[a]) & ((part[a + 1 :] != part[a]) if i != j else True)) + a + 1
            near = rest[(sig[rest] == sig[a]).mean(axis=1) >= least] if len(rest) else rest
            near = near[short[a][(short[near] == short[a]).argmax(axis=1)] == here] if len(near) else near
            for b in near.tolist():
                if comp[a] != comp[b] and similar(members[a], members[b], percent):
                    out.append((int(node[a]), int(node[b])))
                    comp[comp == comp[b]] = comp[a]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    out += links(held)
                    held = []
                held.append(row)
            yield pairs_batch(out)
        if held:
            yield pairs_batch(links(held))

    full = cells.join(fine, "node").join(sets, "node").select("key", "i", "j", "slice", "node", "root", "fine", "short", "members")
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "x long, y long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    spot = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[spot] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.int64()) for c in (0, 1)], names=["x", "y"])


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, address: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_shingles, set digest (a, b), component_id, kept, chosen and the ``address`` columns.

    ``address`` names columns that tell the rows of ``docs`` apart and stay the
    same each time it is read; without, the rows' places in their files are taken.
    ``chosen`` marks one row of each component: that of the smallest doc_id (nulls
    last), of several the one written first.
    """
    given = address
    if not address:
        p = inner_prefix(docs)
        address = (f"{p}file", f"{p}at")
        docs = addressed(docs, "near-documents", *address)
    rows = stage(sketches(docs, doc_id, text, k, address).withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    classes = stage(rows.where("n_shingles > 0").groupBy("a", "b").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), first), "classes")
    firsts = rows.select(F.col("row").alias("node"), "n_shingles", "bands", "sig", *address)
    nodes = stage(classes.join(firsts, "node"), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot")).where("members > 1").select("key", "pivot")
    members = stage(keyed.join(crowded, "key"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", *address), "node")
    sets = stage(full_sets(wanted, docs, text, k, address), "sets")
    # step 1: everybody against the first of each bucket
    stars = members.where("node <> pivot").select(F.col("pivot").alias("x"), F.col("node").alias("y")).distinct()
    links = stage(confirmed(stage(likely(stars, nodes, percent / 100), "likely"), sets, percent), "links")
    labels = stage(components(links), "labels")
    # step 2: buckets that still hold several components
    state = members.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = state.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("key")
    live = stage(state.join(mixed, "key").join(nodes.select("node", "n_shingles"), "node"), "live")
    fine = stage(fine_signatures(sets.join(live.select("node").distinct(), "node"), nodes), "fine")
    labels = components(links.unionByName(linked(live, fine, sets, percent)))
    placed = classes.join(labels, "node", "left").select("a", "b", "low", "first", F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.min("first").alias("chosen"))
    final = placed.select("a", "b", "root").join(ids, "root").select("a", "b", "component_id", F.col("chosen.row").alias("chosen"))
    out = rows.select("doc_id", "n_shingles", "a", "b", "row", *address).join(final, ["a", "b"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    chosen = F.when(F.col("n_shingles") > 0, F.col("row") == F.col("chosen")).otherwise(F.lit(True))
    verdict = out.select("doc_id", "n_shingles", "a", "b", own.alias("component_id"), chosen.alias("chosen"), *given)
    return verdict.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
