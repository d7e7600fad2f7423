"""Vector codes by product quantisation; the codebooks come from dual-tree Lloyd rounds.

Components become integers, vectors are cut into equal parts, and every part
position has a codebook of its own.  Rows are packed into chunks of at most
``CHUNK`` vectors.  A chunk holds, for every part position, a balanced tree over
its parts: the parts in tree order, and for each leaf its box and the sum of its
parts.  The trees are built once, written, and read in every round.

A round walks the tree of the parts and a tree of the codebook's entries
together, level by level.  Of the pairs (node of parts, node of entries), those
are dropped whose smallest possible distance is above the largest possible one
of another pair of the same node.  Once the entry nodes are single entries, an
entry is also dropped when another is nearer (or as near with a lower index) at
the corner of the box that suits it best.  A node with one entry left is
assigned as a whole by its cached sum; parts of undecided leaves are compared
with the entries that are left.  All bounds are integers, so the result is that
of comparing every part with every entry.

Tasks return sums and counts per entry, which Spark adds; the driver gets one
row an entry and sends the next codebooks.  Chunks are whole rows of a written
table, so a lost executor costs its tasks only.

Cases: rows whose vector is null, empty or holds null, NaN or infinite
components take no part, nor do vectors of another length than the smallest
kept id's.  The length must be a multiple of ``parts``.  Integers are held to
+-2**24 (components to +-65,536).  Equal ids at the start of a codebook are
ordered by their vectors; null ids come last.  Fewer vectors than entries give a
shorter codebook.  Repeated rows are coded one by one.  An empty table gives an
empty result.  Other columns are carried along under their own names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripestream.llm.common import stage
from ripestream.llm.vectors import usable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK, LEAF = 1 << 14, 16
LIMIT = 1 << 24


# ------------------------------------------------------------------ trees
def depth_of(n: int) -> int:
    """Levels below the root, so that a leaf holds about ``LEAF`` parts."""
    return max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))


def edges_of(n: int, depth: int) -> np.ndarray:
    """Where the leaves of a balanced tree over ``n`` parts begin, and ``n``."""
    return np.arange((1 << depth) + 1, dtype=np.int64) * n >> depth


def grow(points: np.ndarray, depth: int) -> np.ndarray:
    """Order of ``points`` in a balanced tree: every node is halved along its widest side."""
    n = len(points)
    order, leaves = np.arange(n), edges_of(n, depth)
    for level in range(depth):
        edges = leaves[:: 1 << (depth - level)]
        here = points[order]
        wide = (np.maximum.reduceat(here, edges[:-1]) - np.minimum.reduceat(here, edges[:-1])).argmax(axis=1)
        node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        order = order[np.lexsort((here[np.arange(n), wide[node]], node))]
    return order


@dataclass
class Level:
    """All nodes of one level: corners of their boxes, sums and numbers of their points."""

    lo: np.ndarray
    hi: np.ndarray
    total: np.ndarray
    count: np.ndarray


def levels_of(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, count: np.ndarray) -> list[Level]:
    """Levels from the root to the given leaves."""
    out = [Level(lo, hi, total, count)]
    while len(out[0].count) > 1:
        below = out[0]
        out.insert(0, Level(np.minimum(below.lo[::2], below.lo[1::2]), np.maximum(below.hi[::2], below.hi[1::2]), below.total[::2] + below.total[1::2], below.count[::2] + below.count[1::2]))
    return out


def leaves_of(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    edges = edges_of(len(points), depth)
    p = points.astype(np.int64)
    return np.minimum.reduceat(p, edges[:-1]), np.maximum.reduceat(p, edges[:-1]), np.add.reduceat(p, edges[:-1]), np.diff(edges)


@dataclass
class EntryTree:
    """Tree over the entries of one codebook; ``slot`` has the entry of each place of the last level."""

    levels: list[Level]
    slot: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> EntryTree:
        n = len(entries)
        depth = int(np.ceil(np.log2(n))) if n > 1 else 0
        # places beyond the entries repeat the last one, which leaves all boxes as they are
        padded = np.concatenate([np.arange(n), np.full((1 << depth) - n, n - 1)])
        slot = padded[grow(entries[padded], depth)]
        at = entries[slot].astype(np.int64)
        return EntryTree(levels_of(at, at, at, np.ones(len(at), np.int64)), slot)


def walk(levels: list[Level], tree: EntryTree, entries: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Decide nodes of parts: ([(level, nodes, their entries)], undecided leaves, entries left for them).

    The last two are pairs, ordered by leaf and then by entry.
    """
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    done: list[tuple[int, np.ndarray, np.ndarray]] = []
    deep = len(tree.levels) - 1
    i = j = 0
    while True:
        box, far = levels[i], tree.levels[j]
        lo, hi, elo, ehi = box.lo[node], box.hi[node], far.lo[other], far.hi[other]
        least = (np.maximum(np.maximum(elo - hi, lo - ehi), 0) ** 2).sum(axis=1)
        most = (np.maximum(np.abs(ehi - lo), np.abs(hi - elo)) ** 2).sum(axis=1)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(node)]))
        keep = least <= np.minimum.reduceat(most, first)[group]
        node, other, lo, hi = node[keep], other[keep], lo[keep], hi[keep]
        if j == deep:
            entry = tree.slot[other]
            by = np.lexsort((entry, node))
            node, other, entry, lo, hi = node[by], other[by], entry[by], lo[by], hi[by]
            once = np.r_[True, (node[1:] != node[:-1]) | (entry[1:] != entry[:-1])]
            node, other, entry, lo, hi = node[once], other[once], entry[once], lo[once], hi[once]
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(node)]))
            # the entry nearest to the middle of the box may dominate others
            middle = ((2 * entries[entry] - lo - hi) ** 2).sum(axis=1)
            best = np.flatnonzero(middle == np.minimum.reduceat(middle, first)[group])
            best = best[np.r_[True, group[best][1:] != group[best][:-1]]]
            a, b = entries[entry[best]][group], entries[entry]
            corner = np.where(b > a, hi, lo)
            gap = (b * b - a * a - 2 * corner * (b - a)).sum(axis=1)  # least of |x - b|**2 - |x - a|**2 in the box
            chosen = entry[best][group]
            keep = (entry == chosen) | (gap < 0) | ((gap == 0) & (entry < chosen))
            node, other, entry, group = node[keep], other[keep], entry[keep], group[keep]
            size = np.bincount(group)
            alone = size[group] == 1
            if alone.any():
                done.append((i, node[alone], entry[alone]))
                node, other, entry = node[~alone], other[~alone], entry[~alone]
            if i == len(levels) - 1 or not len(node):
                return done, node, entry
        if i < len(levels) - 1:
            node, other, i = np.stack([2 * node, 2 * node + 1], axis=1).ravel(), np.repeat(other, 2), i + 1
            by = np.argsort(node, kind="stable")
            node, other = node[by], other[by]
        if j < deep:
            node, other, j = np.repeat(node, 2), np.stack([2 * other, 2 * other + 1], axis=1).ravel(), j + 1


def nearest(points: np.ndarray, depth: int, leaf: np.ndarray, entry: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, entries) of the parts of undecided leaves, by exact distances to the entries left."""
    if not len(leaf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = edges_of(len(points), depth)
    size = np.diff(edges)[leaf]
    pair = np.repeat(np.arange(len(leaf)), size)
    place = edges[leaf][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    d = ((points[place].astype(np.int64) - entries[entry[pair]]) ** 2).sum(axis=1)
    by = np.argsort(place, kind="stable")  # within a place, entries stay in their order
    place, d, choice = place[by], d[by], entry[pair][by]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    low = d == np.repeat(np.minimum.reduceat(d, first), np.diff(np.r_[first, len(d)]))
    return place[first], np.minimum.reduceat(np.where(low, choice, len(entries)), first)


def chosen(points: np.ndarray, levels: list[Level], tree: EntryTree, entries: np.ndarray) -> np.ndarray:
    """Entry of every part, in tree order."""
    depth = len(levels) - 1
    out = np.empty(len(points), np.int64)
    edges = edges_of(len(points), depth)
    done, leaf, entry = walk(levels, tree, entries)
    for level, nodes, own in done:
        wide = edges[:: 1 << (depth - level)]
        size = np.diff(wide)[nodes]
        out[np.repeat(wide[nodes], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(own, size)
    place, own = nearest(points, depth, leaf, entry, entries)
    out[place] = own
    return out


def gathered(points: np.ndarray, levels: list[Level], tree: EntryTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, sum) of the parts of every entry; whole nodes count by their cached sums."""
    k, d = entries.shape
    count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
    done, leaf, entry = walk(levels, tree, entries)
    for level, nodes, own in done:
        np.add.at(count, own, levels[level].count[nodes])
        np.add.at(total, own, levels[level].total[nodes])
    place, own = nearest(points, len(levels) - 1, leaf, entry, entries)
    count += np.bincount(own, minlength=k)
    for c in range(d):
        total[:, c] += np.bincount(own, weights=points[place, c], minlength=k).astype(np.int64)  # exact: below 2**38
    return count, total


# ------------------------------------------------------------------ chunks
def whole(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int32)


def packed(vectors: np.ndarray, parts: int) -> tuple[bytes, bytes, bytes]:
    """(parts in tree order, their order, leaf boxes and sums) of one chunk, part position after part position."""
    n, dim = vectors.shape
    depth = depth_of(n)
    points, orders, leaves = [], [], []
    for p in np.split(vectors, parts, axis=1):
        order = grow(p, depth)
        points.append(np.ascontiguousarray(p[order]))
        orders.append(order.astype(np.uint16))
        lo, hi, total, _ = leaves_of(points[-1], depth)
        leaves += [lo, hi, total]
    return b"".join(x.tobytes() for x in points), b"".join(x.tobytes() for x in orders), np.stack(leaves).tobytes()


def unpacked(n: int, dim: int, parts: int, points: bytes, leaves: bytes) -> Iterator[tuple[np.ndarray, list[Level]]]:
    """(parts in tree order, levels of their tree) of each part position."""
    depth, d = depth_of(n), dim // parts
    p = np.frombuffer(points, np.int32).reshape(parts, n, d)
    x = np.frombuffer(leaves, np.int64).reshape(parts, 3, 1 << depth, d)
    size = np.diff(edges_of(n, depth))
    for i in range(parts):
        yield p[i], levels_of(x[i, 0], x[i, 1], x[i, 2], size)


def chunks(rows: DataFrame, vec: str, keep: list[str], dim: int, parts: int, scale: int) -> DataFrame:
    """Packed chunks: n, points, leaves, order and the kept columns as lists."""
    names = [f"c{i}" for i in range(len(keep))]
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("points", T.BinaryType()), T.StructField("leaves", T.BinaryType()), T.StructField("order", T.BinaryType()),
                           *[T.StructField(c, T.ArrayType(rows.schema[k].dataType)) for c, k in zip(names, keep)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> pa.RecordBatch:
            flat = table.column(0).combine_chunks()
            v = whole(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim), scale)
            points, order, leaves = packed(v, parts)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), table.column(i + 1).combine_chunks()) for i in range(len(keep))]
            return pa.RecordBatch.from_arrays([pa.array([len(flat)], pa.int32()), pa.array([points]), pa.array([leaves]), pa.array([order]), *lists], names=schema.names)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= CHUNK:
                table = pa.Table.from_batches(held)
                yield emit(table.slice(0, CHUNK))
                held = table.slice(CHUNK).to_batches()
        if sum(b.num_rows for b in held):
            yield emit(pa.Table.from_batches(held))

    return rows.select(F.col(vec), *[F.col(k).alias(c) for c, k in zip(names, keep)]).mapInArrow(run, schema)


def next_codebooks(packs: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One Lloyd round: every entry becomes the floored mean of its parts; unused ones stay."""
    parts, k, d = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree.of(c) for c in codebooks]
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for batch in batches:
            for n, points, leaves in zip(*(c.to_pylist() for c in batch.columns)):
                for p, (own, levels) in enumerate(unpacked(n, parts * d, parts, points, leaves)):
                    c, t = gathered(own, levels, trees[p], codebooks[p])
                    count[p] += c
                    total[p] += t
        at = np.flatnonzero(count.ravel())
        sums = total.reshape(parts * k, d)[at]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.ravel()[at]), *[pa.array(np.ascontiguousarray(sums[:, c])) for c in range(d)]], names=["at", "n", *[f"s{c}" for c in range(d)]])

    got = packs.select("n", "points", "leaves").mapInArrow(run, "at long, n long, " + ", ".join(f"s{c} long" for c in range(d)))
    out = codebooks.reshape(parts * k, d).copy()
    for at, n, *sums in got.groupBy("at").agg(F.sum("n"), *[F.sum(f"s{c}") for c in range(d)]).collect():  # a row an entry
        out[at] = [s // n for s in sums]
    return out.reshape(parts, k, d)


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, comma-joined, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encode(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
           scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows with all other columns, ``code`` (one byte a part) and ``error``, codebooks as parts x entries x positions)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    kept, dim = usable(df, vec_id, vec)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    keep = [c for c in df.columns if c.lower() not in (vec.lower(), "code", "error")]
    start = kept.select(vec).orderBy(F.col(vec_id).asc_nulls_last(), vec).limit(entries).collect()  # a codebook
    d = dim // parts
    codebooks = whole(np.array([r[0] for r in start]).reshape(len(start), parts, d), scale).astype(np.int64).transpose(1, 0, 2) if start else np.zeros((parts, 0, 0), np.int64)
    packs = stage(chunks(kept, vec, keep, dim, parts, scale), "code-chunks", group_rows=8)
    if start:
        for _ in range(rounds):
            codebooks = next_codebooks(packs, codebooks)
    names = [f"c{i}" for i in range(len(keep))]
    schema = T.StructType([*[T.StructField(c, df.schema[k].dataType) for c, k in zip(names, keep)], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree.of(c) for c in codebooks if len(c)]  # an empty table has no entries
        for batch in batches:
            for r in range(batch.num_rows):
                n, points, leaves, order = (batch.column(i)[r].as_py() for i in range(4))
                orders = np.frombuffer(order, np.uint16).reshape(parts, n)
                code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, (own, levels) in enumerate(unpacked(n, dim, parts, points, leaves)):
                    e = chosen(own, levels, trees[p], codebooks[p])
                    code[orders[p], p] = e
                    error[orders[p]] += ((own - codebooks[p][e]) ** 2).sum(axis=1)
                codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * parts).astype(np.int32)), pa.py_buffer(code)])
                yield pa.RecordBatch.from_arrays([*[batch.column(4 + i)[r].values for i in range(len(keep))], codes, pa.array(error)], names=schema.names)

    coded = packs.select("n", "points", "leaves", "order", *names).mapInArrow(run, schema)
    return coded.select(*[F.col(c).alias(k) for c, k in zip(names, keep)], "code", "error"), codebooks


def with_group_error(coded: DataFrame, group: str, out: str) -> DataFrame:
    """``coded`` (a written table) with the error summed over equal values of ``group``, nulls together."""
    sums = coded.groupBy(F.col(group).alias("__group")).agg(F.sum("error").alias("__error"))
    return coded.join(sums, F.col(group).eqNullSafe(F.col("__group"))).select(*[c for c in coded.columns if c.lower() != out.lower()], F.col("__error").alias(out))
