"""Nearest neighbours by largest inner product along shifted Hilbert curves.

Vectors get one more component, which makes the largest inner product the
smallest distance: sqrt(M**2 - |x|**2) for a candidate, 0 for a query scaled to
the length M (M: the longest vector).  For each of ``CURVES`` curves the result
is projected onto ``AXES`` random orthogonal axes; a coordinate is the share of
a normal distribution (fitted on a sample of ``FIT_ROWS`` rows) below it,
shifted by a random offset of the curve; and the coordinates' place on the
Hilbert curve is the key.

All keys of all curves are range-partitioned and sorted by Spark once, which
numbers the candidates of each curve.  A query looks at the candidates up to
``reach`` places before and behind it on every curve.  These windows are cut
along blocks of candidates, and a task compares a block (16 bits a component)
with the queries whose windows touch it.  The best of all windows are
merged, and ranked again by exact inner products of the original vectors.

The reach isn't a constant.  ``CHECK_QUERIES`` of the queries are compared with
all candidates, and the reach is the least that finds ``RECALL`` of their
neighbours on some curve.  Clustered vectors need narrow windows; vectors
without any structure need wide ones, up to the whole table.

Rows of equal vectors are one candidate, which carries its ``k`` + 1 smallest
ids: more can't be among k neighbours.  So a vector that a third of all rows
hold is searched, and found, once.

Cases: vectors that are null, empty, zero, of another length than the smallest
id's, or hold null, NaN or infinite components, and rows without an id take no
part.  Ids that repeat are different rows; a query leaves out its own row only.
Fewer candidates than ``k`` give fewer neighbours; an empty table or no query
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripestream.llm.common import stage
from ripestream.llm.vectors import usable

CURVES, AXES, BITS = 8, 8, 7
#: Rows that the axes' distributions are fitted on; queries that set the reach, and the share of their neighbours it finds.
FIT_ROWS, CHECK_QUERIES, RECALL = 4096, 256, 0.96
#: Candidates of a block; best ones of a window that are ranked again, for each neighbour asked for.
BLOCK, SPARE = 1 << 14, 2
_ERF = np.vectorize(erf, otypes=[np.float64])
#: Normal distribution function in steps of 1/256 between -6 and 6.
_NORMAL = (1 + _ERF(np.arange(-6 * 256, 6 * 256 + 1) / 256 / np.sqrt(2))) / 2


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``grid`` (whole numbers below 2**bits, at most 63 bits in all)."""
    n, axes = grid.shape
    x = [np.ascontiguousarray(grid[:, i]).astype(np.int64) for i in range(axes)]
    # from the coarsest bit down, turn and mirror the cube that the point lies in
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(axes):
            set_ = (x[i] >> b) & 1 == 1
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[i] = x[i] ^ swap
            x[0] = x[0] ^ np.where(set_, low, swap) if i else np.where(set_, x[0] ^ low, x[0])
    for i in range(1, axes):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return key


class Curves:
    """Axes, offsets and fitted distributions of all curves; small, and sent to the tasks as it is."""

    def __init__(self, dim: int, longest: float, sample: np.ndarray, curves: int, axes: int, bits: int, seed: int = 12) -> None:
        rng = np.random.default_rng(seed)
        self.bits, self.longest = bits, longest
        axes = min(axes, dim + 1)
        self.axes = np.stack([np.linalg.qr(rng.standard_normal((dim + 1, axes)))[0] for _ in range(curves)])
        self.offset = rng.random((curves, axes))
        y = np.einsum("nd,cda->nca", self.lifted(sample), self.axes)
        self.mean, self.spread = y.mean(axis=0), np.maximum(y.std(axis=0), 1e-12)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Candidates with the added component, as shares of the longest vector."""
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def aimed(self, x: np.ndarray) -> np.ndarray:
        """Queries at full length, with an added component of 0."""
        return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)

    def keys(self, points: np.ndarray, curve: int) -> np.ndarray:
        z = (points @ self.axes[curve] - self.mean[curve]) / self.spread[curve]
        share = _NORMAL[np.clip(np.rint(z * 256), -6 * 256, 6 * 256).astype(np.int64) + 6 * 256]
        return hilbert_keys(np.minimum((1 << self.bits) - 1, ((share + self.offset[curve]) * (1 << self.bits - 1)).astype(np.int64)), self.bits)


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """One row a distinct vector: node, vec, its ``k`` + 1 smallest (vec_id, row), whether a query has it, its longest length."""
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id", "row"))  # Spark keeps k + 1 of a group in each task before it shuffles
    first = rows.select("a", "b", "vec_id", "row", "vec").withColumn("nth", nth).where(F.col("nth") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct("vec_id", "row")))
    nodes = first.groupBy("a", "b").agg(F.min("row").alias("node"), ids.alias("ids"), F.first("vec").alias("vec"))
    asked = rows.where("asked").select("a", "b", F.lit(True).alias("asked")).distinct()
    return nodes.join(asked, ["a", "b"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Columns of the ``most`` largest scores of each row."""
    return np.argpartition(-scores, most - 1, axis=1)[:, :most] if scores.shape[1] > most else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)


def keyed(nodes: DataFrame, curves: Curves) -> DataFrame:
    """(curve, key, node, role) of every node as a candidate (role 0) and of queries (role 1)."""
    count = len(curves.axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x, node, asked = _vectors(part.column(1)), part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
                for points, own, role in ((curves.lifted(x), node, 0), (curves.aimed(x[asked]), node[asked], 1)):
                    for c in range(count if len(own) else 0):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), pa.array(curves.keys(points, c)), pa.array(own), pa.array(np.full(len(own), role, np.int32))],
                                                         names=["curve", "key", "node", "role"])

    return nodes.select("node", "vec", "asked").mapInArrow(run, "curve int, key long, node long, role int")


def ranked(keys: DataFrame, each: int) -> DataFrame:
    """(curve, node, role, rank): places on each curve, from one range partitioning; every curve has ``each`` rows."""
    order = ["curve", "key", "node", "role"]
    sorted_ = stage(keys.repartitionByRange(*order).sortWithinPartitions(*order).select("curve", "node", "role", F.monotonically_increasing_id().alias("at")), "curve-order")
    part = F.shiftright("at", 33)
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    placed = sorted_.withColumn("part", part).join(before, "part")
    return placed.select("curve", "node", "role", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("curve") * F.lit(each)).alias("rank"))


def true_neighbours(nodes: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(q, node): the ``k`` best candidates of each of a few queries, by comparison with all nodes."""
    names, aim = np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, whose = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                node = part.column(0).to_numpy()
                scores = aim @ _vectors(part.column(1)).T
                scores[names[:, None] == node[None, :]] = -np.inf
                scores, ids = np.concatenate([best, scores], axis=1), np.concatenate([whose, np.broadcast_to(node, scores.shape)], axis=1)
                at = _best(scores, k)
                best, whose = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
        real = np.isfinite(best).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])[real]), pa.array(whose.ravel()[real]), pa.array(best.ravel()[real])], names=["q", "node", "score"])

    found = nodes.select("node", "vec").mapInArrow(run, "q long, node long, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "node"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select("q", "node")


def reach_for(places: DataFrame, pairs: DataFrame, recall: float) -> int:
    """Least number of places within which a share ``recall`` of the pairs (q, node) meet on some curve."""
    theirs = places.where("role = 0").join(pairs, "node").select("q", "node", "curve", "rank")
    ours = places.where("role = 1").join(pairs.select(F.col("q").alias("node")).distinct(), "node").select(F.col("node").alias("q"), "curve", F.col("rank").alias("own"))
    gap = theirs.join(ours, ["q", "curve"]).groupBy("q", "node").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("gap"))
    return int(np.ceil(gap.agg(F.percentile("gap", F.lit(recall))).first()[0] or 0))


def windows(places: DataFrame, codes: DataFrame, reach: int, block: int, each: int, most: int) -> DataFrame:
    """(q, near): of every window, the ``most`` best candidates as structs (minus approximate score, node)."""
    home = places.where("role = 0").select("curve", F.floor(F.col("rank") / block).alias("block"), "role", "node")
    first = F.greatest(F.lit(0), F.floor((F.col("rank") - reach) / block))
    last = F.least(F.lit((each - 1) // block), F.floor((F.col("rank") + reach) / block))
    seen = places.where("role = 1").select("curve", F.explode(F.sequence(first, last)).alias("block"), "role", "node")
    met = home.unionByName(seen).join(codes, "node").select("curve", "block", "role", "node", "code", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ready = None, [], None
        for batch in batches:
            at = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                if here != tuple(at[lo, :2]):
                    here, held, ready = tuple(at[lo, :2]), [], None
                node, unit = batch.column(3).slice(lo, hi - lo).to_numpy(), batch.column(5).slice(lo, hi - lo).to_numpy()
                code = np.frombuffer(b"".join(batch.column(4).slice(lo, hi - lo).to_pylist()), np.int16).reshape(hi - lo, -1).astype(np.float64)
                if at[lo, 2] == 0:  # candidates come before queries
                    held.append((node, unit, code))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = [np.concatenate(x) for x in zip(*held)]
                for f in range(0, hi - lo, 256):
                    scores = (code[f : f + 256] @ ready[2].T) * ready[1]  # sums of whole numbers below 2**53: exact, and alike on every curve
                    best = _best(scores, most)
                    score = np.take_along_axis(scores, best, 1) * unit[f : f + 256, None]
                    rows = pa.StructArray.from_arrays([pa.array(-score.ravel()), pa.array(ready[0][best.ravel()])], names=["minus", "node"])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), rows)
                    yield pa.RecordBatch.from_arrays([pa.array(node[f : f + 256]), lists], names=["q", "near"])

    dealt = met.repartition("curve", "block").sortWithinPartitions("curve", "block", "role", "node")
    return dealt.mapInArrow(run, "q long, near array<struct<minus: double, node: long>>")


def coded(nodes: DataFrame) -> DataFrame:
    """(node, code, unit): 16 bits a component, in units of the vector's largest one / 32,767."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = _vectors(part.column(1))
                unit = np.abs(x).max(axis=1) / 32767
                code = np.rint(x / unit[:, None]).astype(np.int16)
                codes = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer((np.arange(len(code) + 1) * 2 * code.shape[1]).astype(np.int32)), pa.py_buffer(code)])
                yield pa.RecordBatch.from_arrays([part.column(0), codes, pa.array(unit)], names=["node", "code", "unit"])

    return nodes.select("node", "vec").mapInArrow(run, "node long, code binary, unit double")


def exact(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, node, score) with the inner product in double precision."""
    mine = nodes.select(F.col("node").alias("q"), F.col("vec").alias("v"))
    dot = F.aggregate(F.zip_with("v", "vec", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(nodes.select("node", "vec", "ids"), "node").join(mine, "q").select("q", "ids", dot.alias("score"))


def search(df: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", curves: int = CURVES, axes: int = AXES, bits: int = BITS,
           recall: float = RECALL, block: int = BLOCK, reach: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that fulfils ``queries``, nearest first.

    ``reach`` fixes the places looked at on each side, instead of the measured number.
    """
    ok, dim = usable(df, vec_id, vec, F.col(vec_id).isNotNull(), F.exists(vec, lambda x: x != 0))
    picked = ok.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = stage(picked.select("*", F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b"), F.monotonically_increasing_id().alias("row")), "curve-rows")
    nodes = stage(nodes_of(rows, k), "curve-nodes")
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, asked, longest = nodes.agg(F.count(F.lit(1)), F.count_if("asked"), F.sqrt(F.max(squares))).first()
    if not asked:
        empty = rows.where(F.lit(False))
        return empty.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    by_hash = F.xxhash64("vec", F.lit(3))
    fitted = nodes.select("vec").orderBy(by_hash, "node").limit(FIT_ROWS).collect()
    shape = Curves(dim, float(longest), np.array([r[0] for r in fitted], np.float64), curves, axes, bits)
    each = total + asked
    places = stage(ranked(keyed(nodes, shape), each), "curve-places")
    if reach is None:
        tried = [(r[0], r[1]) for r in nodes.where("asked").select("node", "vec").orderBy(by_hash, "node").limit(CHECK_QUERIES).collect()]
        reach = reach_for(places, stage(true_neighbours(nodes, tried, k), "curve-truth"), recall)
    reach = max(reach, k)
    found = windows(places, stage(coded(nodes), "curve-codes"), reach, min(block, max(1024, reach)), each, SPARE * (k + 1))
    # a candidate comes at most once from each curve, so the best ones are among as many times their number
    most = SPARE * (k + 1)
    merged = found.groupBy("q").agg(F.slice(F.array_distinct(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most * curves)), 1, most).alias("near"))
    pairs = stage(merged.select("q", F.explode("near.node").alias("node")), "curve-pairs")
    one = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i["vec_id"].alias("vec_id"), i["row"].alias("row")))
    lists = exact(pairs, nodes).groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(one))), 1, k + 1).alias("near"))
    # rows that share a vector share its neighbours, less themselves
    own = rows.where("asked").join(nodes.where("asked").select("a", "b", F.col("node").alias("q")), ["a", "b"]).select("q", "row", F.col("vec_id").alias("query_id"))
    mine = own.join(lists, "q").select("query_id", F.slice(F.filter("near", lambda x: x["row"] != F.col("row")), 1, k).alias("near"))
    each_one = mine.select("query_id", F.posexplode("near").alias("at", "x"))
    return each_one.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
