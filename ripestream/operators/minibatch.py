"""Mini-batch training as local steps and averaged weights (I4).

Training rows are dealt into lanes by a seeded hash of their id, some
``LANE_ROWS`` rows each, and every lane is written as one packed row.  In an
epoch a task takes Adam steps on mini-batches through each of its lanes, in an
order seeded by epoch and lane, from the common weights.  Spark then averages
the lanes' weights and moments by their rows.  With a single lane this is plain
mini-batch Adam.

What a lane holds and does depends on ids and seeds alone, and lanes are added
up in exact decimals, so the layout of the input changes nothing in the log.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripestream.functions.nn import CE_EPS
from ripestream.operators.devices import probabilities
from ripestream.operators.models import Net

LANE_ROWS = 4096
B1, B2, EPS = 0.9, 0.999, 1e-7
_SUM = "decimal(38,14)"


def gradient(theta: np.ndarray, shape: tuple[int, int, int], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float, int]:
    """(summed weighted gradient, summed plain loss, hits) of a mini-batch."""
    net = Net.from_flat(theta, *shape)
    z1 = x @ net.w1 + net.b1
    h = np.maximum(z1, 0.0)
    p = probabilities(h @ net.w2 + net.b2)
    at = np.arange(len(y))
    loss, hits = float(-np.log(p[at, y] + CE_EPS).sum()), int((p.argmax(axis=1) == y).sum())
    d = p
    d[at, y] -= 1.0
    d *= w[:, None]
    d1 = (d @ net.w2.T) * (z1 > 0)
    return np.concatenate([(x.T @ d1).ravel(), d1.sum(axis=0), (h.T @ d).ravel(), d.sum(axis=0)]), loss, hits


def through_lane(state: np.ndarray, shape: tuple[int, int, int], x: np.ndarray, y: np.ndarray, w: np.ndarray, batch: int, lr: float, rng: np.random.Generator) -> tuple[np.ndarray, float, int]:
    """Adam steps through one lane from ``state`` (weights, both moments, steps so far)."""
    k = (len(state) - 1) // 3
    theta, m, v, t = state[:k].copy(), state[k : 2 * k].copy(), state[2 * k : 3 * k].copy(), state[-1]
    order, loss, hits = rng.permutation(len(y)), 0.0, 0
    for lo in range(0, len(y), batch):
        at = order[lo : lo + batch]
        g, l, n = gradient(theta, shape, x[at], y[at], w[at])
        g /= len(at)
        loss, hits, t = loss + l, hits + n, t + 1
        m = B1 * m + (1 - B1) * g
        v = B2 * v + (1 - B2) * g * g
        theta -= lr * (m / (1 - B1**t)) / (np.sqrt(v / (1 - B2**t)) + EPS)
    return np.concatenate([theta, m, v, [t]]), loss, hits


def lanes(df: DataFrame, features: Sequence[str], label: str, sample_id: str, role: str, weight: str | None, seed: int, lane_rows: int = LANE_ROWS) -> DataFrame:
    """(role, lane, n, x, y, w): the rows of each lane in order of their hash, packed."""
    names = [f"x{i}" for i in range(len(features))]
    known = F.col(label).isNotNull()
    for c in features:
        known = known & F.col(c).isNotNull()
    # as many lanes as keep the expected number of rows at lane_rows
    many = F.greatest(F.lit(1), F.ceil(df.where(known).agg(F.count(F.lit(1))).scalar() / lane_rows))
    turn = F.xxhash64(F.lit(seed), F.col(sample_id))
    rows = df.where(known).select(F.col(role).alias("role"), F.pmod(turn, many).cast("int").alias("lane"), turn.alias("turn"), F.col(sample_id).alias("sample"), F.col(label).cast("int").alias("y"),
                                  (F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)).cast("double").alias("w"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        here = None

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = np.stack([t.column(4 + i).to_numpy() for i in range(len(names))], axis=1)
            cells = [[here[0]], [here[1]], [len(x)], [x.tobytes()], [t.column(2).to_numpy().astype(np.int32).tobytes()], [t.column(3).to_numpy().tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["role", "lane", "n", "x", "y", "w"])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and here != keys[lo]:
                    yield row()
                    held = []
                here = keys[lo] if hi > lo else here
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield row()

    dealt = rows.repartition("role", "lane").sortWithinPartitions("role", "lane", "turn", "sample")
    return dealt.select("role", "lane", "y", "w", *names).mapInArrow(run, "role string, lane int, n long, x binary, y binary, w binary")


def epoch_pass(packed: DataFrame, state: np.ndarray, shape: tuple[int, int, int], epoch: int, batch: int, lr: float, seed: int, train: bool) -> tuple[dict[str, tuple[int, float, int]], np.ndarray]:
    """({role: (rows, summed loss, hits)}, averaged state).

    Validation rows are scored with ``state``; training rows too, unless they
    train: then their loss and hits are those met on the way.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for role, lane, n, x, y, w in zip(*(c.to_pylist() for c in part.columns)):
                x, y, w = np.frombuffer(x, np.float64).reshape(n, -1), np.frombuffer(y, np.int32), np.frombuffer(w, np.float64)
                if train and role == "fit":
                    after, loss, hits = through_lane(state, shape, x, y, w, batch, lr, np.random.default_rng([seed, epoch, lane]))
                else:
                    after, (_, loss, hits) = np.zeros(0), gradient(state[: (len(state) - 1) // 3], shape, x, y, w)
                values = np.concatenate([[n, loss, hits], after * n])
                yield pa.RecordBatch.from_arrays([pa.array([role] * len(values)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["role", "pos", "v"])

    got = packed.mapInArrow(run, "role string, pos int, v double").groupBy("role", "pos").agg(F.sum(F.col("v").cast(_SUM)).cast("double").alias("v")).collect()  # a row a weight
    sums: dict[str, dict[int, float]] = {}
    for r in got:
        sums.setdefault(r["role"], {})[r["pos"]] = r["v"]
    stats = {k: (int(s[0]), s[1], int(s[2])) for k, s in sums.items()}
    if train and "fit" in sums:
        state = np.array([sums["fit"][3 + i] for i in range(len(state))]) / sums["fit"][0]
    return stats, state


def train_minibatch(df: DataFrame, features: Sequence[str], label: str, sample_id: str, *, role: str = "role", weight: str | None = None, n_hidden: int = 16, n_out: int = 3, epochs: int = 200,
                    patience: int = 20, batch: int = 32, lr: float = 0.001, seed: int = 42, lane_rows: int = LANE_ROWS) -> tuple[Net, list[tuple]]:
    """(best net, log rows (epoch, loss, fit_acc, val_acc)) of mini-batch Adam on weighted cross-entropy (I4).

    Line 0 has the starting weights.  Later lines have the loss and accuracy met
    on the way through the training rows and the validation accuracy after the
    epoch.  Training stops when that hasn't risen for ``patience`` epochs; the
    best epoch's weights are returned.  An empty validation set is an error (Q7).
    Rows with a null feature or label take no part.
    """
    from ripestream.plans.common import write_table

    shape = (len(features), n_hidden, n_out)
    packed = write_table(lanes(df, features, label, sample_id, role, weight, seed, lane_rows), "lanes")
    start = np.asarray(Net.glorot(*shape, seed).flat())
    state = np.concatenate([start, np.zeros(2 * len(start) + 1)])
    stats, _ = epoch_pass(packed, state, shape, 0, batch, lr, seed, False)
    if not stats.get("val", (0,))[0]:
        raise ValueError("validation set is empty")
    rate = lambda s: s[2] / max(s[0], 1)
    fit = stats.get("fit", (0, 0.0, 0))
    log = [(0, fit[1] / max(fit[0], 1), rate(fit), rate(stats["val"]))]
    best, best_acc, since = start, -1.0, 0
    met = None
    for epoch in range(1, epochs + 2):  # a pass shows how well the epoch before it did
        stats, after = epoch_pass(packed, state, shape, epoch, batch, lr, seed, epoch <= epochs)
        if met is not None:
            acc = rate(stats["val"])
            log.append((epoch - 1, met[1] / max(met[0], 1), rate(met), acc))
            since = 0 if acc > best_acc else since + 1
            if acc > best_acc:
                best, best_acc = state[: len(start)], acc
            if since >= patience:
                break
        met, state = stats.get("fit", (0, 0.0, 0)), after
    return Net.from_flat(best, *shape), log
