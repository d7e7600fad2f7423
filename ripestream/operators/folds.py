"""Leave-one-out training of all folds together.

There is one network a fold, trained on the rows of all other folds.  The
networks are one tensor: in a pass every row adds its gradient to all of them
but its own fold's, and Spark adds the tasks' tensors.  An epoch is one pass over
the rows, whatever the number of folds; the work grows with it, so a fold should
be a group of batches where there are many.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripestream.functions.nn import CE_EPS
from ripestream.operators.devices import probabilities
from ripestream.operators.models import Net

#: Bytes of the largest intermediate array of a task.
STEP_BYTES = 32 << 20


@dataclass
class FoldResult:
    fold: object
    n_train: int
    n_test: int
    loss: float
    confusion: np.ndarray
    net: Net

    @property
    def accuracy(self) -> float:
        return float(np.trace(self.confusion) / max(self.n_test, 1))

    @property
    def macro_f1(self) -> float:
        hit, actual, guessed = np.diag(self.confusion), self.confusion.sum(axis=1), self.confusion.sum(axis=0)
        p, r = hit / np.maximum(guessed, 1), hit / np.maximum(actual, 1)
        return float((2 * p * r / np.maximum(p + r, 1e-9)).mean())


def _pass(rows: DataFrame, theta: np.ndarray, shape: tuple[int, int, int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradients, summed plain training loss, confusion on the own rows) by fold."""
    folds = len(theta)
    d, h, k = shape
    cut = np.cumsum([d * h, h, h * k])
    step = max(1, STEP_BYTES // (8 * folds * max(h, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w1, b1, w2, b2 = (theta[:, : cut[0]].reshape(folds, d, h), theta[:, cut[0] : cut[1]], theta[:, cut[1] : cut[2]].reshape(folds, h, k), theta[:, cut[2] :])
        g, loss, seen = np.zeros_like(theta), np.zeros(folds), np.zeros((folds, k, k))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                own, y = part.column(0).to_numpy(), part.column(1).to_numpy()
                x = np.stack([part.column(2 + i).to_numpy() for i in range(d)], axis=1)
                at = np.arange(len(y))
                z1 = np.matmul(x[None], w1) + b1[:, None]
                a = np.maximum(z1, 0.0)
                p = probabilities(np.matmul(a, w2) + b2[:, None])
                np.add.at(seen, (own, y, p[own, at].argmax(axis=1)), 1)
                inside = (own[None, :] != np.arange(folds)[:, None]).astype(np.float64)
                loss += (inside * -np.log(p[:, at, y] + CE_EPS)).sum(axis=1)
                p[:, at, y] -= 1.0
                p *= (inside * weights[:, y])[:, :, None]
                d1 = np.matmul(p, w2.transpose(0, 2, 1)) * (z1 > 0)
                g += np.concatenate([np.matmul(x.T[None], d1).reshape(folds, -1), d1.sum(axis=1), np.matmul(a.transpose(0, 2, 1), p).reshape(folds, -1), p.sum(axis=1)], axis=1)
        v = np.concatenate([g.ravel(), loss, seen.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["pos", "v"])

    v = np.zeros(theta.size + folds + folds * k * k)
    for pos, s in rows.mapInArrow(run, "pos int, v double").groupBy("pos").agg(F.sum("v")).collect():  # a row a weight of each fold
        v[pos] = s
    return v[: theta.size].reshape(theta.shape), v[theta.size : theta.size + folds], v[theta.size + folds :].reshape(folds, k, k)


def train_folds(df: DataFrame, features: Sequence[str], label: str, fold: str, *, n_hidden: int = 16, n_out: int = 3, epochs: int = 60, lr: float = 0.02, seed: int = 42) -> list[FoldResult]:
    """One result a fold, in order of the folds: trained on all others, tested on itself.

    Full-batch Adam on cross-entropy weighted by the inverse class frequencies of
    the fold's own training rows, from the same starting weights.  ``loss`` is the
    plain training loss of the final weights.  Rows with a null fold, feature or
    label take no part; a fold without other folds trains on nothing.
    """
    from ripestream.plans.common import write_table

    known = F.col(label).isNotNull() & F.col(fold).isNotNull()
    for c in features:
        known = known & F.col(c).isNotNull()
    kept = df.where(known)
    count = kept.groupBy(F.col(fold).alias("fold"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()  # folds x classes
    names = sorted({r["fold"] for r in count})
    if not names:
        return []
    own = np.zeros((len(names), n_out))
    for r in count:
        own[names.index(r["fold"]), r["label"]] = r["n"]
    others = own.sum(axis=0) - own
    n_train = others.sum(axis=1)
    weights = n_train[:, None] / (n_out * np.maximum(others, 1))
    place = F.array_position(F.lit(names), F.col(fold)) - 1
    rows = write_table(kept.select(place.cast("int").alias("fold"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]), "folds")
    shape = (len(features), n_hidden, n_out)
    theta = np.repeat(np.asarray(Net.glorot(*shape, seed).flat())[None], len(names), axis=0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, epochs + 1):
        g, _, _ = _pass(rows, theta, shape, weights)
        g /= np.maximum(n_train, 1)[:, None]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    _, loss, seen = _pass(rows, theta, shape, weights)
    return [FoldResult(f, int(n_train[i]), int(own[i].sum()), float(loss[i] / max(n_train[i], 1)), seen[i], Net.from_flat(theta[i], *shape)) for i, f in enumerate(names)]
