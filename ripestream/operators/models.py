"""Model-data operators re-aimed as Spark jobs.

Training is data parallel: every epoch one ``mapInPandas`` pass computes the
partial gradient sums of its partition with NumPy (weights travel in the
closure — a few hundred floats), one aggregate sums them, and the driver
applies the optimiser step to the small weight vector.  No training rows ever
reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripestream.operators import sequence as seq


# ------------------------------------------------------------------ I1, I2
def validation_split(df: DataFrame, batch: str, id_col: str, seed: int = 42, frac: float = 0.8) -> DataFrame:
    """Adds ``role`` in {fit, val}.

    Several batches: the last batch by *lexical* name (G4: ``batch10`` <
    ``batch3``) is the validation set.  One batch only: an exact 80/20 split in
    a seeded hash order (``xxhash64``), positions computed without a global
    window.  (The reference draws a NumPy permutation; the hash order is our
    deterministic equivalent.)
    """
    name = F.col(batch).cast("string")
    n_batches = df.select(batch).distinct().count()
    if n_batches > 1:
        last = df.agg(F.max(name)).scalar()
        return df.withColumn("role", F.when(name == last, "val").otherwise("fit"))
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    staged = df.withColumn("_h", h)
    n = df.count()
    staged = staged.withColumn("_one", F.lit(0))
    pos = seq.with_position(staged, "_one", ["_h", id_col], "_p",
                            bucket=F.floor(F.col("_h") / F.lit(float(2 ** 54))).cast("long"))
    return pos.withColumn("role", F.when(F.col("_p") <= int(frac * n), "fit").otherwise("val")).drop("_h", "_one", "_p")


# --------------------------------------------------------------- network
@dataclass
class Net:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def flat(self) -> list[float]:
        return [float(v) for v in np.concatenate([self.w1.ravel(), self.b1, self.w2.ravel(), self.b2])]

    @staticmethod
    def from_flat(flat: Sequence[float], n_in: int, n_hidden: int, n_out: int) -> "Net":
        a = np.asarray(flat, dtype=np.float64)
        i = 0
        w1 = a[i:i + n_in * n_hidden].reshape(n_in, n_hidden)
        i += n_in * n_hidden
        b1 = a[i:i + n_hidden]
        i += n_hidden
        w2 = a[i:i + n_hidden * n_out].reshape(n_hidden, n_out)
        i += n_hidden * n_out
        return Net(w1, b1, w2, a[i:i + n_out])

    @staticmethod
    def glorot(n_in: int, n_hidden: int, n_out: int, seed: int = 42) -> "Net":
        rng = np.random.default_rng(seed)
        l1 = np.sqrt(6 / (n_in + n_hidden))
        l2 = np.sqrt(6 / (n_hidden + n_out))
        return Net(rng.uniform(-l1, l1, (n_in, n_hidden)), np.zeros(n_hidden),
                   rng.uniform(-l2, l2, (n_hidden, n_out)), np.zeros(n_out))


def _forward(x: np.ndarray, w1, b1, w2, b2):
    z1 = x @ w1 + b1
    h = np.maximum(z1, 0.0)
    z2 = h @ w2 + b2
    z2 = z2 - z2.max(axis=1, keepdims=True)
    e = np.exp(z2)
    return z1, h, e / e.sum(axis=1, keepdims=True)


def _epoch_fn(flat: list[float], shape: tuple[int, int, int], features: list[str], label: str, weight: str,
              role: str | None, head_only: bool):
    n_in, n_hidden, n_out = shape

    def fn(it):
        net = Net.from_flat(flat, n_in, n_hidden, n_out)
        gw1 = np.zeros_like(net.w1)
        gb1 = np.zeros_like(net.b1)
        gw2 = np.zeros_like(net.w2)
        gb2 = np.zeros_like(net.b2)
        loss = plain = wsum = 0.0
        n = correct = vcorrect = vn = 0
        for pdf in it:
            if pdf.empty:
                continue
            x = pdf[features].to_numpy(dtype=np.float64)
            y = pdf[label].to_numpy(dtype=np.int64)
            is_fit = (pdf[role] == "fit").to_numpy() if role else np.ones(len(pdf), bool)
            z1, h, p = _forward(x, net.w1, net.b1, net.w2, net.b2)
            pred = p.argmax(axis=1)
            vcorrect += int((pred[~is_fit] == y[~is_fit]).sum())
            vn += int((~is_fit).sum())
            x, y, z1, h, p, pred = x[is_fit], y[is_fit], z1[is_fit], h[is_fit], p[is_fit], pred[is_fit]
            if len(y) == 0:
                continue
            w = pdf.loc[is_fit, weight].to_numpy(dtype=np.float64) if weight else np.ones(len(y))
            py = p[np.arange(len(y)), y]
            loss += float((w * -np.log(py + 1e-7)).sum())
            plain += float(-np.log(py + 1e-7).sum())
            wsum += float(w.sum())
            n += len(y)
            correct += int((pred == y).sum())
            dz2 = p.copy()
            dz2[np.arange(len(y)), y] -= 1.0
            dz2 *= w[:, None]
            gw2 += h.T @ dz2
            gb2 += dz2.sum(axis=0)
            if not head_only:
                dz1 = (dz2 @ net.w2.T) * (z1 > 0)
                gw1 += x.T @ dz1
                gb1 += dz1.sum(axis=0)
        import pandas as pd

        # statistics, then the gradient, as one vector
        v = np.concatenate([[loss, plain, wsum, n, correct, vcorrect, vn], gw1.ravel(), gb1, gw2.ravel(), gb2])
        yield pd.DataFrame({"pos": np.arange(len(v), dtype=np.int32), "v": v.astype(np.float64)})

    return fn


def _epoch(df: DataFrame, net: Net, features, label, weight, role, head_only: bool):
    shape = (net.w1.shape[0], net.w1.shape[1], net.w2.shape[1])
    parts = df.mapInPandas(_epoch_fn(net.flat(), shape, list(features), label, weight, role, head_only), "pos int, v double")
    # Partial vectors are added by Spark; the driver gets one number per parameter.
    rows = parts.groupBy("pos").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(7 + len(net.flat()))
    for r in rows:
        v[r["pos"]] = r["v"]
    loss, plain, _, n, correct, vcorrect, vn = (float(x) for x in v[:7])
    return loss, plain, int(n), int(correct), int(vcorrect), int(vn), v[7:]


def train_mlp(df: DataFrame, features: Sequence[str], label: str, *, role: str = "role", weight: str | None = None,
              n_hidden: int = 16, n_out: int = 3, epochs: int = 200, patience: int = 20, lr: float = 0.01,
              seed: int = 42) -> tuple[Net, list[tuple]]:
    """Full-batch Adam on weighted cross-entropy; early stop on validation accuracy, best weights kept (I4).

    ``df`` holds fit and val rows (``role``); returns (best net, log rows
    (epoch, loss, fit_acc, val_acc)).  The reference trains Keras mini-batches
    of 32; a data-parallel job takes one step per epoch, hence the larger
    default learning rate.  Raises on an empty validation set (Q7).
    """
    # Iterative: the projected training rows are written once (parquet in the
    # shared spark.checkpoint.dir) so every epoch scans a short lineage.
    from ripestream.plans.common import write_table

    df = write_table(df.select(*features, label, role, *([weight] if weight else [])).where(F.col(label).isNotNull()),
                     "train_rows")
    net = Net.glorot(len(features), n_hidden, n_out, seed)
    theta = np.asarray(net.flat())
    m = np.zeros_like(theta)
    v = np.zeros_like(theta)
    b1, b2, eps = 0.9, 0.999, 1e-7
    best, best_acc, since, log = theta.copy(), -1.0, 0, []
    shape = (len(features), n_hidden, n_out)
    for epoch in range(1, epochs + 1):
        cur = Net.from_flat(theta, *shape)
        _, plain, n, correct, vcorrect, vn, g = _epoch(df, cur, features, label, weight, role, False)
        if vn == 0:
            raise ValueError("validation set is empty")
        val_acc = vcorrect / vn
        log.append((epoch, plain / max(n, 1), correct / max(n, 1), val_acc))
        if val_acc > best_acc:
            best, best_acc, since = theta.copy(), val_acc, 0
        else:
            since += 1
            if since >= patience:
                break
        g = g / max(n, 1)
        m = b1 * m + (1 - b1) * g
        v = b2 * v + (1 - b2) * g * g
        mh = m / (1 - b1 ** epoch)
        vh = v / (1 - b2 ** epoch)
        theta = theta - lr * mh / (np.sqrt(vh) + eps)
    return Net.from_flat(best, *shape), log


def finetune_head(df: DataFrame, features: Sequence[str], label: str, net: Net, *, weight: str | None = None,
                  epochs: int = 10, lr: float = 0.4) -> tuple[Net, list[tuple]]:
    """Output-layer fine-tuning (I5 b): hidden layer frozen, steps along the mean weighted gradient.

    A step doesn't depend on the number of rows; the default rate stands for one
    pass of per-sample steps of 0.001 over some 400 rows.  The logged loss is
    unweighted.  Returns (tuned net, log rows (epoch, loss, acc)).
    """
    from ripestream.plans.common import write_table

    df = write_table(df.select(*features, label, *([weight] if weight else [])).withColumn("_role", F.lit("fit")),
                     "head_rows")
    theta = np.asarray(net.flat())
    shape = (net.w1.shape[0], net.w1.shape[1], net.w2.shape[1])
    n_head_from = shape[0] * shape[1] + shape[1]
    log = []
    for epoch in range(1, epochs + 1):
        cur = Net.from_flat(theta, *shape)
        _, plain, n, correct, _, _, g = _epoch(df, cur, features, label, weight, "_role", True)
        log.append((epoch, plain / max(n, 1), correct / max(n, 1)))
        g[:n_head_from] = 0.0
        theta = theta - lr * g / max(n, 1)
    return Net.from_flat(theta, *shape), log


def score_net(df: DataFrame, features: Sequence[str], net: Net, out: str = "pred") -> DataFrame:
    """Class of each row as a pure Column expression (no Python worker)."""
    from ripestream.functions import nn

    z = nn.forward(df, list(features), net.flat(), net.w1.shape[1], net.w2.shape[1])
    names = [f"z{k}" for k in range(net.w2.shape[1])]
    return z.withColumn(out, nn.argmax([F.col(c) for c in names])).drop(*names)
