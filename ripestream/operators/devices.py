"""Exact per-sample training of the output layer, one set of weights a device (I5 a, J10).

Every device starts from the same network, keeps its hidden layer and updates
its own output layer after each sample, in a seeded order that changes with the
epoch.  Steps of one device depend on each other, so a device is one sequence;
its rows come to a task in order and are never gathered: a task holds one
device's weights and one Arrow batch.  Weights are rows keyed by device.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripestream.functions.nn import CE_EPS
from ripestream.operators.models import Net


def hidden_of(x: np.ndarray, net: Net) -> np.ndarray:
    """Frozen hidden features of each row, with a one for the bias behind them."""
    return np.concatenate([np.maximum(x @ net.w1 + net.b1, 0.0), np.ones((len(x), 1))], axis=1)


def head_of(net: Net) -> np.ndarray:
    """Output layer as one row a class: its weights, then its bias."""
    return np.concatenate([net.w2.T, net.b2[:, None]], axis=1)


def flat_head(head: np.ndarray) -> list[float]:
    """Output layer in the flat layout: weights hidden unit by hidden unit, then biases."""
    return [*head[:, :-1].T.ravel().tolist(), *head[:, -1].tolist()]


def head_from(flat: Sequence[float], n_out: int) -> np.ndarray:
    a = np.asarray(flat, np.float64)
    return np.concatenate([a[:-n_out].reshape(-1, n_out).T, a[-n_out:, None]], axis=1)


def probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def walk_samples(head: np.ndarray, h: np.ndarray, y: np.ndarray, weight: np.ndarray, lr: float) -> tuple[float, int]:
    """One step after each sample, in place; (sum of losses before the steps, hits before the steps)."""
    loss, hits = 0.0, 0
    for row, label, w in zip(h, y.tolist(), weight.tolist()):
        p = probabilities(head @ row)
        loss -= float(np.log(p[label] + CE_EPS))
        hits += int(p.argmax() == label)
        p[label] -= 1.0
        head -= (lr * w) * p[:, None] * row
    return loss, hits


def look_at(head: np.ndarray, h: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """(sum of losses, hits) without steps."""
    p = probabilities(h @ head.T)
    return float(-np.log(p[np.arange(len(y)), y] + CE_EPS).sum()), int((p.argmax(axis=1) == y).sum())


def sample_order(seed: int, epoch: Column, sample_id: str) -> Column:
    """Seeded order of an epoch: 60 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col(sample_id).cast("string"))
    return F.substring(F.md5(text), 1, 15)


def class_weighted(df: DataFrame, device: str, label: str, n_classes: int, counted: Column, out: str) -> DataFrame:
    """``df`` with the inverse-frequency weight of each row's class among the ``counted`` rows of its device."""
    sums = df.where(counted).groupBy(F.col(device).alias("_d"), F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    total = sums.groupBy(F.col("_d").alias("_dd")).agg(F.sum("_n").alias("_all"))
    table = sums.join(total, F.col("_d").eqNullSafe(F.col("_dd"))).select("_d", "_c", (F.col("_all") / (n_classes * F.col("_n"))).alias(out))
    return df.join(table, F.col(device).eqNullSafe(F.col("_d")) & (F.col(label) == F.col("_c")), "left").drop("_d", "_c")


def runs(column: pa.Array) -> list[tuple[object, int, int]]:
    """(value, first row, end row) of each run of equal values; nulls are equal."""
    coded = pc.run_end_encode(column)
    ends = coded.run_ends.to_pylist()
    return list(zip(coded.values.to_pylist(), [0, *ends[:-1]], ends))


def tune_devices(df: DataFrame, device: str, sample_id: str, features: Sequence[str], label: str, net: Net, *, fit: Column | None = None, epochs: int = 10,
                 lr: float = 0.001, seed: int = 42) -> DataFrame:
    """Fine-tuned output layer of every device: (device, n_fit, n_eval, losses, accuracies, before, after, weights).

    Rows that fulfil ``fit`` train, ``epochs`` times; ``losses`` and
    ``accuracies`` are those met on the way, by epoch.  The other rows are scored
    with the weights before and after (``before``, ``after``: accuracy, null
    without such rows).  A device without training rows keeps its weights.  Rows
    with a null feature or label take no part; a null device is a device.
    """
    n_out, names = net.w2.shape[1], list(features)
    known = F.col(label).isNotNull()
    for c in names:
        known = known & F.col(c).isNotNull()
    trains = F.coalesce(fit, F.lit(False)) if fit is not None else F.lit(True)
    rows = class_weighted(df.where(known).withColumn("_fit", trains), device, label, n_out, F.col("_fit"), "_w")
    # one row for each time a sample is met: training epochs, or before (0) and after
    times = F.when(F.col("_fit"), F.sequence(F.lit(1), F.lit(epochs))).otherwise(F.array(F.lit(0), F.lit(epochs + 1)))
    met = rows.select(F.col(device).alias("device"), F.explode(times).alias("epoch"), F.col(sample_id).alias("sample"), F.col(label).cast("int").alias("y"), F.coalesce("_w", F.lit(0.0)).alias("w"),
                      *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    met = met.withColumn("turn", sample_order(seed, F.col("epoch"), "sample"))
    order = ["device", "epoch", "turn", "sample"]
    schema = T.StructType([T.StructField("device", df.schema[device].dataType), T.StructField("n_fit", T.LongType()), T.StructField("n_eval", T.LongType()),
                           T.StructField("losses", T.ArrayType(T.DoubleType())), T.StructField("accuracies", T.ArrayType(T.DoubleType())),
                           T.StructField("before", T.DoubleType()), T.StructField("after", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    base = net.flat()
    shape = (net.w1.shape[0], net.w1.shape[1], n_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net.from_flat(base, *shape)
        here, head, sums = None, head_of(own), {}

        def row() -> pa.RecordBatch:
            n, m = sums.get(1, (0, 0, 0))[0], sums.get(0, (0, 0, 0))[0]
            trained = [sums[e] for e in range(1, epochs + 1)] if n else []
            cells = [here[0], n, m, [s[1] / n for s in trained], [s[2] / n for s in trained], sums[0][2] / m if m else None, sums[epochs + 1][2] / m if m else None, flat_head(head)]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, cells))], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                lists = pa.list_(pa.float64())
                arrow = pa.schema(list(zip(schema.names, [batch.schema.field(0).type, pa.int64(), pa.int64(), lists, lists, pa.float64(), pa.float64(), lists])))
            if not batch.num_rows:
                continue
            epoch, y, w = (batch.column(i).to_numpy() for i in (1, 2, 3))
            h = hidden_of(np.stack([batch.column(4 + i).to_numpy() for i in range(len(names))], axis=1), own)
            for value, lo, hi in runs(batch.column(0)):
                if here != (value,):
                    if here is not None:
                        yield row()
                    here, head, sums = (value,), head_of(own), {}
                cuts = [lo, *(np.flatnonzero(np.diff(epoch[lo:hi])) + lo + 1).tolist(), hi]
                for a, b in zip(cuts, cuts[1:]):
                    e = int(epoch[a])
                    got = walk_samples(head, h[a:b], y[a:b], w[a:b], lr) if 1 <= e <= epochs else look_at(head, h[a:b], y[a:b])
                    n, loss, hits = sums.get(e, (0, 0.0, 0))
                    sums[e] = (n + b - a, loss + got[0], hits + got[1])
        if here is not None:
            yield row()

    dealt = met.repartition("device").sortWithinPartitions(*order)
    return dealt.select("device", "epoch", "y", "w", *[f"x{i}" for i in range(len(names))]).mapInArrow(run, schema)
