"""Training jobs against plain loops: devices one by one, mini-batches in any layout, folds one by one."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripestream.operators import devices as dv
from ripestream.operators import folds as fo
from ripestream.operators import minibatch as mb
from ripestream.operators import models as md

FEATURES = ["a", "b", "c"]
SCHEMA = "device string, id long, a double, b double, c double, label int"


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(8)
    x = rng.random((400, 3)).round(4)
    y = (x[:, 0] + x[:, 1] > 1).astype(int) + (x[:, 2] > 0.7)
    device = rng.choice(["d0", "d0", "d1", "d2", None], 400)
    return [(device[i], i, *map(float, x[i]), int(y[i])) for i in range(400)] + [("d1", 900, None, 0.5, 0.5, 1), ("d2", 901, 0.1, 0.5, 0.5, None)]


def plain_device(rows, net, epochs, lr, seed):
    """One device, one sample at a time, without any library code."""
    w, b = net.w2.copy(), net.b2.copy()
    fit = [r for r in rows if r[1] % 3]
    count = [sum(r[5] == k for r in fit) for k in range(3)]
    losses = []
    for e in range(1, epochs + 1):
        order = sorted(fit, key=lambda r: (hashlib.md5(f"{seed}:{e}:{r[1]}".encode()).hexdigest()[:15], r[1]))
        total = 0.0
        for r in order:
            h = np.maximum(np.array(r[2:5]) @ net.w1 + net.b1, 0)
            z = h @ w + b
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            total -= np.log(p[r[5]] + 1e-7)
            d = len(fit) / (3 * count[r[5]]) * (p - np.eye(3)[r[5]])
            w, b = w - lr * np.outer(h, d), b - lr * d
        losses.append(total / len(fit))
    return losses, [*w.ravel(), *b]


def test_devices_equal_a_plain_loop(spark, samples):
    net = md.Net.glorot(3, 5, 3, 1)
    got = {}
    for parts in (1, 5):
        df = dv.tune_devices(spark.createDataFrame(samples, SCHEMA).repartition(parts), "device", "id", FEATURES, "label", net, fit=F.col("id") % 3 != 0, epochs=3, lr=0.05)
        rows = {r["device"]: r for r in df.collect()}
        got[parts] = {k: (r["losses"], r["weights"], r["before"], r["after"]) for k, r in rows.items()}
    assert got[1] == got[5] and set(got[1]) == {"d0", "d1", "d2", None}
    for d in got[1]:
        own = [r for r in samples if r[0] == d and r[5] is not None and r[2] is not None]
        losses, weights = plain_device(own, net, 3, 0.05, 42)
        assert np.allclose(got[1][d][0], losses) and np.allclose(got[1][d][1], weights)
        assert rows[d]["n_fit"] + rows[d]["n_eval"] == len(own)
    none = dv.tune_devices(spark.createDataFrame([], SCHEMA), "device", "id", FEATURES, "label", net)
    assert none.collect() == []
    idle = dv.tune_devices(spark.createDataFrame(samples[:9], SCHEMA), "device", "id", FEATURES, "label", net, fit=F.lit(False)).collect()
    assert all(r["losses"] == [] and np.allclose(r["weights"], dv.flat_head(dv.head_of(net))) and r["before"] == r["after"] for r in idle)


def _roles(spark, samples, copies=1):
    rows = [(*r[:1], r[1] + 1000 * c, *r[2:]) for c in range(copies) for r in samples]
    return spark.createDataFrame(rows, SCHEMA).withColumn("role", F.when(F.col("id") % 5 == 0, "val").otherwise("fit")).withColumn("w", F.lit(1.0))


def test_mini_batches_are_alike_in_any_layout(spark, samples):
    df = _roles(spark, samples, 2)
    logs = [mb.train_minibatch(df.repartition(n), FEATURES, "label", "id", weight="w", epochs=3, lr=0.01, lane_rows=100)[1] for n in (1, 6)]
    assert logs[0] == logs[1] and len(logs[0]) == 4 and logs[0][-1][1] < logs[0][0][1]


def test_one_lane_is_plain_adam_on_batches_of_32(spark, samples):
    df = _roles(spark, samples)
    net, log = mb.train_minibatch(df, FEATURES, "label", "id", epochs=2, patience=9, lr=0.01)
    order = [r["id"] for r in df.where("role = 'fit' and label is not null and a is not null").orderBy(F.xxhash64(F.lit(42), "id"), "id").select("id").collect()]
    of = {r[1]: r for r in samples}
    x, y = np.array([of[i][2:5] for i in order]), np.array([of[i][5] for i in order])
    theta = np.asarray(md.Net.glorot(3, 16, 3, 42).flat())
    m, v, t, losses = np.zeros_like(theta), np.zeros_like(theta), 0, []
    for e in (1, 2):
        perm, total = np.random.default_rng([42, e, 0]).permutation(len(y)), 0.0
        for lo in range(0, len(y), 32):
            at = perm[lo : lo + 32]
            g, loss, _ = mb.gradient(theta, (3, 16, 3), x[at], y[at], np.ones(len(at)))
            g, t, total = g / len(at), t + 1, total + loss
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
        losses.append(total / len(y))
    assert np.allclose([r[1] for r in log[1:]], losses, atol=1e-9)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    x, y, w = rng.random((7, 3)), rng.integers(0, 3, 7), rng.random(7)
    theta = np.asarray(md.Net.glorot(3, 4, 3, 2).flat())
    loss = lambda t: sum(wi * mb.gradient(t, (3, 4, 3), x[i : i + 1], y[i : i + 1], np.ones(1))[1] for i, wi in enumerate(w))
    g = mb.gradient(theta, (3, 4, 3), x, y, w)[0]
    numeric = [(loss(theta + d) - loss(theta - d)) / 2e-6 for d in np.eye(len(theta)) * 1e-6]
    assert np.allclose(g, numeric, atol=1e-4)


def test_mini_batches_do_no_worse_than_the_full_batch(spark, samples):
    df = _roles(spark, samples)
    _, full = md.train_mlp(df, FEATURES, "label", epochs=25, patience=25, lr=0.01)
    _, mini = mb.train_minibatch(df, FEATURES, "label", "id", epochs=25, patience=25, lr=0.01)
    assert max(r[3] for r in mini[1:]) >= max(r[3] for r in full) - 1e-9
    with pytest.raises(ValueError):
        mb.train_minibatch(df.where("role = 'fit'"), FEATURES, "label", "id", epochs=1)


def test_folds_together_equal_folds_one_by_one(spark, samples):
    df = spark.createDataFrame(samples, SCHEMA).withColumn("fold", F.concat(F.lit("f"), (F.col("id") % 3).cast("string")))
    got = fo.train_folds(df, FEATURES, "label", "fold", n_hidden=6, epochs=5)
    assert [r.fold for r in got] == ["f0", "f1", "f2"]
    rows = [r for r in samples if r[2] is not None and r[5] is not None]
    x, y, f = np.array([r[2:5] for r in rows]), np.array([r[5] for r in rows]), np.array([r[1] % 3 for r in rows])
    for k, r in enumerate(got):
        train, theta = f != k, np.asarray(md.Net.glorot(3, 6, 3, 42).flat())
        w = (train.sum() / (3 * np.maximum(np.bincount(y[train], minlength=3), 1)))[y[train]]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, 6):
            g = mb.gradient(theta, (3, 6, 3), x[train], y[train], w)[0] / train.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
        assert np.allclose(r.net.flat(), theta, atol=1e-8) and r.n_train == train.sum() and r.n_test == (~train).sum()
        _, loss, hits = mb.gradient(theta, (3, 6, 3), x[~train], y[~train], np.ones((~train).sum()))
        assert abs(r.accuracy - hits / (~train).sum()) < 1e-12
    assert fo.train_folds(df.where("id < 0"), FEATURES, "label", "fold") == []
