"""Dense 10 -> 16 (ReLU) -> 3 (softmax) network as Column expressions.

Scoring is plain arithmetic on columns, so it stays inside whole-stage
codegen: no Python worker, no arrays.  Weights use the reference's flat
layout: W1[10×16] ‖ B1[16] ‖ W2[16×3] ‖ B2[3], row-major (227 floats).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The network shape of the reference model.
N_IN, N_HIDDEN, N_OUT = 10, 16, 3
N_WEIGHTS = N_IN * N_HIDDEN + N_HIDDEN + N_HIDDEN * N_OUT + N_OUT  # 227
UNKNOWN_CLASS = 255
CE_EPS = 1e-7


def unpack(flat: Sequence[float], n_in: int = N_IN, n_hidden: int = N_HIDDEN, n_out: int = N_OUT) -> tuple[list[list[float]], list[float], list[list[float]], list[float]]:
    """Split the flat layout into W1 (in × hidden), B1, W2 (hidden × out), B2."""
    expected = n_in * n_hidden + n_hidden + n_hidden * n_out + n_out
    if len(flat) != expected:
        raise ValueError(f"expected {expected} weights, got {len(flat)}")
    take = iter(flat)
    row = lambda n: [next(take) for _ in range(n)]
    return [row(n_hidden) for _ in range(n_in)], row(n_hidden), [row(n_out) for _ in range(n_hidden)], row(n_out)


def formula_weights(seed: float = 0.3, n: int = N_WEIGHTS) -> list[float]:
    """Deterministic demo weights from a rule (4-decimal values), used by the registered scoring queries."""
    return [round(0.5 * math.sin(0.7 * i + seed), 4) for i in range(n)]


def softmax(z: Sequence[Column]) -> list[Column]:
    """Stable softmax: subtract the max before ``exp``."""
    m = F.greatest(*z)
    e = [F.exp(v - m) for v in z]
    total = e[0]
    for v in e[1:]:
        total = total + v
    return [v / total for v in e]


def argmax(z: Sequence[Column]) -> Column:
    """Index of the largest value, first index wins ties."""
    expr = F.lit(len(z) - 1)
    for k in range(len(z) - 2, -1, -1):
        cond = F.lit(True)
        for j in range(k + 1, len(z)):
            cond = cond & (z[k] >= z[j])
        for j in range(k):
            cond = cond & (z[k] > z[j])
        expr = F.when(cond, F.lit(k)).otherwise(expr)
    return expr


def cross_entropy(probs: Sequence[Column], y: Column) -> Column:
    """``-ln(p[y] + 1e-7)`` for class index ``y`` (C11)."""
    py = F.lit(None).cast("double")
    for k in range(len(probs) - 1, -1, -1):
        py = F.when(y == k, probs[k]).otherwise(py)
    return -F.log(py + F.lit(CE_EPS))


def forward(df: DataFrame, x: Sequence[str], flat: Sequence[float], n_hidden: int = N_HIDDEN, n_out: int = N_OUT) -> DataFrame:
    """``df`` with the output layer's values ``z0``, ``z1``, ...: the one forward pass, in two projections.

    Each unit is one SQL expression (a single parse instead of a call per weight).
    """
    w1, b1, w2, b2 = unpack(flat, len(x), n_hidden, n_out)
    unit = lambda names, weights, bias: " + ".join(f"{n} * {float(w)!r}D" for n, w in zip(names, weights)) + f" + {float(bias)!r}D"
    hidden = [f"__h{j}" for j in range(n_hidden)]
    first = df.select("*", *[F.expr(f"greatest({unit(x, [row[j] for row in w1], b1[j])}, 0.0D)").alias(h) for j, h in enumerate(hidden)])
    return first.select(*df.columns, *[F.expr(unit(hidden, [row[k] for row in w2], b2[k])).alias(f"z{k}") for k in range(n_out)])
