"""Zone assignment and label coding (scalar Column functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names and their codes; 255 = unknown at serving time.
LABELS = ["Fresh", "Aging", "Degraded"]
LABEL_CODES = {"Fresh": 0, "Aging": 1, "Degraded": 2}
UNKNOWN_CODE = 255


def zone_for(value: Column, direction: Column, b1: Column, b2: Column, falling: str = "reference") -> Column:
    """Fresh / Aging / Degraded for a value given zone boundaries.

    Rising (direction > 0): ``< b1`` Fresh, ``< b2`` Aging, else Degraded.
    Falling: ``> b1`` Fresh, ``> b2`` Aging, else Degraded — with ``b1 < b2``
    Aging can never be reached; that is the reference behaviour and the
    default.  ``falling='mirrored'`` tests ``> b2`` then ``> b1`` instead.
    NULL zones or NULL value give NULL.
    """
    if falling == "mirrored":
        fall = F.when(value > b2, "Fresh").when(value > b1, "Aging").otherwise("Degraded")
    else:
        fall = F.when(value > b1, "Fresh").when(value > b2, "Aging").otherwise("Degraded")
    rise = F.when(value < b1, "Fresh").when(value < b2, "Aging").otherwise("Degraded")
    return (
        F.when(direction.isNull() | value.isNull(), F.lit(None).cast("string"))
        .when(direction > 0, rise)
        .otherwise(fall)
    )


def encode_label(label: Column) -> Column:
    """Label text -> code 0/1/2; anything else NULL."""
    expr = F.lit(None).cast("int")
    for name, code in reversed(list(LABEL_CODES.items())):
        expr = F.when(label == name, F.lit(code)).otherwise(expr)
    return expr


def decode_label(code: Column) -> Column:
    """Code -> text; 255 -> 'unknown'; other codes NULL."""
    expr = F.when(code == UNKNOWN_CODE, F.lit("unknown"))
    for name, c in LABEL_CODES.items():
        expr = expr.when(code == c, F.lit(name))
    return expr


def signal_strength(r: Column) -> Column:
    """|r| >= 0.3 STRONG, >= 0.1 weak, else noise (C14)."""
    a = F.abs(r)
    return F.when(a >= 0.3, "STRONG").when(a >= 0.1, "weak").when(a.isNotNull(), "noise")
