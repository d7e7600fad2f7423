"""Which rows of a vector table take part, for the operators on vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: str | Column) -> Column:
    """The vector is there, holds something, and every component is a finite number."""
    x = F.col(vec) if isinstance(vec, str) else vec
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    return F.coalesce((F.size(x) > 0) & fine, F.lit(False))


def usable(df: DataFrame, vec_id: str, vec: str, *extra: Column) -> tuple[DataFrame, int]:
    """Rows with a finite vector of the common length, and that length (0: no such row).

    The common length is that of the smallest id's vector (rows without an id
    come last, the longer of two vectors of one id counts).
    """
    ok = df.where(finite(vec))
    for more in extra:
        ok = ok.where(more)
    n = F.size(vec)
    dim = ok.agg(F.min(F.struct(F.col(vec_id).isNull().alias("unnamed"), F.col(vec_id).alias("id"), (-n).alias("n"))).alias("m")).first()["m"]
    dim = -dim["n"] if dim else 0
    return ok.where(n == dim), dim
