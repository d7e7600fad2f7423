"""As-of and nearest-time joins (D1, D2, D10) without a per-row search.

Both sides are unioned into one time-ordered stream per key; the right side's
payload is packed into a struct that is forward-filled with
:func:`ripestream.operators.sequence.ffill` (chunked by time bucket, so a hot
key is still spread over many tasks).  This is a sort-once O((n+m) log)
plan; there is no equi-join on the key alone and no cross product.

Right rows without a key or time match nothing; left rows without one are kept
and get nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripestream.functions.clock import wall_micros
from ripestream.operators import sequence as seq


def _pack(df: DataFrame, cols: Sequence[str]):
    return F.struct(*[F.col(c) for c in cols])


def _matchable(right: DataFrame, key: str, ts: str) -> DataFrame:
    return right.where(F.col(key).isNotNull() & F.col(ts).isNotNull())


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    key: str,
    ts: str,
    right_cols: Sequence[str],
    *,
    left_id: str = "id",
    right_id: str = "id",
    prefix: str = "",
    width: Column | int | None = None,
) -> DataFrame:
    """Left rows + ``right_cols`` of the latest right row with ``right.ts <= left.ts``.

    Inclusive on equal timestamps; among right rows with equal time the one
    with the larger ``right_id`` wins.  No earlier right row -> NULLs.
    Returns all left columns plus ``prefix + c`` for each right column.
    """
    lcols, right = left.columns, _matchable(right, key, ts)
    l_part = left.select(
        F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.col(left_id).alias("_i"),
        _pack(left, lcols).alias("_l"), F.lit(None).cast(right.select(_pack(right, right_cols).alias("r")).schema["r"].dataType).alias("_r"),
    )
    r_part = right.select(
        F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.col(right_id).alias("_i"),
        F.lit(None).cast(left.select(_pack(left, lcols).alias("l")).schema["l"].dataType).alias("_l"),
        _pack(right, right_cols).alias("_r"),
    )
    both = l_part.unionByName(r_part)
    filled = seq.ffill(both, "_k", ["_t", "_side", "_i"], "_r", "_rf", width=width)
    return filled.where(F.col("_side") == 1).select(
        *[F.col(f"_l.{c}").alias(c) for c in lcols],
        *[F.col(f"_rf.{c}").alias(prefix + c) for c in right_cols],
    )


def nearest(
    left: DataFrame,
    right: DataFrame,
    key: str,
    ts: str,
    right_cols: Sequence[str],
    *,
    left_id: str = "id",
    right_id: str = "id",
    width: Column | int | None = None,
) -> DataFrame:
    """Right row closest in time to each left row (D2); ties -> the earlier one.

    One union of both sides, one ordering: the backward candidate is a
    forward fill and the forward candidate a backward fill of the packed right
    row, so both come out of the same sort.  Adds the chosen right columns,
    ``match_ts`` and ``gap_seconds``.
    """
    lcols, right = left.columns, _matchable(right, key, ts)
    rtype = right.select(_pack(right, [*right_cols, ts]).alias("r")).schema["r"].dataType
    ltype = left.select(_pack(left, lcols).alias("l")).schema["l"].dataType
    l_part = left.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_side"),
                         F.col(left_id).alias("_i"), _pack(left, lcols).alias("_l"), F.lit(None).cast(rtype).alias("_r"))
    r_part = right.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0).alias("_side"),
                          F.col(right_id).alias("_i"), F.lit(None).cast(ltype).alias("_l"),
                          _pack(right, [*right_cols, ts]).alias("_r"))
    both = l_part.unionByName(r_part)
    order = ["_t", "_side", "_i"]
    filled = seq.ffill(both, "_k", order, "_r", "_rb", width=width)
    filled = seq.bfill(filled, "_k", order, "_r", "_rf", width=width)
    us = lambda c: wall_micros(c)
    gb = (us(F.col("_t")) - us(F.col(f"_rb.{ts}"))) / 1e6
    gf = (us(F.col(f"_rf.{ts}")) - us(F.col("_t"))) / 1e6
    use_f = F.col("_rb").isNull() | (F.col("_rf").isNotNull() & (gf < gb))
    pick = F.when(F.col("_t").isNull(), F.lit(None)).when(use_f, F.col("_rf")).otherwise(F.col("_rb"))
    out = filled.where(F.col("_side") == 1).select(
        *[F.col(f"_l.{c}").alias(c) for c in lcols], pick.alias("_m"), F.when(use_f, gf).otherwise(gb).alias("gap_seconds"))
    return out.select(*lcols, *[F.col(f"_m.{c}").alias(c) for c in right_cols], F.col(f"_m.{ts}").alias("match_ts"),
                      "gap_seconds")
