"""Time-series helpers over ordered per-key rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripestream.operators import sequence as seq


def segments(df: DataFrame, key: str, order: Sequence[str], label: str, ts: str,
             width: Column | int | None = None) -> DataFrame:
    """Contiguous runs of equal ``label`` (NULL is a value of its own) per key.

    Output: (key, segment 1.., label, start_ts, end_ts, n_rows).
    """
    from ripestream.plans.common import write_table

    # positions and running sums read their input twice each: both steps are written
    rows = write_table(df.select(*dict.fromkeys([key, *order, label, ts])), "segment_rows").withColumn("_rs_lab", F.struct(F.col(label).alias("v")))
    lagged = seq.lag_values(rows, key, list(order), {"_rs_prev": "_rs_lab"}, width=width)
    change = F.when(F.col("_rs_prev").isNull() | ~(F.col("_rs_prev.v").eqNullSafe(F.col(label))), 1).otherwise(0)
    marked = write_table(lagged.select(*dict.fromkeys([key, *order, label, ts]), change.alias("_rs_change")), "segment_marks")
    staged = seq.running_sum(marked, key, list(order), F.col("_rs_change"), "segment", width=width)
    return staged.groupBy(key, F.col("segment").cast("long").alias("segment")).agg(
        F.first(label).alias(label), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
        F.count(F.lit(1)).alias("n_rows"))
