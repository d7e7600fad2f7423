"""Ordered per-key sequence operators that stay parallel when one key is hot.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one
task.  When a single batch/device holds a third of all rows that task is the
whole job.  The helpers here split each key's sequence into time buckets and
only run small windows over per-bucket summaries:

* :func:`ffill` — last non-null value so far (forward fill / as-of carry).
* :func:`with_position` — dense 1-based row position inside the key.
* :func:`rolling` — centred/lagged row frames via fixed-size position blocks
  with a halo of neighbouring rows copied in.

A null key is a key like any other, and rows without a time stand before the
key's other rows, as in a plain window: summaries are joined null-safely.

There is one path for all sizes.  The width of a bucket is a number or a scalar
subquery (:func:`bucket_width`), so that the densest bucket of the hottest key
holds about ``ROWS_PER_BUCKET`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripestream.functions.clock import wall_micros

DAY_US = 86_400_000_000
ROWS_PER_BUCKET = 1_000_000
#: Bucket width for integer order columns, which number the rows of a key (cycle numbers).
NUMBERS_PER_BUCKET = 100_000


def _cols(names: Sequence[str] | str) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _conf_int(name: str, default: int) -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return int(spark.conf.get(name, str(default))) if spark is not None else default


def _joined(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of ``summary``, matched on ``keys``; null matches null."""
    theirs = {k: f"_rs_key{i}" for i, k in enumerate(keys)}
    same = F.lit(True)
    for k, t in theirs.items():
        same = same & F.col(k).eqNullSafe(F.col(t))
    return rows.join(summary.withColumnsRenamed(theirs), same, "left").drop(*theirs.values())


def bucket_width(df: DataFrame, keys: Sequence[str] | str, ts: str, rows: int = ROWS_PER_BUCKET) -> Column:
    """Bucket width in microseconds as a scalar subquery: a day, or less where a day of some key has more than ``rows`` rows.

    Give it the raw table (it reads the key and time columns only).
    """
    day = F.floor(wall_micros(ts) / DAY_US)
    most = df.groupBy(*_cols(keys), day.alias("_rs_day")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    return most.select(F.greatest(F.lit(1), F.least(F.lit(DAY_US), F.floor(F.lit(DAY_US) * rows / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))))).cast("long")).scalar()


def time_bucket(ts: str | Column, width: Column | int | None = None) -> Column:
    """Bucket number of a timestamp for a width in microseconds (a day by default)."""
    w = F.lit(DAY_US) if width is None else F.lit(width) if isinstance(width, int) else width
    return F.floor(wall_micros(ts) / w).cast("long")


def order_bucket(df: DataFrame, column: str, width: Column | int | None = None) -> Column:
    """Non-decreasing bucket of an order column: by time, or by value if it is a number."""
    kind = df.schema[column].dataType.typeName()
    if kind.startswith("timestamp"):
        return time_bucket(column, width)
    if kind == "date":
        return F.floor(F.unix_date(column) / 365).cast("long")
    return F.floor(F.col(column) / NUMBERS_PER_BUCKET).cast("long")


def ffill(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str],
    value: str,
    out: str,
    *,
    width: Column | int | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """``out`` = last non-null ``value`` at or before each row, per key, in ``order``.

    ``bucket`` must be non-decreasing in ``order`` (a time bucket of the first
    order column); each (key, bucket) is windowed on its own and the value
    carried in from earlier buckets comes from a window over one summary row
    per (key, bucket).
    """
    keys = _cols(keys)
    order_cols = [F.col(c) for c in order]
    if bucket is None:
        bucket = order_bucket(df, order[0], width)
    b = "_rs_bucket"
    staged = df.withColumn(b, bucket)
    w_local = Window.partitionBy(*keys, b).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    staged = staged.withColumn("_rs_local", F.last(value, ignorenulls=True).over(w_local))
    order_struct = F.struct(*order_cols)
    # One summary row per (key, bucket): the bucket's last non-null value.
    # ``max_by`` skips rows whose ordering is NULL, so null values never win.
    summary = staged.groupBy(*keys, b).agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order_struct)).alias("_rs_bucket_last")
    )
    w_carry = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys, b, F.last("_rs_bucket_last", ignorenulls=True).over(w_carry).alias("_rs_prev")
    )
    joined = _joined(staged, carry, [*keys, b])
    return joined.withColumn(out, F.coalesce("_rs_local", "_rs_prev")).drop(b, "_rs_local", "_rs_prev")


def with_position(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str],
    out: str = "_pos",
    *,
    width: Column | int | None = None,
    bucket: Column | None = None,
    with_count: str | None = None,
) -> DataFrame:
    """Dense 1-based position of each row inside its key, in ``order``.

    Count rows per (key, bucket), prefix-sum the counts over the small
    per-bucket summary, then add the row number inside the bucket.  Optionally
    adds ``with_count`` = number of rows of the key.
    """
    keys = _cols(keys)
    order_cols = [F.col(c) for c in order]
    if bucket is None:
        bucket = order_bucket(df, order[0], width)
    b = "_rs_bucket"
    staged = df.withColumn(b, bucket)
    counts = staged.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_rs_n"))
    w_off = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, b, F.coalesce(F.sum("_rs_n").over(w_off), F.lit(0)).alias("_rs_off"),
        *([F.sum("_rs_n").over(Window.partitionBy(*keys)).alias(with_count)] if with_count else []),
    )
    res = _joined(staged, offsets, [*keys, b])
    w_in = Window.partitionBy(*keys, b).orderBy(*order_cols)
    return res.withColumn(out, (F.col("_rs_off") + F.row_number().over(w_in)).cast("long")).drop(b, "_rs_off")


def rolling(
    df: DataFrame,
    keys: Sequence[str] | str,
    pos: str,
    exprs: dict[str, "callable"],
    before: int,
    after: int,
    *,
    block: int | None = None,
) -> DataFrame:
    """Apply row-frame window expressions over ``pos`` without one task per key.

    ``exprs`` maps an output name to ``fn(window_spec) -> Column`` where the
    window spec is already partitioned and ordered; the frame
    ``rowsBetween(-before, after)`` is the caller's to add (so lag/lead also
    work).  Rows are grouped into blocks of ``block`` consecutive positions;
    the ``before`` rows preceding and ``after`` rows following each block are
    copied in as a halo, so every frame sees exactly the rows it would see in
    one big window.
    """
    keys = _cols(keys)
    block = block or _conf_int("ripestream.blockRows", 8192)
    blk = F.floor((F.col(pos) - 1) / block).cast("long")
    off = ((F.col(pos) - 1) % block).cast("long")
    # home copy: 0; copy into next block (this row is in the previous block's
    # tail, needed as "before" context): 1; copy into previous block: -1.
    targets = F.array(
        F.lit(0),
        *([F.when(off >= block - before, F.lit(1))] if before > 0 else []),
        *([F.when(off < after, F.lit(-1))] if after > 0 else []),
    )
    staged = (
        df.withColumn("_rs_shift", F.explode(targets))
        .where(F.col("_rs_shift").isNotNull())
        .withColumn("_rs_block", blk + F.col("_rs_shift"))
    )
    w = Window.partitionBy(*keys, "_rs_block").orderBy(pos)
    for name, fn in exprs.items():
        staged = staged.withColumn(name, fn(w))
    return staged.where(F.col("_rs_shift") == 0).drop("_rs_shift", "_rs_block")


def running_sum(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str],
    value: Column,
    out: str,
    *,
    width: Column | int | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order`` (prefix sums).

    Per-(key, bucket) totals, prefix-summed over the small summary
    window, plus the running sum inside the bucket.
    """
    keys = _cols(keys)
    order_cols = [F.col(c) for c in order]
    if bucket is None:
        bucket = order_bucket(df, order[0], width)
    b = "_rs_bucket"
    staged = df.withColumn(b, bucket).withColumn("_rs_v", value)
    totals = staged.groupBy(*keys, b).agg(F.sum("_rs_v").alias("_rs_t"))
    w_off = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, b, F.coalesce(F.sum("_rs_t").over(w_off), F.lit(0)).alias("_rs_off"))
    w_in = Window.partitionBy(*keys, b).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    res = _joined(staged, offsets, [*keys, b])
    return res.withColumn(out, F.col("_rs_off") + F.sum("_rs_v").over(w_in)).drop(b, "_rs_off", "_rs_v")


def lag_values(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str],
    cols: dict[str, str],
    *,
    width: Column | int | None = None,
    offset: int = 1,
) -> DataFrame:
    """``out = lag(src, offset)`` for each ``{out: src}`` per key in ``order``.

    Positions first, then position blocks with a halo of ``offset``
    rows (see :func:`rolling`).  Leaves a ``_pos`` column.
    """
    keys = _cols(keys)
    pos = with_position(df, keys, order, "_pos", width=width)
    return rolling(pos, keys, "_pos", {o: (lambda w, s=s: F.lag(s, offset).over(w)) for o, s in cols.items()},
                   offset, 0)


def bfill(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str],
    value: str,
    out: str,
    *,
    width: Column | int | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """``out`` = first non-null ``value`` at or after each row, per key (mirror of :func:`ffill`).

    Written as a forward fill over the reversed order: a frame running to
    UNBOUNDED FOLLOWING would be re-aggregated for every row (quadratic).
    """
    keys = _cols(keys)
    desc = [F.col(c).desc() for c in order]
    if bucket is None:
        bucket = order_bucket(df, order[0], width)
    b = "_rs_bucket"
    staged = df.withColumn(b, bucket)
    w_local = Window.partitionBy(*keys, b).orderBy(*desc).rowsBetween(Window.unboundedPreceding, 0)
    staged = staged.withColumn("_rs_local_b", F.last(value, ignorenulls=True).over(w_local))
    order_struct = F.struct(*[F.col(c) for c in order])
    summary = staged.groupBy(*keys, b).agg(
        F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order_struct)).alias("_rs_bucket_first"))
    w_carry = Window.partitionBy(*keys).orderBy(F.col(b).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, b, F.last("_rs_bucket_first", ignorenulls=True).over(w_carry).alias("_rs_next"))
    joined = _joined(staged, carry, [*keys, b])
    return joined.withColumn(out, F.coalesce("_rs_local_b", "_rs_next")).drop(b, "_rs_local_b", "_rs_next")
