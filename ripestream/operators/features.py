"""Model-feature preparation.

The chain follows the reference's order: drop unlabelled rows, mask
saturated TVOC, drop rows missing the required sensor, impute per batch then
globally, difference within batch, split by batch, min-max scale.  Per-batch
statistics are grouped aggregates joined back; global statistics are scalar
subqueries (one row, no driver round trip).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripestream.operators import sequence as seq


def mask_saturated(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """``col >= threshold`` -> NULL (B2); NULL stays NULL."""
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c) < threshold, F.col(c)))
    return df


def saturation_counts(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """Per column: saturated rows and % of all rows (B3), one pass, long output."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.count_if(F.col(c) >= threshold).alias(c) for c in cols])
    longf = wide.unpivot("_n", list(cols), "feature", "n_saturated")
    return longf.select("feature", F.col("n_saturated").cast("long").alias("n_saturated"),
                        F.round(100 * F.col("n_saturated") / F.col("_n"), 6).alias("pct"))


def _long_medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str) -> DataFrame:
    """Exact medians of several columns per key through one two-pass pipeline: (keys, prefix+col...)."""
    from ripestream.operators.stats import exact_quantiles

    arr = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_val")) for c in cols])
    long = df.select(*keys, F.inline(arr))
    q = exact_quantiles(long, [*keys, "_col"], "_val", [0.5], "_q")
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("_col") == c, F.col("_q")[0])).alias(prefix + c) for c in cols])


def impute_median(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per-key median fill, then a global-median fallback computed on the filled column.

    Adds ``n_batch_imputed``-style flags per column: ``<col>_src`` in
    {'raw', 'batch', 'global', NULL}.
    """
    from ripestream.plans.common import write_table

    df = write_table(df, "impute_rows")  # read three times below, after what may be a long chain
    # all columns stacked long: one exact-median pipeline over (key, column)
    filled = df.join(_long_medians(df, [key], cols, "_bm_"), key, "left")
    for c in cols:
        filled = (filled.withColumn(f"{c}_src", F.when(F.col(c).isNotNull(), "raw")
                                    .when(F.col(f"_bm_{c}").isNotNull(), "batch"))
                  .withColumn(c, F.coalesce(F.col(c), F.col(f"_bm_{c}"))))
    filled = filled.drop(*[f"_bm_{c}" for c in cols])
    # Materialise the batch fill (short lineage), then one long pipeline for
    # every global median, read through a scalar subquery (one row).
    filled = write_table(filled, "batch_filled")
    g = _long_medians(filled.withColumn("_g", F.lit(0)), ["_g"], cols, "").select(F.struct(*cols)).scalar()
    for c in cols:
        gc = g.getField(c)
        filled = (filled.withColumn(f"{c}_src", F.when(F.col(f"{c}_src").isNull() & gc.isNotNull(), "global")
                                    .otherwise(F.col(f"{c}_src")))
                  .withColumn(c, F.coalesce(F.col(c), gc)))
    return filled


def impute_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: raw / batch / global / residual-NULL counts."""
    aggs = []
    for c in cols:
        aggs.append(F.struct(
            F.lit(c).alias("feature"),
            F.count_if(F.col(f"{c}_src") == "raw").alias("n_raw"),
            F.count_if(F.col(f"{c}_src") == "batch").alias("n_batch"),
            F.count_if(F.col(f"{c}_src") == "global").alias("n_global"),
            F.count_if(F.col(c).isNull()).alias("n_residual"),
        ))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def within_key_delta(df: DataFrame, key: str, order: Sequence[str], cols: dict[str, str],
                     width: Column | int | None = None) -> DataFrame:
    """``out = coalesce(x - lag(x), 0)`` per key in ``order`` (F3: first row 0)."""
    lagged = seq.lag_values(df, key, list(order), {f"_prev_{o}": s for o, s in cols.items()}, width=width)
    for o, s in cols.items():
        lagged = lagged.withColumn(o, F.coalesce(F.col(s) - F.col(f"_prev_{o}"), F.lit(0.0)))
    return lagged.drop(*[f"_prev_{o}" for o in cols], "_pos")


def serving_delta(df: DataFrame, key: str, order: Sequence[str], cols: dict[str, str], complete: Column,
                  width: Column | int | None = None) -> DataFrame:
    """Serving-time delta (F5): the previous value only advances on complete cycles.

    Incomplete cycles get NULL deltas; the first complete cycle is compared
    with 0 (the device's initial state), not with itself.
    """
    comp = df.where(complete)
    lagged = seq.lag_values(comp, key, list(order), {f"_prev_{o}": s for o, s in cols.items()}, width=width)
    for o, s in cols.items():
        lagged = lagged.withColumn(o, F.col(s) - F.coalesce(F.col(f"_prev_{o}"), F.lit(0.0)))
    lagged = lagged.drop(*[f"_prev_{o}" for o in cols], "_pos")
    rest = df.where(~complete | complete.isNull())
    for o in cols:
        rest = rest.withColumn(o, F.lit(None).cast("double"))
    return lagged.unionByName(rest)


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per feature: (feature, min, max, range) with range 0 -> 1."""
    wide = df.agg(*[F.struct(F.lit(c).alias("feature"), F.min(c).alias("min"), F.max(c).alias("max"))
                    for c in cols])
    longf = wide.select(F.inline(F.array(*[F.col(f"`{c}`") for c in wide.columns])))
    rng = F.col("max") - F.col("min")
    return longf.withColumn("range", F.when(rng == 0, F.lit(1.0)).otherwise(rng))


def minmax_scale(x: Column, lo: Column, rng: Column) -> Column:
    """``clip((x - lo) / range, 0, 1)`` (C5); NULL in -> NULL out."""
    v = (x - lo) / rng
    return F.when(v.isNull(), F.lit(None).cast("double")).when(v < 0, 0.0).when(v > 1, 1.0).otherwise(v)


def fit_minmax_struct(df: DataFrame, cols: Sequence[str]) -> Column:
    """Scalar subquery: struct of ``<c>_min`` and ``<c>_range`` for every column."""
    fields = []
    for c in cols:
        rng = F.max(c) - F.min(c)
        fields += [F.min(c).alias(f"{c}_min"), F.when(rng == 0, F.lit(1.0)).otherwise(rng).alias(f"{c}_range")]
    return df.agg(F.struct(*fields)).scalar()


def apply_minmax(df: DataFrame, cols: Sequence[str], params: Column, suffix: str = "_norm") -> DataFrame:
    """Scale ``cols`` with a fitted params struct (see :func:`fit_minmax_struct`)."""
    return df.select("*", *[minmax_scale(F.col(c), params.getField(f"{c}_min"), params.getField(f"{c}_range"))
                            .alias(c + suffix) for c in cols])


def assign_split(batch: Column, train: Sequence[int], held: Sequence[int], test: Sequence[int]) -> Column:
    """Split by batch membership (B8); other batches -> NULL (excluded)."""
    return (F.when(batch.isin(list(train)), "train").when(batch.isin(list(held)), "held")
            .when(batch.isin(list(test)), "test"))
