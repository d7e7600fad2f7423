"""Data-quality operators.

The dashboard-only statistics (E24-E27) have no code in the reference; their
formulas are ours and are stated in each docstring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripestream.functions.clock import wall_micros
from ripestream.operators import sequence as seq


def seconds_between(a: Column, b: Column) -> Column:
    """(a - b) in seconds as double, for NTZ or LTZ timestamps."""
    return (wall_micros(a) - wall_micros(b)) / 1e6


def hours_between(a: Column, b: Column) -> Column:
    """(a - b) in hours: microsecond difference / 3.6e9 (one rounding step)."""
    return (wall_micros(a) - wall_micros(b)) / 3.6e9


def quality_matrix(df: DataFrame, key: str, cols: Sequence[str], sat_cols: Sequence[str], threshold: float) -> DataFrame:
    """Missing % and saturation % per key × column in one aggregate.

    NULL counts as not saturated; columns without a saturation rule get NULL.
    """
    n = F.count(F.lit(1))
    structs = []
    for c in cols:
        sat = (100 * F.count_if(F.col(c) >= threshold) / n) if c in sat_cols else F.lit(None).cast("double")
        structs.append(F.struct(F.lit(c).alias("feature"),
                                F.round(100 * F.count_if(F.col(c).isNull()) / n, 6).alias("missing_pct"),
                                F.round(sat, 6).alias("saturated_pct")))
    return df.groupBy(key).agg(F.array(*structs).alias("_a")).select(key, F.inline("_a"))


def saturation_split(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """``<c>_valid`` (< threshold) and ``<c>_saturated`` (>= threshold) series."""
    out = df
    for c in cols:
        out = out.withColumn(f"{c}_valid", F.when(F.col(c) < threshold, F.col(c))).withColumn(
            f"{c}_saturated", F.when(F.col(c) >= threshold, F.col(c)))
    return out


def dropout_flags(df: DataFrame, tvoc_cols: Sequence[str]) -> DataFrame:
    """Gas dropout (B16): TVOC exactly 0 on more than one node in the same row; kept, flagged."""
    zeros = sum((F.coalesce(F.col(c) == 0, F.lit(False)).cast("int") for c in tvoc_cols), F.lit(0))
    missing = sum((F.col(c).isNull().cast("int") for c in tvoc_cols), F.lit(0))
    return df.withColumn("n_zero_tvoc", zeros).withColumn("n_missing_tvoc", missing).withColumn(
        "dropout", F.col("n_zero_tvoc") > 1)


def gaps(df: DataFrame, key: str, order: Sequence[str], ts: str, width: Column | int | None = None) -> DataFrame:
    """Adds ``gap_us`` (exact microseconds) and ``gap_min`` (minutes) since the key's previous reading."""
    lagged = seq.lag_values(df, key, list(order), {"_prev_ts": ts}, width=width)
    gap = (wall_micros(F.col(ts)) - wall_micros(F.col("_prev_ts"))) / 6e7
    gap_us = wall_micros(F.col(ts)) - wall_micros(F.col("_prev_ts"))
    return lagged.withColumn("gap_us", gap_us).withColumn("gap_min", gap).drop("_prev_ts", "_pos")


def micro_minutes(us: Column) -> Column:
    """Microseconds -> minutes to the nearest 1e-6 min (ties up) with exact integer-valued arithmetic."""
    return F.floor((2 * us + 60) / 120) / 1e6


def _median_by(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    from ripestream.operators.stats import quantiles

    return quantiles(df, list(keys), col, [0.5], "_q").select(*keys, F.col("_q")[0].alias(out))


def interval_stats(with_gaps: DataFrame, key: str, tolerance: float = 0.10) -> DataFrame:
    """Sampling consistency (E24, ours): gaps, median gap, share within ±tolerance of the median."""
    from ripestream.plans.common import write_table

    with_gaps = write_table(with_gaps.select(key, "gap_us"), "gaps")  # read three times, after positions and lags
    med = _median_by(with_gaps, [key], "gap_us", "_med_us")
    j = with_gaps.join(med, key)
    within = F.abs(F.col("gap_us") - F.col("_med_us")) <= tolerance * F.col("_med_us")
    return j.groupBy(key).agg(
        F.count("gap_us").alias("n_gaps"),
        micro_minutes(F.first("_med_us")).alias("median_gap_min"),
        micro_minutes(F.max("gap_us")).alias("max_gap_min"),
        F.round(F.count_if(within) / F.nullif(F.count("gap_us"), F.lit(0)), 6).alias("share_regular"),
    )


def trend(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str) -> DataFrame:
    """Start -> end change and rate per hour (E23, ours) over non-NULL values."""
    v = df.where(F.col(value).isNotNull())
    o = F.struct(F.col(ts), F.col(tie))
    g = v.groupBy(*keys).agg(
        F.min_by(value, o).alias("start_value"), F.max_by(value, o).alias("end_value"),
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
    hours = hours_between(F.col("end_ts"), F.col("start_ts"))
    return g.select(*keys, F.round("start_value", 6).alias("start_value"), F.round("end_value", 6).alias("end_value"),
                    F.round(F.col("end_value") - F.col("start_value"), 6).alias("change"),
                    F.round(hours, 6).alias("hours"),
                    F.round((F.col("end_value") - F.col("start_value")) / F.nullif(hours, F.lit(0.0)), 6).alias("rate_per_h"))


def reliability(long_df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: Column | int | None = None,
                keep_pct: float = 90.0, caution_pct: float = 60.0, max_spike_pct: float = 5.0) -> DataFrame:
    """Per key: coverage, noise ratio, spikes and a verdict (E25-E27, ours).

    coverage % = non-NULL share; noise ratio = sd(first difference) / sd(series);
    spike = |x - median| > 3 · 1.4826 · MAD; verdict keep if coverage >= keep_pct
    and spike share <= max_spike_pct, caution if coverage >= caution_pct, else drop.
    """
    from ripestream.plans.common import write_table

    keys = list(keys)
    kcol = "_rs_key"
    staged = long_df.withColumn(kcol, F.struct(*keys))
    lagged = seq.lag_values(staged, kcol, list(order), {"_prev": value}, width=width)
    lagged = write_table(lagged.select(*keys, value, (F.col(value) - F.col("_prev")).alias("_diff")), "differences")  # read by both medians
    med = _median_by(lagged, keys, value, "_med")
    j = write_table(lagged.join(med, keys), "centred")
    mad = _median_by(j.withColumn("_dev", F.abs(F.col(value) - F.col("_med"))), keys, "_dev", "_mad")
    j = j.join(mad, keys)
    spike = F.abs(F.col(value) - F.col("_med")) > 3 * 1.4826 * F.col("_mad")
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(100 * F.count(value) / F.count(F.lit(1)), 6).alias("coverage_pct"),
        F.round(F.stddev_samp("_diff") / F.nullif(F.stddev_samp(value), F.lit(0.0)), 6).alias("noise_ratio"),
        F.count_if(spike).alias("n_spikes"),
    )
    spike_pct = 100 * F.col("n_spikes") / F.col("n")
    verdict = (F.when((F.col("coverage_pct") >= keep_pct) & (spike_pct <= max_spike_pct), "keep")
               .when(F.col("coverage_pct") >= caution_pct, "caution").otherwise("drop"))
    return g.withColumn("verdict", verdict)
