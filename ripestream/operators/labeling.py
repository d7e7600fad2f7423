"""Freshness labelling of the optical feed.

Per batch: flag lighting artefacts (clear channel spikes), smooth NIR with a
centred 7-row mean that skips flagged rows, derive range tertiles and a
direction from the smoothed series, assign zones, null the flagged rows' labels
and forward-fill.  All per-batch statistics are grouped aggregates joined back
(AQE broadcasts them when the per-batch table is small); ordered steps go
through :mod:`ripestream.operators.sequence` so a hot batch is still split
over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripestream.functions.zones import zone_for
from ripestream.operators import sequence as seq

# Fixed values of the labelling rules.
LIGHTING_FACTOR = 1.6
SMOOTH_WINDOW = 7
MIN_ZONE_POINTS = 4
EDGE_POINTS = 3


def lighting_flags(
    spec: DataFrame, key: str = "batch", clear: str = "clear", factor: float = LIGHTING_FACTOR,
) -> DataFrame:
    """Add ``clear_median`` and ``lit`` (B1).

    ``lit`` = clear > factor × per-batch median(clear), strict; a median of 0
    flags nothing; a NULL clear is not flagged.
    """
    from ripestream.operators.stats import exact_median

    out = spec.join(exact_median(spec, [key], clear, "clear_median"), key, "left")
    flag = F.when(F.col("clear_median") == 0, F.lit(False)).otherwise(F.col(clear) > F.lit(factor) * F.col("clear_median"))
    return out.withColumn("lit", F.coalesce(flag, F.lit(False)))


def smooth(
    spec: DataFrame,
    key: str = "batch",
    order: Sequence[str] = ("ts", "id"),
    value: str = "nir",
    flag: str = "lit",
    out: str = "nir_smooth",
    window: int = SMOOTH_WINDOW,
    width: Column | int | None = None,
    pos: str | None = None,
) -> DataFrame:
    """Centred rolling mean over ``window`` rows, min 1 non-null (F1).

    Flagged rows contribute NULL but still occupy a slot.  Adds ``pos`` (row
    position in the batch) unless one is given.
    """
    half = window // 2
    clean = F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col(value))
    df = spec.withColumn("_rs_clean", clean)
    if pos is None:
        df = seq.with_position(df, key, list(order), "pos", width=width)
        pos = "pos"
    return seq.rolling(df, key, pos, {out: lambda w: F.avg("_rs_clean").over(w.rowsBetween(-half, half))}, half, half).drop("_rs_clean")


def range_zones(
    smoothed: DataFrame,
    key: str | None = "batch",
    order: Sequence[str] = ("ts", "id"),
    value: str = "nir_smooth",
) -> DataFrame:
    """Range tertiles with direction, one row per key, or one row for all without a key.

    Over the non-NULL values in order: fewer than 4 -> no zones; direction +1
    iff mean(last 3) > mean(first 3), else -1; lo = min, hi = max; hi = lo ->
    no zones; b1 = lo + span/3, b2 = lo + 2·span/3.  Columns:
    (key, n_valid, direction, lo, hi, b1, b2, span) with NULL zone columns when
    there are no zones.
    """
    keys = [key] if key else []
    valid = smoothed.where(F.col(value).isNotNull()).select(*keys, *order, value)

    def edge(desc: bool, name: str) -> DataFrame:
        # Spark keeps the first rows of a key before it deals them: three a task, not the key's rows
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() if desc else F.col(c) for c in order])
        return (valid.withColumn("_rs_p", F.row_number().over(w)).where(F.col("_rs_p") <= EDGE_POINTS)
                .groupBy(*keys).agg(F.avg(value).alias(name)))

    stats = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_valid"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    if keys:
        stats = stats.join(edge(False, "first3"), key).join(edge(True, "last3"), key)
    else:
        stats = stats.select("*", edge(False, "first3").scalar().alias("first3"), edge(True, "last3").scalar().alias("last3"))
    ok = (F.col("n_valid") >= MIN_ZONE_POINTS) & (F.col("hi") > F.col("lo"))
    span = F.col("hi") - F.col("lo")
    return stats.select(
        *keys,
        "n_valid",
        F.when(ok, F.when(F.col("last3") > F.col("first3"), F.lit(1)).otherwise(F.lit(-1))).alias("direction"),
        "lo",
        "hi",
        F.when(ok, F.col("lo") + span / 3).alias("b1"),
        F.when(ok, F.col("lo") + 2 * span / 3).alias("b2"),
        F.when(ok, span).alias("span"),
    )


def quantile_zones(df: DataFrame, key: str = "batch", value: str = "nir") -> DataFrame:
    """Equal-frequency tertiles (E3): q1 = 1/3, q2 = 2/3 quantile (linear)."""
    from ripestream.operators.stats import quantiles

    q = quantiles(df, [key], value, [1.0 / 3, 2.0 / 3], "_q")
    return q.select(key, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q2"))


def quantile_zone_for(value: Column, q1: Column, q2: Column) -> Column:
    """``<= q1`` Fresh, ``<= q2`` Aging, else Degraded; NULL in -> NULL."""
    return (
        F.when(value.isNull() | q1.isNull(), F.lit(None).cast("string"))
        .when(value <= q1, "Fresh")
        .when(value <= q2, "Aging")
        .otherwise("Degraded")
    )


def label_spectral(
    spec: DataFrame,
    key: str = "batch",
    order: Sequence[str] = ("ts", "id"),
    zones: DataFrame | None = None,
    falling: str = "reference",
    width: Column | int | None = None,
    signal: str = "nir",
) -> DataFrame:
    """Full optical labelling (B1 -> F1 -> E2 -> C6 -> F2).

    Returns the spectral rows with ``lit``, ``nir_smooth``, ``raw_label`` and the
    forward-filled ``nir_label``, plus the zone columns.  ``zones`` may be a
    frozen one-row table (global zones, E4) — then its single row is applied
    to every batch.
    """
    from ripestream.plans.common import write_table

    # positions, zones (three passes) and labels read them: written once each
    flagged = write_table(lighting_flags(spec, key), "flagged")
    smoothed = write_table(smooth(flagged, key, order, value=signal, width=width), "smoothed")
    if zones is None:
        z = range_zones(smoothed, key, order)
        labelled = smoothed.join(z.select(key, "direction", "b1", "b2"), key, "left")
    else:
        # Frozen zones: one row, read through a scalar subquery (no join; it fails on a table of several rows).
        z = zones.select(F.struct("direction", "b1", "b2").alias("z")).scalar()
        labelled = smoothed.select("*", z.getField("direction").alias("direction"), z.getField("b1").alias("b1"),
                                   z.getField("b2").alias("b2"))
    raw = zone_for(F.col("nir_smooth"), F.col("direction"), F.col("b1"), F.col("b2"), falling)
    labelled = labelled.withColumn("raw_label", F.when(~F.col("lit"), raw))
    return seq.ffill(labelled, key, list(order), "raw_label", "nir_label", width=width)


def global_zones(spec: DataFrame, train_keys: DataFrame, key: str = "batch", order: Sequence[str] = ("ts", "id"),
                 width: Column | int | None = None) -> DataFrame:
    """Pooled zones from training batches (E4): smoothed nir/clear, one row.

    The ratio nir / clear (clear 0 -> NULL) is smoothed per batch, the non-NULL
    values of all training batches are pooled in (batch, time) order and E2 is
    applied to the pool.  ``train_keys`` is a one-column table of batch ids.
    """
    from ripestream.plans.common import write_table

    s = spec.join(train_keys, key, "left_semi")
    s = write_table(lighting_flags(s, key).withColumn("ratio", F.col("nir") / F.nullif(F.col("clear"), F.lit(0))), "flagged")
    sm = write_table(smooth(s, key, order, value="ratio", out="ratio_smooth", width=width).select(key, *order, "ratio_smooth"), "smoothed")
    return range_zones(sm, None, [key, *order], value="ratio_smooth")
