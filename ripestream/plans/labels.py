"""Label derivation queries: freshness labels, zones, flags, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripestream.functions.clock import wall_micros
from ripestream.operators import asof, labeling
from ripestream.plans.common import bucket_width, staged, write_table
from ripestream.plans.registry import register, with_ctes
from ripestream.sources import proxy

# ---------------------------------------------------------------- SQL pieces
SQL_FLAGGED = """med AS (SELECT batch, median(clear) AS clear_median FROM spectral GROUP BY batch),
flagged AS (
  SELECT s.*, m.clear_median,
         COALESCE(CASE WHEN m.clear_median = 0 THEN FALSE ELSE s.clear > 1.6 * m.clear_median END, FALSE) AS lit
  FROM spectral s LEFT JOIN med m USING (batch))"""

SQL_SMOOTH = """smooth AS (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ts, id) AS pos,
         avg(CASE WHEN NOT lit THEN nir END) OVER (PARTITION BY batch ORDER BY ts, id
             ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS nir_smooth
  FROM flagged)"""

SQL_ZONES = """ranked AS (
  SELECT batch, nir_smooth,
         row_number() OVER (PARTITION BY batch ORDER BY ts, id) AS ra,
         row_number() OVER (PARTITION BY batch ORDER BY ts DESC, id DESC) AS rd
  FROM smooth WHERE nir_smooth IS NOT NULL),
zstat AS (
  SELECT batch, count(*) AS n_valid, min(nir_smooth) AS lo, max(nir_smooth) AS hi,
         avg(CASE WHEN ra <= 3 THEN nir_smooth END) AS first3,
         avg(CASE WHEN rd <= 3 THEN nir_smooth END) AS last3
  FROM ranked GROUP BY batch),
zones AS (
  SELECT batch, n_valid,
         CASE WHEN n_valid >= 4 AND hi > lo THEN CASE WHEN last3 > first3 THEN 1 ELSE -1 END END AS direction,
         lo, hi,
         CASE WHEN n_valid >= 4 AND hi > lo THEN lo + (hi - lo) / 3 END AS b1,
         CASE WHEN n_valid >= 4 AND hi > lo THEN lo + 2 * (hi - lo) / 3 END AS b2,
         CASE WHEN n_valid >= 4 AND hi > lo THEN hi - lo END AS span
  FROM zstat)"""

SQL_LABELLED = """labelled AS (
  SELECT s.*, z.direction, z.b1, z.b2,
         CASE WHEN s.lit OR z.direction IS NULL OR s.nir_smooth IS NULL THEN NULL
              WHEN z.direction > 0 THEN CASE WHEN s.nir_smooth < z.b1 THEN 'Fresh'
                                             WHEN s.nir_smooth < z.b2 THEN 'Aging' ELSE 'Degraded' END
              ELSE CASE WHEN s.nir_smooth > z.b1 THEN 'Fresh'
                        WHEN s.nir_smooth > z.b2 THEN 'Aging' ELSE 'Degraded' END END AS raw_label
  FROM smooth s LEFT JOIN zones z USING (batch)),
filled AS (
  SELECT *, last_value(raw_label IGNORE NULLS) OVER (PARTITION BY batch ORDER BY ts, id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nir_label
  FROM labelled)"""

SQL_SENSOR_LABELS = """sensor_labels AS (
  SELECT s.batch, s.id, s.ts, s.event_type, s.value, m.nir_label
  FROM sensor s ASOF LEFT JOIN filled m ON s.batch = m.batch AND s.ts >= m.ts)"""

LABEL_CTES = (proxy.SQL_SPECTRAL, proxy.SQL_SENSOR, SQL_FLAGGED, SQL_SMOOTH, SQL_ZONES, SQL_LABELLED, SQL_SENSOR_LABELS)


# ------------------------------------------------------------ Spark builders
def labelled_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled optical feed, materialised once (it feeds several as-of joins)."""
    feed = proxy.spectral_feed(proxy.table(spark, sf_dir, "events"))
    return staged(spark, sf_dir, "labelled_spectral", lambda: labeling.label_spectral(feed, width=bucket_width(spark, sf_dir)))


def sensor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = labelled_spectral(spark, sf_dir)
    events = proxy.table(spark, sf_dir, "events")
    return asof.asof_backward(proxy.sensor_feed(events), spec, "batch", "ts", ["nir_label"], width=bucket_width(spark, sf_dir))


@register("freshness_labels", "A1 A2 B1 F1 E2 C6 F2 D1 D3 D5 G5 K1",
          with_ctes(*LABEL_CTES) + "SELECT batch, id, ts, event_type, value, nir_label FROM sensor_labels")
def freshness_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sensor row with the freshness zone in force at its time."""
    return sensor_labels(spark, sf_dir).select("batch", "id", "ts", "event_type", "value", "nir_label")


# ------------------------------------------------------------------ E5 / E6
SQL_CLASSES = "classes AS (SELECT * FROM (VALUES ('Fresh'), ('Aging'), ('Degraded')) t(nir_label))"


@register("label_counts", "E5",
          with_ctes(*LABEL_CTES, SQL_CLASSES) + """
, tot AS (SELECT batch, count(nir_label) AS n_labelled FROM sensor_labels GROUP BY batch),
cnt AS (SELECT batch, nir_label, count(*) AS n FROM sensor_labels WHERE nir_label IS NOT NULL GROUP BY 1, 2)
SELECT t.batch, c.nir_label, COALESCE(n.n, 0) AS n,
       round(100 * COALESCE(n.n, 0) / NULLIF(t.n_labelled, 0), 6) AS pct
FROM tot t CROSS JOIN classes c LEFT JOIN cnt n ON n.batch = t.batch AND n.nir_label = c.nir_label""")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class balance per batch, zero classes kept (count and % of labelled rows)."""
    from ripestream.operators.stats import class_balance

    return class_balance(sensor_labels(spark, sf_dir), "batch", "nir_label")


@register("batch_overview", "E6 C3",
          with_ctes(*LABEL_CTES) + """
, s AS (SELECT batch, count(*) AS n_rows, count(nir_label) AS n_labelled,
              round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS duration_h,
              count(*) FILTER (WHERE nir_label = 'Fresh') AS n_fresh,
              count(*) FILTER (WHERE nir_label = 'Aging') AS n_aging,
              count(*) FILTER (WHERE nir_label = 'Degraded') AS n_degraded
       FROM sensor_labels GROUP BY batch),
o AS (SELECT batch, count(*) AS n_spectral, count(*) FILTER (WHERE lit) AS n_lighting FROM flagged GROUP BY batch)
SELECT COALESCE(s.batch, o.batch) AS batch, COALESCE(n_rows, 0) AS n_rows, COALESCE(n_labelled, 0) AS n_labelled,
       duration_h, COALESCE(n_spectral, 0) AS n_spectral, COALESCE(n_lighting, 0) AS n_lighting,
       COALESCE(n_fresh, 0) AS n_fresh, COALESCE(n_aging, 0) AS n_aging, COALESCE(n_degraded, 0) AS n_degraded
FROM s FULL OUTER JOIN o ON s.batch = o.batch""")
def batch_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch: sensor rows, labelled rows, duration, optical rows, lighting events, class counts."""
    events = proxy.table(spark, sf_dir, "events")
    spec = labeling.lighting_flags(proxy.spectral_feed(events))
    lab = sensor_labels(spark, sf_dir)
    micros = wall_micros(F.col("ts"))
    s = lab.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("nir_label").alias("n_labelled"),
        F.round((F.max(micros) - F.min(micros)) / 3.6e9, 6).alias("duration_h"),
        *[F.count_if(F.col("nir_label") == c).alias(f"n_{c.lower()}") for c in ("Fresh", "Aging", "Degraded")],
    )
    o = spec.groupBy("batch").agg(F.count(F.lit(1)).alias("n_spectral"), F.count_if("lit").alias("n_lighting"))
    j = s.join(o, "batch", "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select("batch", z("n_rows"), z("n_labelled"), "duration_h", z("n_spectral"), z("n_lighting"),
                    z("n_fresh"), z("n_aging"), z("n_degraded"))


# ------------------------------------------------------- B1 F1 E2 E3 E4 E30
@register("lighting_flags", "B1 C7 E1",
          with_ctes(proxy.SQL_SPECTRAL, SQL_FLAGGED) + """
SELECT batch, id, ts, clear, clear_median, lit, nir / NULLIF(clear, 0) AS nir_ratio FROM flagged""")
def lighting_flags_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = proxy.spectral_feed(proxy.table(spark, sf_dir, "events"))
    f = labeling.lighting_flags(spec)
    return f.select("batch", "id", "ts", "clear", "clear_median", "lit",
                    (F.col("nir") / F.nullif(F.col("clear"), F.lit(0))).alias("nir_ratio"))


@register("nir_smoothed", "F1 G1",
          with_ctes(proxy.SQL_SPECTRAL, SQL_FLAGGED, SQL_SMOOTH) + """
SELECT batch, id, ts, nir, lit, pos, round(nir_smooth, 6) AS nir_smooth FROM smooth""")
def nir_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = proxy.spectral_feed(proxy.table(spark, sf_dir, "events"))
    s = labeling.smooth(labeling.lighting_flags(spec), width=bucket_width(spark, sf_dir))
    return s.select("batch", "id", "ts", "nir", "lit", F.col("pos").cast("long").alias("pos"),
                    F.round("nir_smooth", 6).alias("nir_smooth"))


@register("nir_zones", "E2 E30 F4 G2",
          with_ctes(proxy.SQL_SPECTRAL, SQL_FLAGGED, SQL_SMOOTH, SQL_ZONES) + """
, lit_n AS (SELECT batch, count(*) AS n_spectral, count(*) FILTER (WHERE lit) AS n_lighting FROM flagged GROUP BY batch)
SELECT l.batch, l.n_spectral, l.n_lighting, COALESCE(z.n_valid, 0) AS n_valid,
       COALESCE(z.direction, -1) AS direction_shown, z.direction,
       round(z.lo, 6) AS lo, round(z.hi, 6) AS hi, round(z.b1, 6) AS b1, round(z.b2, 6) AS b2,
       round(z.span, 6) AS span
FROM lit_n l LEFT JOIN zones z USING (batch)""")
def nir_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone-boundary summary per batch; a batch without zones shows falling (-1) and NULL bounds."""
    spec = proxy.spectral_feed(proxy.table(spark, sf_dir, "events"))
    f = write_table(labeling.lighting_flags(spec), "flagged")
    z = labeling.range_zones(write_table(labeling.smooth(f, width=bucket_width(spark, sf_dir)), "smoothed"))
    n = f.groupBy("batch").agg(F.count(F.lit(1)).alias("n_spectral"), F.count_if("lit").alias("n_lighting"))
    r = lambda c: F.round(c, 6).alias(c)
    return n.join(z, "batch", "left").select(
        "batch", "n_spectral", "n_lighting", F.coalesce("n_valid", F.lit(0)).cast("long").alias("n_valid"),
        F.coalesce("direction", F.lit(-1)).alias("direction_shown"), "direction",
        r("lo"), r("hi"), r("b1"), r("b2"), r("span"))


@register("zone_quantile", "E3",
          with_ctes(proxy.SQL_SPECTRAL) + """
, q AS (SELECT batch, quantile_cont(nir, 1.0/3) AS q1, quantile_cont(nir, 2.0/3) AS q2 FROM spectral GROUP BY batch)
SELECT s.batch, s.id, round(q.q1, 6) AS q1, round(q.q2, 6) AS q2,
       CASE WHEN s.nir <= q.q1 THEN 'Fresh' WHEN s.nir <= q.q2 THEN 'Aging' ELSE 'Degraded' END AS q_label
FROM spectral s JOIN q USING (batch)""")
def zone_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-frequency tertile labels of raw NIR per batch."""
    spec = proxy.spectral_feed(proxy.table(spark, sf_dir, "events"))
    q = labeling.quantile_zones(spec)
    j = spec.join(q, "batch")
    return j.select("batch", "id", F.round("q1", 6).alias("q1"), F.round("q2", 6).alias("q2"),
                    labeling.quantile_zone_for(F.col("nir"), F.col("q1"), F.col("q2")).alias("q_label"))


SQL_TRAIN_KEYS = "train_keys AS (SELECT DISTINCT user_id AS batch FROM events WHERE user_id % 4 IN (1, 3))"


@register("zone_global", "E4 D8",
          with_ctes(proxy.SQL_SPECTRAL, SQL_TRAIN_KEYS) + """
, tr AS (SELECT * FROM spectral WHERE batch IN (SELECT batch FROM train_keys)),
med AS (SELECT batch, median(clear) AS m FROM tr GROUP BY batch),
fl AS (SELECT tr.*, COALESCE(CASE WHEN m = 0 THEN FALSE ELSE clear > 1.6 * m END, FALSE) AS lit
       FROM tr JOIN med USING (batch)),
sm AS (SELECT batch, ts, id, avg(CASE WHEN NOT lit THEN nir / NULLIF(clear, 0) END)
          OVER (PARTITION BY batch ORDER BY ts, id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM fl),
rk AS (SELECT v, row_number() OVER (ORDER BY batch, ts, id) AS ra,
              row_number() OVER (ORDER BY batch DESC, ts DESC, id DESC) AS rd FROM sm WHERE v IS NOT NULL),
st AS (SELECT count(*) AS n_valid, min(v) AS lo, max(v) AS hi, avg(CASE WHEN ra <= 3 THEN v END) AS f3,
              avg(CASE WHEN rd <= 3 THEN v END) AS l3 FROM rk)
SELECT n_valid, CASE WHEN n_valid >= 4 AND hi > lo THEN CASE WHEN l3 > f3 THEN 1 ELSE -1 END END AS direction,
       round(lo, 6) AS lo, round(hi, 6) AS hi,
       round(CASE WHEN n_valid >= 4 AND hi > lo THEN lo + (hi - lo) / 3 END, 6) AS b1,
       round(CASE WHEN n_valid >= 4 AND hi > lo THEN lo + 2 * (hi - lo) / 3 END, 6) AS b2
FROM st""")
def zone_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled zones of smoothed nir/clear over the training batches (split := user_id % 4 in 1, 3)."""
    events = proxy.table(spark, sf_dir, "events")
    spec = proxy.spectral_feed(events)
    train = events.where((F.col("user_id") % 4).isin(1, 3)).select(F.col("user_id").alias("batch")).distinct()
    z = labeling.global_zones(spec, train, width=bucket_width(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return z.select("n_valid", "direction", r("lo"), r("hi"), r("b1"), r("b2"))


# ---------------------------------------------------------------------- F9
@register("label_segments", "F9",
          with_ctes(*LABEL_CTES) + """
, chg AS (SELECT *, CASE WHEN nir_label IS NOT DISTINCT FROM lag(nir_label) OVER (PARTITION BY batch ORDER BY ts, id)
                         AND row_number() OVER (PARTITION BY batch ORDER BY ts, id) > 1 THEN 0 ELSE 1 END AS c
          FROM sensor_labels),
seg AS (SELECT *, sum(c) OVER (PARTITION BY batch ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment
        FROM chg)
SELECT batch, CAST(segment AS BIGINT) AS segment, any_value(nir_label) AS nir_label,
       min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows
FROM seg GROUP BY batch, segment""")
def label_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous runs of one label per batch (gaps and islands), for shading."""
    from ripestream.operators.timeseries import segments

    return segments(sensor_labels(spark, sf_dir), "batch", ["ts", "id"], "nir_label", "ts",
                    width=bucket_width(spark, sf_dir))


@register("clean_view", "B9",
          with_ctes(proxy.SQL_SPECTRAL, SQL_FLAGGED) + """
SELECT batch, id, CASE WHEN NOT lit THEN nir END AS nir_clean, CASE WHEN lit THEN nir END AS nir_flagged FROM flagged""")
def clean_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean-only NIR series and its complement (the lighting-flagged readings)."""
    f = labeling.lighting_flags(proxy.spectral_feed(proxy.table(spark, sf_dir, "events")))
    return f.select("batch", "id", F.when(~F.col("lit"), F.col("nir")).alias("nir_clean"),
                    F.when(F.col("lit"), F.col("nir")).alias("nir_flagged"))


@register("global_zone_labels", "E4 C6 F2 Q5",
          with_ctes(proxy.SQL_SPECTRAL, SQL_TRAIN_KEYS) + """
, med AS (SELECT batch, median(clear) AS m FROM spectral GROUP BY batch),
fl AS (SELECT s.*, COALESCE(CASE WHEN m = 0 THEN FALSE ELSE clear > 1.6 * m END, FALSE) AS lit
       FROM spectral s JOIN med USING (batch)),
sm AS (SELECT batch, ts, id, lit, avg(CASE WHEN NOT lit THEN nir / NULLIF(clear, 0) END)
          OVER (PARTITION BY batch ORDER BY ts, id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM fl),
rk AS (SELECT v, row_number() OVER (ORDER BY batch, ts, id) AS ra,
              row_number() OVER (ORDER BY batch DESC, ts DESC, id DESC) AS rd
       FROM sm WHERE v IS NOT NULL AND batch IN (SELECT batch FROM train_keys)),
st AS (SELECT count(*) AS n_valid, min(v) AS lo, max(v) AS hi, avg(CASE WHEN ra <= 3 THEN v END) AS f3,
              avg(CASE WHEN rd <= 3 THEN v END) AS l3 FROM rk),
z AS (SELECT CASE WHEN n_valid >= 4 AND hi > lo THEN CASE WHEN l3 > f3 THEN 1 ELSE -1 END END AS direction,
             CASE WHEN n_valid >= 4 AND hi > lo THEN lo + (hi - lo) / 3 END AS b1,
             CASE WHEN n_valid >= 4 AND hi > lo THEN lo + 2 * (hi - lo) / 3 END AS b2 FROM st),
lb AS (SELECT sm.*, CASE WHEN lit OR direction IS NULL OR v IS NULL THEN NULL
                         WHEN direction > 0 THEN CASE WHEN v < b1 THEN 'Fresh' WHEN v < b2 THEN 'Aging' ELSE 'Degraded' END
                         ELSE CASE WHEN v > b1 THEN 'Fresh' WHEN v > b2 THEN 'Aging' ELSE 'Degraded' END END AS raw_label
       FROM sm, z),
ff AS (SELECT *, last_value(raw_label IGNORE NULLS) OVER (PARTITION BY batch ORDER BY ts, id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nir_label FROM lb)
SELECT batch, nir_label, count(*) AS n FROM ff GROUP BY ALL""")
def global_zone_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones pooled from the training batches (smoothed nir/clear), frozen and applied to every batch's
    smoothed nir/clear: one signal for fit and apply (decision Q5).  Label counts per batch."""
    events = proxy.table(spark, sf_dir, "events")
    spec = proxy.spectral_feed(events)
    train = events.where((F.col("user_id") % 4).isin(1, 3)).select(F.col("user_id").alias("batch")).distinct()
    width = bucket_width(spark, sf_dir)
    z = labeling.global_zones(spec, train, width=width)
    ratio = spec.withColumn("ratio", F.col("nir") / F.nullif(F.col("clear"), F.lit(0)))
    lab = labeling.label_spectral(ratio, zones=z, width=width, signal="ratio")
    return lab.groupBy("batch", "nir_label").agg(F.count(F.lit(1)).alias("n"))
