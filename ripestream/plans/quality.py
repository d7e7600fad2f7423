"""Data-quality queries over the proxy feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripestream.operators import features as feat
from ripestream.operators import quality as q
from ripestream.plans.common import bucket_width
from ripestream.plans.features import PREP_CTES, RAW, SAT, TVOC, cycle_labels
from ripestream.plans.labels import LABEL_CTES
from ripestream.plans.registry import register, with_ctes
from ripestream.sources import proxy


def cycle_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide -> long by node (H4): (batch, cycle_number, ts, feature, node, quantity, value); NULLs kept."""
    cyc = proxy.cycle_wide(proxy.table(spark, sf_dir, "events"))
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in RAW])
    long = cyc.select("batch", "cycle_number", "ts", F.inline(arr))
    return long.select("batch", "cycle_number", "ts", "feature",
                       F.regexp_extract("feature", r"^([a-z]+[0-9]*)_(.*)$", 1).alias("node"),
                       F.regexp_extract("feature", r"^([a-z]+[0-9]*)_(.*)$", 2).alias("quantity"), "value")


SQL_LONG = "cycle_long AS (\n" + "\nUNION ALL\n".join(
    f"  SELECT batch, cycle_number, ts, '{c}' AS feature, regexp_extract('{c}', '^([a-z]+[0-9]*)_(.*)$', 1) AS node, "
    f"regexp_extract('{c}', '^([a-z]+[0-9]*)_(.*)$', 2) AS quantity, {c} AS value FROM cycle" for c in RAW) + ")"


@register("node_long", "H4 B18", with_ctes(proxy.SQL_CYCLE, SQL_LONG) + "SELECT * FROM cycle_long")
def node_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle_long(spark, sf_dir)


@register("quality_matrix", "E7",
          with_ctes(proxy.SQL_CYCLE) + "\nUNION ALL\n".join(
              f"SELECT batch, '{c}' AS feature, round(100 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS missing_pct, "
              + (f"round(100 * count(*) FILTER (WHERE {c} >= 150) / count(*), 6)" if c in TVOC else "CAST(NULL AS DOUBLE)")
              + f" AS saturated_pct FROM cycle GROUP BY batch" for c in RAW))
def quality_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cyc = proxy.cycle_wide(proxy.table(spark, sf_dir, "events"))
    return q.quality_matrix(cyc, "batch", RAW, TVOC, SAT)


@register("saturation_report", "B2 B3 B5",
          with_ctes(*LABEL_CTES, proxy.SQL_CYCLE,
                    "cycle_labels AS (SELECT c.*, m.nir_label FROM cycle c ASOF LEFT JOIN filled m "
                    "ON c.batch = m.batch AND c.ts >= m.ts)") + "\nUNION ALL\n".join(
              f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} >= 150) AS n_saturated, "
              f"round(100 * count(*) FILTER (WHERE {c} >= 150) / count(*), 6) AS pct FROM cycle_labels WHERE nir_label IS NOT NULL"
              for c in TVOC))
def saturation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturated TVOC readings after the unlabelled rows are dropped: count and %."""
    lab = cycle_labels(spark, sf_dir).where(F.col("nir_label").isNotNull())
    return feat.saturation_counts(lab, TVOC, SAT)


@register("saturation_split", "B10",
          with_ctes(proxy.SQL_CYCLE) + "SELECT batch, cycle_number, " + ", ".join(
              f"CASE WHEN {c} < 150 THEN {c} END AS {c}_valid, CASE WHEN {c} >= 150 THEN {c} END AS {c}_saturated"
              for c in TVOC) + " FROM cycle")
def saturation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cyc = proxy.cycle_wide(proxy.table(spark, sf_dir, "events"))
    s = q.saturation_split(cyc, TVOC, SAT)
    return s.select("batch", "cycle_number", *[f"{c}_{k}" for c in TVOC for k in ("valid", "saturated")])


@register("dropout_flags", "B16 B17",
          with_ctes(proxy.SQL_CYCLE) + """
SELECT batch, cycle_number,
       CAST(COALESCE(node1_tvoc = 0, FALSE) AS INTEGER) + CAST(COALESCE(node2_tvoc = 0, FALSE) AS INTEGER) AS n_zero_tvoc,
       CAST(node1_tvoc IS NULL AS INTEGER) + CAST(node2_tvoc IS NULL AS INTEGER) AS n_missing_tvoc,
       CAST(COALESCE(node1_tvoc = 0, FALSE) AS INTEGER) + CAST(COALESCE(node2_tvoc = 0, FALSE) AS INTEGER) > 1 AS dropout,
       node1_tvoc IS NOT NULL AND node1_mq3_ppm IS NOT NULL AND node2_tvoc IS NOT NULL AND node2_mq3_ppm IS NOT NULL AS complete_row
FROM cycle""")
def dropout_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    cyc = proxy.cycle_wide(proxy.table(spark, sf_dir, "events"))
    d = q.dropout_flags(cyc, TVOC)
    complete = F.lit(True)
    for c in RAW:
        complete = complete & F.col(c).isNotNull()
    return d.select("batch", "cycle_number", "n_zero_tvoc", "n_missing_tvoc", "dropout", complete.alias("complete_row"))


SQL_GAPS = """gaps AS (
  SELECT batch, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY batch ORDER BY ts, id)) AS gap_us FROM {src}),
gm AS (SELECT batch, median(gap_us) AS med_us FROM gaps GROUP BY batch)"""


@register("interval_stats", "E24 F7 E1",
          with_ctes(proxy.SQL_SENSOR, SQL_GAPS.format(src="sensor")) + """
SELECT batch, count(gap_us) AS n_gaps, floor((2 * any_value(med_us) + 60) / 120) / 1e6 AS median_gap_min,
       floor((2 * max(gap_us) + 60) / 120) / 1e6 AS max_gap_min,
       round(count(*) FILTER (WHERE abs(gap_us - med_us) <= 0.1 * med_us) / NULLIF(count(gap_us), 0), 6) AS share_regular
FROM gaps JOIN gm USING (batch) GROUP BY batch""")
def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensor = proxy.sensor_feed(proxy.table(spark, sf_dir, "events"))
    return q.interval_stats(q.gaps(sensor, "batch", ["ts", "id"], "ts", bucket_width(spark, sf_dir)), "batch")


@register("kpi_tiles", "E22",
          with_ctes(proxy.SQL_SPECTRAL, SQL_GAPS.format(src="spectral")) + """
, k AS (SELECT batch, count(*) AS n_readings, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS duration_h
        FROM spectral GROUP BY batch)
SELECT k.batch, k.n_readings, k.duration_h, floor((2 * gm.med_us + 60) / 120) / 1e6 AS median_interval_min FROM k JOIN gm USING (batch)""")
def kpi_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per optical batch: readings, trial duration (h), median interval (min)."""
    spec = proxy.spectral_feed(proxy.table(spark, sf_dir, "events"))
    g = q.gaps(spec, "batch", ["ts", "id"], "ts", bucket_width(spark, sf_dir))
    k = g.groupBy("batch").agg(F.count(F.lit(1)).alias("n_readings"),
                               F.round(q.hours_between(F.max("ts"), F.min("ts")), 6).alias("duration_h"))
    m = q._median_by(g, ["batch"], "gap_us", "_med_us")
    return k.join(m, "batch", "left").select("batch", "n_readings", "duration_h",
                                             q.micro_minutes(F.col("_med_us")).alias("median_interval_min"))


@register("trend", "E23",
          with_ctes(proxy.SQL_CYCLE, SQL_LONG) + """
, g AS (SELECT batch, feature, arg_min(value, (ts, cycle_number)) AS sv, arg_max(value, (ts, cycle_number)) AS ev,
               min(ts) AS t0, max(ts) AS t1
        FROM cycle_long WHERE value IS NOT NULL GROUP BY batch, feature)
SELECT batch, feature, round(sv, 6) AS start_value, round(ev, 6) AS end_value, round(ev - sv, 6) AS change,
       round((epoch_us(t1) - epoch_us(t0)) / 3.6e9, 6) AS hours,
       round((ev - sv) / NULLIF((epoch_us(t1) - epoch_us(t0)) / 3.6e9, 0), 6) AS rate_per_h
FROM g""")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.trend(cycle_long(spark, sf_dir), ["batch", "feature"], "ts", "cycle_number", "value")


@register("reliability", "E25 E26 E27",
          with_ctes(proxy.SQL_CYCLE, SQL_LONG) + """
, d AS (SELECT *, value - lag(value) OVER (PARTITION BY batch, feature ORDER BY ts, cycle_number) AS diff FROM cycle_long),
m AS (SELECT batch, feature, median(value) AS med FROM cycle_long GROUP BY ALL),
mad AS (SELECT batch, feature, median(abs(value - med)) AS mad FROM cycle_long JOIN m USING (batch, feature) GROUP BY ALL),
g AS (SELECT batch, feature, count(*) AS n, round(100 * count(value) / count(*), 6) AS coverage_pct,
             round(stddev_samp(diff) / NULLIF(stddev_samp(value), 0), 6) AS noise_ratio,
             count(*) FILTER (WHERE abs(value - med) > 3 * 1.4826 * mad) AS n_spikes
      FROM d JOIN m USING (batch, feature) JOIN mad USING (batch, feature) GROUP BY ALL)
SELECT *, CASE WHEN coverage_pct >= 90 AND 100 * n_spikes / n <= 5 THEN 'keep'
               WHEN coverage_pct >= 60 THEN 'caution' ELSE 'drop' END AS verdict FROM g""")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.reliability(cycle_long(spark, sf_dir), ["batch", "feature"], ["ts", "cycle_number"], "value",
                         bucket_width(spark, sf_dir))
