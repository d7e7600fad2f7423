"""Sensor-physics, calibration, timing and status queries on ``events``.

Proxy: ADC counts := props.k · 41; arrival := milliseconds into a 2-minute
cycle of ``ts``; temperature := value - 20, humidity := k; baselines :=
(value · 100, k · 700); exposure := value · 100 µs, gain := k / 10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripestream.functions.clock import wall_micros
from ripestream.functions import physics as ph
from ripestream.operators import sequence as seq
from ripestream.plans.common import bucket_width
from ripestream.plans.registry import register
from ripestream.sources import proxy

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
SQL_PHYS = f"""WITH ev AS (SELECT event_id, user_id AS batch, ts, event_type, value, {K} AS k, {K} * 41 AS adc FROM events),
vo AS (SELECT *, adc / 4095 * 3.3 / (100000 / 156000) AS v_out FROM ev),
rs AS (SELECT *, CASE WHEN v_out >= 0.01 AND v_out < 5.0 THEN 1000.0 * (5.0 - v_out) / v_out END AS rs FROM vo)
"""


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = proxy.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.col("user_id").alias("batch"), "ts", "event_type", "value", k.alias("k"),
                    (k * 41).alias("adc"))


@register("adc_ppm", "C1 C2",
          SQL_PHYS + """SELECT event_id, adc, round(v_out, 6) AS v_out, round(rs, 6) AS rs,
       round(CASE WHEN rs > 0 THEN pow(10.0, (log10(rs / 20000.0) - 0.35) / -0.47) END, 6) AS ppm FROM rs""")
def adc_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    rs = ph.adc_to_rs(F.col("adc"))
    return ev.select("event_id", "adc", F.round(ph.v_out(F.col("adc")), 6).alias("v_out"), F.round(rs, 6).alias("rs"),
                     F.round(ph.rs_to_ppm(rs), 6).alias("ppm"))


@register("calibrate_r0", "E21",
          SQL_PHYS + """, rk AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ts, event_id) AS rn FROM rs)
SELECT batch, count(*) FILTER (WHERE rn <= 30 AND rs > 0) AS n_valid,
       round(COALESCE(avg(CASE WHEN rn <= 30 AND rs > 0 THEN rs END), 20000.0), 6) AS r0
FROM rk GROUP BY batch""")
def calibrate_r0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline R0 per device = mean of the valid Rs among its first 30 samples; none valid -> unchanged (20000)."""
    ev = _ev(spark, sf_dir).withColumn("rs", ph.adc_to_rs(F.col("adc")))
    # Spark keeps the first 30 rows of a device before it deals them
    first = ev.withColumn("rn", F.row_number().over(Window.partitionBy("batch").orderBy("ts", "event_id"))).where("rn <= 30")
    in_window = F.col("rs") > 0
    return first.groupBy("batch").agg(
        F.count_if(in_window).alias("n_valid"),
        F.round(F.coalesce(F.avg(F.when(in_window, F.col("rs"))), F.lit(ph.R0_DEFAULT)), 6).alias("r0"))


SQL_ARRIVAL = "CAST((epoch_us(ts) // 1000) % 120000 AS INTEGER)"


SQL_TIMING = f"""WITH a AS (SELECT event_id, {SQL_ARRIVAL} AS arrival_ms FROM events),
g AS (SELECT *, arrival_ms - 50000 AS err,
             CASE WHEN abs(arrival_ms - 50000) > 10000 THEN CAST(0.5 AS FLOAT)
                  WHEN abs(arrival_ms - 50000) > 5000 THEN CAST(0.45 AS FLOAT) ELSE CAST(0.4 AS FLOAT) END AS gain FROM a),
c AS (SELECT event_id, arrival_ms,
             CASE WHEN arrival_ms < 45000 THEN CAST(greatest(5000, 50000 - arrival_ms + 2000) AS INTEGER)
                  ELSE greatest(-10000, least(10000, CAST(trunc(CAST(-err AS FLOAT) * gain) AS INTEGER))) END AS adjust_ms FROM g)
SELECT event_id, arrival_ms, adjust_ms, greatest(100, 900000 - arrival_ms + adjust_ms) AS sleep_ms FROM c"""


@register("timing_correction", "C12 C13 J9", SQL_TIMING)
def timing_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct_timing(proxy.table(spark, sf_dir, "events"))


def correct_timing(events: DataFrame) -> DataFrame:
    """Per packet: arrival offset in its cycle, send-time correction, next sleep (15-min cycle)."""
    arrival = (F.floor(wall_micros("ts") / 1000) % 120000).cast("int")
    adj = events.select("event_id", arrival.alias("arrival_ms")).withColumn("adjust_ms", ph.arrival_adjust(F.col("arrival_ms")))
    return adj.withColumn("sleep_ms", ph.remaining_sleep(F.lit(900000), F.col("arrival_ms"), F.col("adjust_ms")))


@register("status_flags", "B12 B13 B14 B15",
          SQL_PHYS + """, b AS (SELECT batch, min(ts) AS boot FROM ev GROUP BY batch)
SELECT event_id,
       COALESCE(value - 20 > -40 AND value - 20 < 80 AND k >= 0 AND k <= 100, FALSE) AS plausible,
       CASE WHEN event_id % 2 = 0 THEN '-' WHEN value - 20 > -40 AND value - 20 < 80 AND k >= 0 AND k <= 100 THEN 'o' ELSE 'x' END AS status_dht,
       CASE WHEN value IS NULL OR value >= 150 THEN 'x' WHEN (epoch_us(ts) - epoch_us(boot)) / 1e6 < 15 THEN 'w' ELSE 'o' END AS status_sgp,
       CASE WHEN rs > 0 THEN 'o' ELSE 'x' END AS status_mq3,
       COALESCE(value * 100 <> 0 AND k * 700 <> 0 AND value * 100 <= 60000 AND k * 700 <= 60000, FALSE) AS baseline_ok,
       COALESCE(exposure, 0) > 20000 OR COALESCE(gain, 1.0) > 4.0 AS low_light,
       CASE WHEN exposure IS NULL AND gain IS NULL THEN 5 WHEN COALESCE(exposure, 0) > 20000 OR COALESCE(gain, 1.0) > 4.0 THEN 6 ELSE 3 END AS delay_s
FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value * 100 END AS exposure, CASE WHEN event_type NOT IN ('error', 'click') THEN k / 10 END AS gain
      FROM rs) JOIN b USING (batch)""")
def status_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    boot = ev.groupBy("batch").agg(F.min("ts").alias("boot"))
    j = ev.join(boot, "batch")
    temp, hum = F.col("value") - 20, F.col("k")
    ok = ph.plausible_climate(temp, hum)
    elapsed = (wall_micros(F.col("ts")) - wall_micros(F.col("boot"))) / 1e6
    # proxy: error events carry no camera metadata, clicks no gain; the climate sensor is read every second tick
    exposure = F.when(F.col("event_type") != "error", F.col("value") * 100)
    gain = F.when(~F.col("event_type").isin("error", "click"), F.col("k") / 10)
    return j.select("event_id", ok.alias("plausible"),
                    ph.status_letter(ok, sampled=F.col("event_id") % 2 != 0).alias("status_dht"),
                    ph.status_letter(F.col("value") < 150, elapsed_s=elapsed).alias("status_sgp"),
                    ph.status_letter(ph.adc_to_rs(F.col("adc")) > 0).alias("status_mq3"),
                    ph.baseline_plausible(F.col("value") * 100, F.col("k") * 700).alias("baseline_ok"),
                    ph.low_light(exposure, gain).alias("low_light"), ph.capture_delay_s(exposure, gain).alias("delay_s"))


@register("hold_last", "F8",
          """WITH s AS (SELECT user_id AS batch, event_id, ts, value, CASE WHEN value < 100 THEN value END AS sane FROM events)
SELECT batch, event_id, value, last_value(sane IGNORE NULLS) OVER (PARTITION BY batch ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM s""")
def hold_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold the last sane reading (value < 100) per device; insane readings show the held value."""
    e = proxy.table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), "event_id", "ts", "value")
    e = e.withColumn("sane", F.when(F.col("value") < 100, F.col("value")))
    h = seq.ffill(e, "batch", ["ts", "event_id"], "sane", "held", width=bucket_width(spark, sf_dir))
    return h.select("batch", "event_id", "value", "held")
