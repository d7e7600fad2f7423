"""Join-shaped queries: as-of value joins, nearest-time matching, deltas,
series scaling and the visual-marker lead/lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripestream.functions.clock import wall_micros
from ripestream.operators import asof
from ripestream.operators.quality import hours_between
from ripestream.operators.stats import safe_corr
from ripestream.operators import sequence as seq
from ripestream.plans.common import bucket_width
from ripestream.plans.labels import LABEL_CTES, sensor_labels
from ripestream.plans.quality import SQL_LONG, cycle_long
from ripestream.plans.registry import register, with_ctes
from ripestream.sources import proxy
from ripestream.sources import files
from ripestream.sources.files import image_times
from ripestream.streaming.feeds import run_dir


@register("node_delta", "D4",
          with_ctes(proxy.SQL_CYCLE) + """SELECT batch, cycle_number, round(node1_tvoc - node2_tvoc, 6) AS delta_tvoc,
       round(node1_mq3_ppm - node2_mq3_ppm, 6) AS delta_mq3_ppm FROM cycle""")
def node_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cycle: node 1 minus node 2 for each quantity (the inside-vs-reference delta)."""
    c = proxy.cycle_wide(proxy.table(spark, sf_dir, "events"))
    return c.select("batch", "cycle_number", F.round(F.col("node1_tvoc") - F.col("node2_tvoc"), 6).alias("delta_tvoc"),
                    F.round(F.col("node1_mq3_ppm") - F.col("node2_mq3_ppm"), 6).alias("delta_mq3_ppm"))


@register("overlay_scaled", "C9",
          with_ctes(proxy.SQL_CYCLE, SQL_LONG) + """
, mm AS (SELECT batch, feature, min(value) AS lo, max(value) AS hi FROM cycle_long GROUP BY ALL)
SELECT batch, cycle_number, feature, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) END, 6) AS scaled
FROM cycle_long JOIN mm USING (batch, feature)""")
def overlay_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series scaled to 0-1 by its own min / max (flat series -> NULL)."""
    lg = cycle_long(spark, sf_dir)
    mm = lg.groupBy("batch", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = lg.join(mm, ["batch", "feature"])
    s = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return j.select("batch", "cycle_number", "feature", F.round(s, 6).alias("scaled"))


@register("pct_change", "C8",
          with_ctes(proxy.SQL_CYCLE, SQL_LONG) + """
, f AS (SELECT batch, feature, arg_min(value, (ts, cycle_number)) AS x0 FROM cycle_long WHERE value IS NOT NULL GROUP BY ALL)
SELECT batch, cycle_number, feature, round(100 * (value - x0) / NULLIF(abs(x0), 0), 6) AS pct_change
FROM cycle_long JOIN f USING (batch, feature)""")
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """% change of each reading from the first reading of its series (x0 = 0 -> NULL)."""
    lg = cycle_long(spark, sf_dir)
    first = lg.where(F.col("value").isNotNull()).groupBy("batch", "feature").agg(
        F.min_by("value", F.struct("ts", "cycle_number")).alias("x0"))
    j = lg.join(first, ["batch", "feature"])
    return j.select("batch", "cycle_number", "feature",
                    F.round(100 * (F.col("value") - F.col("x0")) / F.nullif(F.abs(F.col("x0")), F.lit(0.0)), 6).alias("pct_change"))


@register("gas_vs_optical", "D10 E11",
          with_ctes(proxy.SQL_CYCLE, proxy.SQL_SPECTRAL) + """
, j AS (SELECT c.batch, c.node1_tvoc, s.nir FROM cycle c ASOF LEFT JOIN spectral s ON c.batch = s.batch AND c.ts >= s.ts)
SELECT batch, count(*) FILTER (WHERE node1_tvoc IS NOT NULL AND nir IS NOT NULL) AS n_pairs,
       round(CASE WHEN stddev_samp(node1_tvoc) FILTER (WHERE nir IS NOT NULL) > 0 AND stddev_samp(nir) FILTER (WHERE node1_tvoc IS NOT NULL) > 0 THEN corr(node1_tvoc, nir) END, 6) AS r FROM j GROUP BY batch""")
def gas_vs_optical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest optical NIR carried onto each cycle (as-of value join), then per-batch correlation with node-1 TVOC."""
    ev = proxy.table(spark, sf_dir, "events")
    cyc = proxy.cycle_wide(ev)
    spec = proxy.spectral_feed(ev)
    j = asof.asof_backward(cyc, spec, "batch", "ts", ["nir"], left_id="cycle_number", width=bucket_width(spark, sf_dir))
    both = F.col("node1_tvoc").isNotNull() & F.col("nir").isNotNull()
    return j.groupBy("batch").agg(F.count_if(both).alias("n_pairs"), F.round(safe_corr("node1_tvoc", "nir"), 6).alias("r"))


@register("elapsed", "C3 C4",
          with_ctes(proxy.SQL_SENSOR) + """
, b AS (SELECT batch, min(ts) AS t0, max(ts) AS t1 FROM sensor GROUP BY batch)
SELECT id, batch, ((epoch_us(ts) - epoch_us(t0) + 1800) // 3600) / 1e6 AS elapsed_h,
       round(100 * ((epoch_us(ts) - epoch_us(t0)) / 3.6e9) / NULLIF((epoch_us(t1) - epoch_us(t0)) / 3.6e9, 0), 6) AS elapsed_pct
FROM sensor JOIN b USING (batch)""")
def elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours since the batch's first reading (to 1e-6 h) and % of the batch duration (0 duration -> NULL)."""
    s = proxy.sensor_feed(proxy.table(spark, sf_dir, "events"))
    b = s.groupBy("batch").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    j = s.join(b, "batch")
    e = hours_between(F.col("ts"), F.col("t0"))
    d = hours_between(F.col("t1"), F.col("t0"))
    # Hours to the nearest 1e-6 h with integer arithmetic (ties up): both engines agree exactly.
    diff = wall_micros(F.col("ts")) - wall_micros(F.col("t0"))
    e_micro_h = F.floor((diff + 1800) / 3600) / 1e6
    return j.select("id", "batch", e_micro_h.alias("elapsed_h"),
                    F.round(100 * e / F.nullif(d, F.lit(0.0)), 6).alias("elapsed_pct"))


# -------------------------------------------------------------- A13 + D2
def image_listing(orders: DataFrame) -> DataFrame:
    """Proxy camera: one image per order, named from its capture time in one of two formats."""
    # Wall-clock arithmetic on TIMESTAMP_NTZ: no session time zone involved.
    ts = F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("capture_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(".jpg"))) \
        .otherwise(F.concat(F.lit("capture_"), F.date_format(ts, "yyyy-MM-dd_HH-mm-ss"), F.lit(".jpg")))
    return orders.select(F.col("o_orderkey").alias("id"), name.alias("path"))


def readings(lineitem: DataFrame) -> DataFrame:
    """Proxy NIR readings: one per instant (ship date + an offset from the line key), nir = mean price."""
    ts = F.col("l_shipdate") + F.make_dt_interval(
        secs=((F.col("l_orderkey") * 8 + F.col("l_linenumber")) % 86400).cast("decimal(18,6)"))
    r = lineitem.groupBy(ts.alias("ts")).agg(F.avg("l_extendedprice").alias("nir"))
    return r.withColumn("id", wall_micros(F.col("ts")))


@register("nearest_image", "A13 D2",
          """WITH img AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'capture_' || strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y%m%d_%H%M%S') || '.jpg'
              ELSE 'capture_' || strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d_%H-%M-%S') || '.jpg' END AS path
  FROM orders),
it AS (SELECT id, path, COALESCE(try_strptime(regexp_extract(path, '(\\d{8}_\\d{6})', 1), '%Y%m%d_%H%M%S'),
                                 try_strptime(regexp_extract(path, '(\\d{4}-\\d{2}-\\d{2}_\\d{2}-\\d{2}-\\d{2})', 1), '%Y-%m-%d_%H-%M-%S')) AS ts
       FROM img),
rd AS (SELECT l_shipdate + to_seconds((l_orderkey * 8 + l_linenumber) % 86400) AS ts, avg(l_extendedprice) AS nir FROM lineitem GROUP BY 1),
b AS (SELECT it.id, it.path, it.ts, r.ts AS bts, r.nir AS bnir FROM it ASOF LEFT JOIN rd r ON it.ts >= r.ts),
f AS (SELECT b.*, r.ts AS fts, r.nir AS fnir FROM b ASOF LEFT JOIN rd r ON b.ts <= r.ts),
g AS (SELECT *, (epoch_us(ts) - epoch_us(bts)) / 1e6 AS gb, (epoch_us(fts) - epoch_us(ts)) / 1e6 AS gf FROM f)
SELECT id, path, ts,
       CASE WHEN bts IS NULL OR (fts IS NOT NULL AND gf < gb) THEN fts ELSE bts END AS match_ts,
       round(CASE WHEN bts IS NULL OR (fts IS NOT NULL AND gf < gb) THEN fnir ELSE bnir END, 6) AS nir,
       CASE WHEN bts IS NULL OR (fts IS NOT NULL AND gf < gb) THEN gf ELSE gb END AS gap_seconds
FROM g""")
def nearest_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image (time parsed from its file name) matched to the closest NIR reading; ties -> earlier."""
    imgs = image_times(image_listing(proxy.table(spark, sf_dir, "orders"))).withColumn("cam", F.lit(0))
    rd = readings(proxy.table(spark, sf_dir, "lineitem")).withColumn("cam", F.lit(0))
    # one camera, that is one as-of key: it is split by time
    n = asof.nearest(imgs, rd, "cam", "ts", ["nir"], width=seq.bucket_width(rd, "cam", "ts"))
    return n.select("id", "path", "ts", "match_ts", F.round("nir", 6).alias("nir"), "gap_seconds")


@register("image_folder", "A13 D2",
          """WITH img AS (SELECT o_orderdate, id FROM (SELECT o_orderdate, o_orderkey AS id, row_number() OVER (PARTITION BY date_trunc('week', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1),
it AS (SELECT CASE WHEN id % 2 = 0 THEN 'capture_' || strftime(o_orderdate + to_seconds(id % 86400), '%Y%m%d_%H%M%S') || '.jpg'
                   ELSE 'capture_' || strftime(o_orderdate + to_seconds(id % 86400), '%Y-%m-%d_%H-%M-%S') || '.jpg' END AS image, CAST(o_orderdate + to_seconds(id % 86400) AS TIMESTAMP) AS ts FROM img),
rd AS (SELECT l_shipdate + to_seconds((l_orderkey * 8 + l_linenumber) % 86400) AS ts, avg(l_extendedprice) AS nir FROM lineitem GROUP BY 1),
b AS (SELECT it.image, it.ts, r.ts AS bts, r.nir AS bnir FROM it ASOF LEFT JOIN rd r ON it.ts >= r.ts),
f AS (SELECT b.*, r.ts AS fts, r.nir AS fnir FROM b ASOF LEFT JOIN rd r ON b.ts <= r.ts),
g AS (SELECT *, (epoch_us(ts) - epoch_us(bts)) / 1e6 AS gb, (epoch_us(fts) - epoch_us(ts)) / 1e6 AS gf FROM f)
SELECT image, ts, CASE WHEN bts IS NULL OR (fts IS NOT NULL AND gf < gb) THEN fts ELSE bts END AS match_ts,
       round(CASE WHEN bts IS NULL OR (fts IS NOT NULL AND gf < gb) THEN fnir ELSE bnir END, 6) AS nir FROM g""")
def image_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of small files, named like the first capture of each week, listed by path and matched to the closest reading."""
    orders = proxy.table(spark, sf_dir, "orders")
    first = orders.groupBy(F.date_trunc("week", "o_orderdate")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first")).select("first.*")
    base = f"{run_dir(spark, 'images')}/camera"
    made = image_listing(first).select(F.lit("not read").alias("value"), F.col("path").alias("image"))
    made.hint("rebalance", "image").write.partitionBy("image").text(base)
    listed = files.image_listing(spark, base, "part-*").withColumn("image", F.regexp_extract("path", "image=([^/]+)", 1))
    imgs = listed.select("image", "ts", wall_micros("ts").alias("id"), F.lit(0).alias("cam"))
    rd = readings(proxy.table(spark, sf_dir, "lineitem")).withColumn("cam", F.lit(0))
    n = asof.nearest(imgs, rd, "cam", "ts", ["nir"], width=seq.bucket_width(rd, "cam", "ts"))
    return n.select("image", "ts", "match_ts", F.round("nir", 6).alias("nir"))


# ------------------------------------------------------------- E29 + D7
@register("lead_lag", "E29 D7",
          with_ctes(*LABEL_CTES) + """
, span AS (SELECT batch, min(ts) AS t0, max(ts) AS t1 FROM sensor GROUP BY batch),
mk AS (SELECT user_id AS batch, min(ts) AS marker FROM events WHERE event_type = 'purchase' GROUP BY 1),
ratio AS (SELECT s.batch, (epoch_us(mk.marker) - epoch_us(t0)) / NULLIF(epoch_us(t1) - epoch_us(t0), 0) AS r
          FROM span s JOIN mk USING (batch)),
mr AS (SELECT avg(r) AS mean_ratio FROM ratio),
deg AS (SELECT batch, min(ts) AS first_degraded FROM sensor_labels WHERE nir_label = 'Degraded' GROUP BY batch),
mm AS (SELECT s.batch, mk.marker IS NULL AS marker_imputed,
              COALESCE(epoch_us(mk.marker), epoch_us(t0) + mean_ratio * (epoch_us(t1) - epoch_us(t0))) AS marker_us
       FROM span s LEFT JOIN mk USING (batch), mr)
SELECT mm.batch, marker_imputed, d.first_degraded,
       round((marker_us - epoch_us(d.first_degraded)) / 3.6e9, 6) AS lead_h
FROM mm LEFT JOIN deg d USING (batch)""")
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours by which the first Degraded sensor label leads the visual marker (proxy: first purchase).

    A batch without a marker gets one at the mean elapsed ratio of the other batches.
    """
    ev = proxy.table(spark, sf_dir, "events")
    sensor = proxy.sensor_feed(ev)
    us = lambda c: wall_micros(F.col(c))
    span = sensor.groupBy("batch").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    mk = ev.where(F.col("event_type") == "purchase").groupBy(F.col("user_id").alias("batch")).agg(F.min("ts").alias("marker"))
    ratio = span.join(mk, "batch").select(((us("marker") - us("t0")) / F.nullif(us("t1") - us("t0"), F.lit(0))).alias("r"))
    mean_ratio = ratio.agg(F.avg("r")).scalar()
    mm = span.join(mk, "batch", "left").select(
        "batch", F.col("marker").isNull().alias("marker_imputed"),
        F.coalesce(us("marker").cast("double"), us("t0") + mean_ratio * (us("t1") - us("t0"))).alias("marker_us"))
    deg = sensor_labels(spark, sf_dir).where(F.col("nir_label") == "Degraded").groupBy("batch").agg(
        F.min("ts").alias("first_degraded"))
    j = mm.join(deg, "batch", "left")
    return j.select("batch", "marker_imputed", "first_degraded",
                    F.round((F.col("marker_us") - us("first_degraded")) / 3.6e9, 6).alias("lead_h"))
