"""Feature-preparation queries over the cycle-wide proxy table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripestream.functions.zones import encode_label
from ripestream.operators import asof, features as feat
from ripestream.plans.labels import LABEL_CTES, labelled_spectral
from ripestream.plans.common import bucket_width, staged
from ripestream.plans.registry import register, with_ctes
from ripestream.sources import proxy

RAW = ["node1_tvoc", "node1_mq3_ppm", "node2_tvoc", "node2_mq3_ppm"]
TVOC = ["node1_tvoc", "node2_tvoc"]
DELTAS = {"delta_node1_tvoc": "node1_tvoc", "delta_node2_tvoc": "node2_tvoc"}
FEATURES = RAW + list(DELTAS)
REQUIRED = "node2_mq3_ppm"
SAT = proxy.PROXY_SATURATION


def split_of(batch) -> F.Column:
    """Proxy split by batch id: 1, 3 train; 2 held; 0 test (every batch has a split)."""
    m = batch % 4
    return F.when(m.isin(1, 3), "train").when(m == 2, "held").otherwise("test")


# ---------------------------------------------------------------- builders
def cycle_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = proxy.table(spark, sf_dir, "events")
    cyc = proxy.cycle_wide(events)
    spec = labelled_spectral(spark, sf_dir)
    return asof.asof_backward(cyc, spec, "batch", "ts", ["nir_label"], left_id="cycle_number",
                              width=bucket_width(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5 -> B2 -> B6 -> E8/E9 -> F3 -> split/label: one row per kept cycle (materialised)."""
    return staged(spark, sf_dir, "prepared", lambda: _prepared(spark, sf_dir))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = cycle_labels(spark, sf_dir).where(F.col("nir_label").isNotNull())
    masked = feat.mask_saturated(lab, TVOC, SAT)
    kept = masked.where(F.col(REQUIRED).isNotNull())
    imp = feat.impute_median(kept, "batch", RAW)
    dl = feat.within_key_delta(imp, "batch", ["ts", "cycle_number"], DELTAS, width=bucket_width(spark, sf_dir))
    return dl.withColumn("split", split_of(F.col("batch"))).withColumn("label", encode_label(F.col("nir_label")))


# --------------------------------------------------------------------- SQL
SQL_CYCLE_LABELS = """cycle_labels AS (
  SELECT c.*, m.nir_label FROM cycle c ASOF LEFT JOIN filled m ON c.batch = m.batch AND c.ts >= m.ts)"""

SQL_PREP = """lab AS (SELECT * FROM cycle_labels WHERE nir_label IS NOT NULL),
masked AS (
  SELECT batch, cycle_number, ts, CASE WHEN node1_tvoc < 150 THEN node1_tvoc END AS node1_tvoc, node1_mq3_ppm,
         CASE WHEN node2_tvoc < 150 THEN node2_tvoc END AS node2_tvoc, node2_mq3_ppm, nir_label
  FROM lab),
kept AS (SELECT * FROM masked WHERE node2_mq3_ppm IS NOT NULL),
bm AS (SELECT batch, median(node1_tvoc) AS m1, median(node1_mq3_ppm) AS m2, median(node2_tvoc) AS m3,
              median(node2_mq3_ppm) AS m4 FROM kept GROUP BY batch),
bf AS (
  SELECT k.batch, cycle_number, ts, nir_label,
         COALESCE(node1_tvoc, m1) AS node1_tvoc, COALESCE(node1_mq3_ppm, m2) AS node1_mq3_ppm,
         COALESCE(node2_tvoc, m3) AS node2_tvoc, COALESCE(node2_mq3_ppm, m4) AS node2_mq3_ppm,
         CASE WHEN node1_tvoc IS NOT NULL THEN 'raw' WHEN m1 IS NOT NULL THEN 'batch' END AS s1,
         CASE WHEN node1_mq3_ppm IS NOT NULL THEN 'raw' WHEN m2 IS NOT NULL THEN 'batch' END AS s2,
         CASE WHEN node2_tvoc IS NOT NULL THEN 'raw' WHEN m3 IS NOT NULL THEN 'batch' END AS s3,
         CASE WHEN node2_mq3_ppm IS NOT NULL THEN 'raw' WHEN m4 IS NOT NULL THEN 'batch' END AS s4
  FROM kept k JOIN bm USING (batch)),
gm AS (SELECT median(node1_tvoc) AS g1, median(node1_mq3_ppm) AS g2, median(node2_tvoc) AS g3,
              median(node2_mq3_ppm) AS g4 FROM bf),
imp AS (
  SELECT batch, cycle_number, ts, nir_label,
         COALESCE(node1_tvoc, g1) AS node1_tvoc, COALESCE(node1_mq3_ppm, g2) AS node1_mq3_ppm,
         COALESCE(node2_tvoc, g3) AS node2_tvoc, COALESCE(node2_mq3_ppm, g4) AS node2_mq3_ppm,
         COALESCE(s1, CASE WHEN g1 IS NOT NULL THEN 'global' END) AS s1,
         COALESCE(s2, CASE WHEN g2 IS NOT NULL THEN 'global' END) AS s2,
         COALESCE(s3, CASE WHEN g3 IS NOT NULL THEN 'global' END) AS s3,
         COALESCE(s4, CASE WHEN g4 IS NOT NULL THEN 'global' END) AS s4
  FROM bf, gm),
prep AS (
  SELECT *,
         COALESCE(node1_tvoc - lag(node1_tvoc) OVER (PARTITION BY batch ORDER BY ts, cycle_number), 0) AS delta_node1_tvoc,
         COALESCE(node2_tvoc - lag(node2_tvoc) OVER (PARTITION BY batch ORDER BY ts, cycle_number), 0) AS delta_node2_tvoc,
         CASE WHEN batch % 4 IN (1, 3) THEN 'train' WHEN batch % 4 = 2 THEN 'held' ELSE 'test' END AS split,
         CASE nir_label WHEN 'Fresh' THEN 0 WHEN 'Aging' THEN 1 WHEN 'Degraded' THEN 2 END AS label
  FROM imp)"""

PREP_CTES = (*LABEL_CTES, proxy.SQL_CYCLE, SQL_CYCLE_LABELS, SQL_PREP)


def _r(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# ----------------------------------------------------------------- queries
@register("imputed", "B5 B2 B6 E8 E9 K3",
          with_ctes(*PREP_CTES) + """
SELECT batch, cycle_number, ts, nir_label, round(node1_tvoc, 6) AS node1_tvoc, round(node1_mq3_ppm, 6) AS node1_mq3_ppm,
       round(node2_tvoc, 6) AS node2_tvoc, round(node2_mq3_ppm, 6) AS node2_mq3_ppm FROM imp""")
def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return p.select("batch", "cycle_number", "ts", "nir_label", *[_r(c) for c in RAW])


@register("impute_audit", "E9 E32",
          with_ctes(*PREP_CTES) + "\nUNION ALL\n".join(
              f"SELECT '{c}' AS feature, count(*) FILTER (WHERE s{i} = 'raw') AS n_raw, "
              f"count(*) FILTER (WHERE s{i} = 'batch') AS n_batch, count(*) FILTER (WHERE s{i} = 'global') AS n_global, "
              f"count(*) FILTER (WHERE {c} IS NULL) AS n_residual FROM imp" for i, c in enumerate(RAW, 1)))
def impute_audit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = cycle_labels(spark, sf_dir).where(F.col("nir_label").isNotNull())
    kept = feat.mask_saturated(lab, TVOC, SAT).where(F.col(REQUIRED).isNotNull())
    return feat.impute_audit(feat.impute_median(kept, "batch", RAW), RAW)


@register("delta_train", "F3 K3",
          with_ctes(*PREP_CTES) + """
SELECT batch, cycle_number, round(delta_node1_tvoc, 6) AS delta_node1_tvoc,
       round(delta_node2_tvoc, 6) AS delta_node2_tvoc FROM prep""")
def delta_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return p.select("batch", "cycle_number", _r("delta_node1_tvoc"), _r("delta_node2_tvoc"))


@register("delta_report", "E34",
          with_ctes(*PREP_CTES) + """
SELECT 'delta_node1_tvoc' AS feature, round(min(delta_node1_tvoc), 6) AS min, round(max(delta_node1_tvoc), 6) AS max,
       round(avg(delta_node1_tvoc), 6) AS mean FROM prep
UNION ALL
SELECT 'delta_node2_tvoc', round(min(delta_node2_tvoc), 6), round(max(delta_node2_tvoc), 6),
       round(avg(delta_node2_tvoc), 6) FROM prep""")
def delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    structs = [F.struct(F.lit(c).alias("feature"), F.round(F.min(c), 6).alias("min"), F.round(F.max(c), 6).alias("max"),
                        F.round(F.avg(c), 6).alias("mean")) for c in DELTAS]
    return p.agg(F.array(*structs).alias("a")).select(F.inline("a"))


@register("delta_serving", "F5",
          with_ctes(proxy.SQL_CYCLE) + """
, comp AS (SELECT batch, cycle_number, node1_tvoc, node2_tvoc FROM cycle
           WHERE node1_tvoc IS NOT NULL AND node2_tvoc IS NOT NULL)
SELECT c.batch, c.cycle_number, (c.node1_tvoc IS NOT NULL AND c.node2_tvoc IS NOT NULL) AS complete,
       round(d.delta_node1_tvoc, 6) AS delta_node1_tvoc, round(d.delta_node2_tvoc, 6) AS delta_node2_tvoc
FROM cycle c LEFT JOIN (
  SELECT batch, cycle_number,
         node1_tvoc - COALESCE(lag(node1_tvoc) OVER (PARTITION BY batch ORDER BY cycle_number), 0) AS delta_node1_tvoc,
         node2_tvoc - COALESCE(lag(node2_tvoc) OVER (PARTITION BY batch ORDER BY cycle_number), 0) AS delta_node2_tvoc
  FROM comp) d USING (batch, cycle_number)""")
def delta_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving delta on raw cycles: previous value advances only on complete cycles, starts at 0."""
    cyc = proxy.cycle_wide(proxy.table(spark, sf_dir, "events"))
    complete = F.col("node1_tvoc").isNotNull() & F.col("node2_tvoc").isNotNull()
    d = feat.serving_delta(cyc, "batch", ["cycle_number"], DELTAS, complete, width=bucket_width(spark, sf_dir))
    return d.select("batch", "cycle_number", complete.alias("complete"), _r("delta_node1_tvoc"), _r("delta_node2_tvoc"))


def _norm_params(p: DataFrame) -> DataFrame:
    return feat.fit_minmax(p, FEATURES)


@register("norm_params", "E10 K5",
          with_ctes(*PREP_CTES) + "\n" + "\nUNION ALL\n".join(
              f"SELECT '{c}' AS feature, round(min({c}), 6) AS min, round(max({c}), 6) AS max, "
              f"round(CASE WHEN max({c}) - min({c}) = 0 THEN 1.0 ELSE max({c}) - min({c}) END, 6) AS range FROM prep"
              for c in FEATURES))
def norm_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min / max / range per feature, fitted on all splits (the reference's code path)."""
    p = _norm_params(prepared(spark, sf_dir))
    return p.select("feature", _r("min"), _r("max"), _r("range"))


_NORM_SQL = ",\n       ".join(
    f"round(CASE WHEN ({c} - mn_{i}) / rg_{i} < 0 THEN 0.0 WHEN ({c} - mn_{i}) / rg_{i} > 1 THEN 1.0 "
    f"ELSE ({c} - mn_{i}) / rg_{i} END, 6) AS {c}_norm" for i, c in enumerate(FEATURES))
_FIT_SQL = ", ".join(
    f"min({c}) AS mn_{i}, CASE WHEN max({c}) - min({c}) = 0 THEN 1.0 ELSE max({c}) - min({c}) END AS rg_{i}"
    for i, c in enumerate(FEATURES))


@register("normalised_split", "B8 C5 A9 H2",
          with_ctes(*PREP_CTES) + f"""
, fit AS (SELECT {_FIT_SQL} FROM prep)
SELECT batch, cycle_number, ts, split, {_NORM_SQL}, nir_label, label FROM prep, fit""")
def normalised_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export rows: meta + scaled features + label text + code, every split."""
    p = prepared(spark, sf_dir)
    s = feat.apply_minmax(p, FEATURES, feat.fit_minmax_struct(p, FEATURES))
    return s.select("batch", "cycle_number", "ts", "split", *[_r(c + "_norm") for c in FEATURES], "nir_label", "label")


@register("dataset_stats", "A10 A11 E5",
          with_ctes(*PREP_CTES) + """
SELECT split, count(*) AS n, count(*) FILTER (WHERE label = 0) AS n_fresh, count(*) FILTER (WHERE label = 1) AS n_aging,
       count(*) FILTER (WHERE label = 2) AS n_degraded, count(DISTINCT batch) AS n_batches FROM prep GROUP BY split
UNION ALL
SELECT 'combined', count(*), count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1),
       count(*) FILTER (WHERE label = 2), count(DISTINCT batch) FROM prep WHERE split <> 'test'""")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split (and the combined train+held set): rows, class balance, batches."""
    p = prepared(spark, sf_dir)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("n_fresh"),
            F.count_if(F.col("label") == 1).alias("n_aging"), F.count_if(F.col("label") == 2).alias("n_degraded"),
            F.count_distinct("batch").alias("n_batches")]
    per = p.groupBy("split").agg(*aggs)
    comb = p.where(F.col("split") != "test").agg(*aggs).select(F.lit("combined").alias("split"), "*")
    return per.unionByName(comb)


@register("split_summary", "C18 B8 E5",
          with_ctes(*PREP_CTES) + """
SELECT 'batch' || CAST(batch AS VARCHAR) AS batch_name,
       CASE split WHEN 'train' THEN 'Train' WHEN 'held' THEN 'Held' ELSE 'Test' END AS split_display,
       count(*) AS n_rows FROM prep GROUP BY ALL""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch: its split as shown in summaries (held batches show as Held, not Test) and its size."""
    p = prepared(spark, sf_dir)
    disp = F.when(F.col("split") == "train", "Train").when(F.col("split") == "held", "Held").otherwise("Test")
    return p.groupBy(F.concat(F.lit("batch"), F.col("batch").cast("string")).alias("batch_name"),
                     disp.alias("split_display")).agg(F.count(F.lit(1)).alias("n_rows"))
