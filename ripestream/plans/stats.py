"""Statistics queries: correlations, box and density summaries, channel runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripestream.functions.zones import signal_strength
from ripestream.operators import features as feat
from ripestream.operators import stats as st
from ripestream.plans.features import FEATURES, PREP_CTES, prepared
from ripestream.plans.registry import register, with_ctes
from ripestream.sources import proxy

LI_FEATURES = ["l_quantity", "l_discount", "l_tax"]
LI_TARGET = "l_extendedprice"
CHANNELS = ["f6_590nm", "f7_630nm", "f8_680nm", "nir"]
DARK_RUN = "N"  # the run recorded in the dark: its CV verdict is not applicable


def _r(c) -> F.Column:
    return F.round(c, 6).alias(c if isinstance(c, str) else None)


def _ranked_corr(df: DataFrame) -> DataFrame:
    """(feature, n, r) -> + signal bucket and strength order by |r| (C14, G3) on the k-row result."""
    return df.select(
        "feature", "n", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"), signal_strength(F.col("r")).alias("signal"),
        F.row_number().over(Window.orderBy(F.abs(F.col("r")).desc(), "feature")).alias("strength_rank"))


#: Steps of Simpson's rule over the density of Student's t in the p-value's SQL.
_SIMPSON = 20000


def _sql_spearman(src: str, feats: list[str], target: str, where: str = "") -> str:
    rk = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rk_{c}" for c in [*feats, target])
    body = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, count(*) AS n, CASE WHEN stddev_samp(rk_{c}) > 0 AND stddev_samp(rk_{target}) > 0 "
        f"THEN corr(rk_{c}, rk_{target}) END AS r FROM rk" for c in feats)
    return f""", rk AS (SELECT {rk} FROM {src} {where}),
r AS ({body}),
tt AS (SELECT *, CASE WHEN n >= 3 AND abs(r) < 1 THEN abs(r) * sqrt((n - 2) / (1 - r * r)) END AS t FROM r),
area AS (SELECT feature, sum((CASE WHEN i = 0 OR i = {_SIMPSON} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                             * exp(-(n - 1) / 2 * ln(1 + (t * i / {_SIMPSON}) * (t * i / {_SIMPSON}) / (n - 2)))) * t / {_SIMPSON} / 3
                         * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt(pi() * (n - 2)) AS half
         FROM tt, range(0, {_SIMPSON} + 1) g(i) WHERE t IS NOT NULL GROUP BY feature, n, t)
SELECT feature, n, round(r, 6) AS r,
       round(CASE WHEN n >= 3 AND abs(r) >= 1 THEN 0.0 ELSE greatest(0.0, 1 - 2 * half) END, 6) AS p,
       CASE WHEN abs(r) >= 0.3 THEN 'STRONG' WHEN abs(r) >= 0.1 THEN 'weak' ELSE 'noise' END AS signal,
       row_number() OVER (ORDER BY abs(r) DESC, feature) AS strength_rank FROM tt LEFT JOIN area USING (feature)"""


@register("spearman", "E12 F6 C14 G3",
          "WITH li AS (SELECT * FROM lineitem)" + _sql_spearman("li", LI_FEATURES, LI_TARGET))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman r (average ranks) of lineitem measures vs extended price."""
    li = proxy.table(spark, sf_dir, "lineitem")
    return _ranked_corr(st.spearman(li, LI_FEATURES, LI_TARGET))


@register("spearman_train", "E12 F6 C14",
          with_ctes(*PREP_CTES) + ", tr AS (SELECT * FROM prep WHERE split = 'train')"
          + _sql_spearman("tr", FEATURES, "label"))
def spearman_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features vs label code on the training split (the reference's pre-training check)."""
    p = prepared(spark, sf_dir).where(F.col("split") == "train")
    return _ranked_corr(st.spearman(p, FEATURES, "label"))


_PAIRS = [(a, b) for i, a in enumerate([*FEATURES, "label"]) for b in [*FEATURES, "label"][i + 1:]]


@register("pearson_matrix", "E11 B17",
          with_ctes(*PREP_CTES) + ", tr AS (SELECT * FROM prep WHERE split = 'train' AND "
          + " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, "label"]) + ")\n"
          + "\nUNION ALL\n".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(CASE WHEN stddev_samp({a}) > 0 AND "
                                 f"stddev_samp({b}) > 0 THEN corr({a}, {b}) END, 6) AS r FROM tr"
                                 for a, b in _PAIRS))
def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir).where(F.col("split") == "train")
    m = st.pearson_matrix(p, [*FEATURES, "label"])
    return m.select("feature_a", "feature_b", F.round("r", 6).alias("r"))


BOX_VALUES = ["l_quantity", "l_extendedprice"]


@register("box_stats", "E13",
          "WITH " + ",\n".join(
              f"""q_{v} AS (SELECT l_returnflag, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS med,
                     quantile_cont({v}, 0.75) AS q3 FROM lineitem GROUP BY 1)""" for v in BOX_VALUES) + "\n"
          + "\nUNION ALL\n".join(
              f"""SELECT l_returnflag, '{v}' AS feature, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median,
       round(any_value(q3), 6) AS q3,
       round(min(CASE WHEN {v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {v} END), 6) AS whisker_lo,
       round(max(CASE WHEN {v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {v} END), 6) AS whisker_hi,
       count(*) FILTER (WHERE NOT ({v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers,
       count({v}) AS n
FROM lineitem JOIN q_{v} USING (l_returnflag) GROUP BY l_returnflag""" for v in BOX_VALUES))
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box-plot numbers per return flag (the class proxy) for two measures, both in one pass."""
    arr = F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("value")) for v in BOX_VALUES])
    long = proxy.table(spark, sf_dir, "lineitem").select("l_returnflag", F.inline(arr))
    b = st.box_stats(long, ["l_returnflag", "feature"], "value")
    return b.select("l_returnflag", "feature", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")], "n_outliers", "n")


@register("density_hist", "E14",
          """WITH rg AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem
  WHERE l_returnflag IN (SELECT l_returnflag FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1 HAVING count(*) > 1)),
b AS (SELECT l_returnflag, CAST(least(28, floor((l_quantity - lo) / ((hi - lo) / 29))) AS INTEGER) AS bin FROM lineitem, rg),
nc AS (SELECT l_returnflag, count(*) AS n_class FROM lineitem GROUP BY 1 HAVING count(*) > 1),
grid AS (SELECT l_returnflag, n_class, CAST(i AS INTEGER) AS bin FROM nc, range(0, 29) t(i)),
c AS (SELECT l_returnflag, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT g.l_returnflag, g.bin, round(lo + g.bin * ((hi - lo) / 29), 6) AS edge_lo, COALESCE(c.n, 0) AS n,
       round(COALESCE(c.n, 0) / (g.n_class * ((hi - lo) / 29)), 6) AS density
FROM grid g LEFT JOIN c USING (l_returnflag, bin), rg""")
def density_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = proxy.table(spark, sf_dir, "lineitem")
    h = st.density_hist(li, "l_returnflag", "l_quantity")
    return h.select("l_returnflag", "bin", F.round("edge_lo", 6).alias("edge_lo"), "n", F.round("density", 6).alias("density"))


def runs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = proxy.condition_runs(proxy.table(spark, sf_dir, "lineitem"))
    arr = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in CHANNELS])
    return runs.select("run", "ts", "l_orderkey", "l_linenumber", F.inline(arr))


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel summary of the condition runs; rows in order of (day, order, line) as one number."""
    runs = proxy.condition_runs(proxy.table(spark, sf_dir, "lineitem"))
    place = (F.unix_date(F.to_date("ts")).cast("decimal(38,0)") * F.lit(10**18).cast("decimal(20,0)") + F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("decimal(38,0)")
    return st.channel_summary(runs, "run", place, CHANNELS)


_RUNS_SQL = "rl AS (" + "\nUNION ALL\n".join(
    f"SELECT l_returnflag AS run, l_shipdate AS ts, l_orderkey, l_linenumber, '{c}' AS channel, {src} AS value FROM lineitem"
    for c, src in zip(CHANNELS, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])) + """),
cs AS (SELECT run, channel, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max,
              arg_min(value, (ts, l_orderkey, l_linenumber)) AS first, arg_max(value, (ts, l_orderkey, l_linenumber)) AS last
       FROM rl WHERE value IS NOT NULL GROUP BY ALL),
cv AS (SELECT *, sd / NULLIF(mean, 0) * 100 AS cv_pct, (last - first) / NULLIF(abs(first), 0) * 100 AS drift_pct FROM cs)"""


@register("channel_summary", "E20 C16 A4 M14 K2",
          "WITH " + _RUNS_SQL + """
SELECT run, channel, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(min, 6) AS min, round(max, 6) AS max,
       round(cv_pct, 6) AS cv_pct, round(drift_pct, 6) AS drift_pct, round_even(cv_pct, 2) AS cv_display FROM cv""")
def channel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per condition run × channel: mean, SD, min, max, CV %, drift %; display rounding half-even."""
    s = _channels(spark, sf_dir)
    return s.select("run", "channel", "n", *[F.round(c, 6).alias(c) for c in
                    ("mean", "sd", "min", "max", "cv_pct", "drift_pct")], F.bround("cv_pct", 2).alias("cv_display"))


@register("cv_verdict", "C15",
          "WITH " + _RUNS_SQL + f"""
SELECT run, channel, CASE WHEN run = '{DARK_RUN}' THEN 'N/A' WHEN COALESCE(cv_pct < 2, FALSE) THEN 'pass' ELSE 'fail' END AS verdict
FROM cv""")
def cv_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _channels(spark, sf_dir)
    return s.select("run", "channel", st.cv_verdict(F.col("cv_pct"), F.col("run"), DARK_RUN).alias("verdict"))


@register("band_2pct", "C17",
          "WITH " + _RUNS_SQL + """
SELECT rl.run, rl.channel, round(any_value(cv.mean) * 0.98, 6) AS band_lo, round(any_value(cv.mean) * 1.02, 6) AS band_hi,
       count(*) FILTER (WHERE rl.value BETWEEN cv.mean * 0.98 AND cv.mean * 1.02) AS n_within, count(rl.value) AS n
FROM rl JOIN cv USING (run, channel) GROUP BY ALL""")
def band_2pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """±2 % band around each run's channel mean and how many readings fall inside."""
    rl = runs_long(spark, sf_dir)
    m = rl.groupBy("run", "channel").agg(F.avg("value").alias("mean"))
    j = rl.join(m, ["run", "channel"])
    inside = F.col("value").between(F.col("mean") * 0.98, F.col("mean") * 1.02)
    return j.groupBy("run", "channel").agg(
        F.round(F.first("mean") * 0.98, 6).alias("band_lo"), F.round(F.first("mean") * 1.02, 6).alias("band_hi"),
        F.count_if(inside).alias("n_within"), F.count("value").alias("n"))


@register("per_class_means", "E15",
          with_ctes(*PREP_CTES) + "\nUNION ALL\n".join(
              f"SELECT split, label, '{c}' AS feature, round(avg(least(1, greatest(0, ({c} - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END))), 6) AS mean "
              f"FROM prep, (SELECT min({c}) AS lo, max({c}) AS hi FROM prep) GROUP BY split, label"
              for c in FEATURES))
def per_class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the min-max normalised features per split and class."""
    p = prepared(spark, sf_dir)
    p = feat.apply_minmax(p, FEATURES, feat.fit_minmax_struct(p, FEATURES))
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.avg(f"{c}_norm"), 6).alias("mean")) for c in FEATURES])
    return p.groupBy("split", "label").agg(arr.alias("_a")).select("split", "label", F.inline("_a"))
