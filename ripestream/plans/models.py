"""Scoring and evaluation queries on the feature-vector proxy (embeddings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripestream.functions import nn
from ripestream.operators import evaluate as ev
from ripestream.operators import features as feat
from ripestream.plans.registry import register
from ripestream.sources import proxy

X = [f"f{i}" for i in range(proxy.N_FEATURES)]
K = proxy.N_CLASSES
WEIGHTS = nn.formula_weights()
WEIGHTS_B = nn.formula_weights(0.9)  # a second scorer to compare with


def scored(spark: SparkSession, sf_dir: str, flat=WEIGHTS, pred: str = "pred") -> DataFrame:
    """Feature vectors -> min-max scaled (fitted on all rows) -> class + probabilities."""
    fv = proxy.feature_vectors(proxy.table(spark, sf_dir, "embeddings"))
    # Fitted params: one scalar subquery attached once as a struct column.
    fvp = fv.withColumn("_p", feat.fit_minmax_struct(fv, X))
    xs = [feat.minmax_scale(F.col(c), F.col(f"_p.{c}_min"), F.col(f"_p.{c}_range")) for c in X]
    xn = fvp.select("id", "label", *[v.alias(f"x{i}") for i, v in enumerate(xs)])
    xcols = [F.col(f"x{i}") for i in range(proxy.N_FEATURES)]
    z = nn.forward(xn, [f"x{i}" for i in range(proxy.N_FEATURES)], flat)
    zc = [F.col(f"z{k}") for k in range(K)]
    any_null = F.lit(False)
    for c in xcols:
        any_null = any_null | c.isNull()
    probs = nn.softmax(zc)
    return z.select("id", "label", F.when(any_null, F.lit(nn.UNKNOWN_CLASS)).otherwise(nn.argmax(zc)).alias(pred),
                    *[F.when(~any_null, p).alias(f"p{k}") for k, p in enumerate(probs)])


def sql_scores(flat, keys: str) -> str:
    """CTEs from ``xn`` (keys, x list) to ``lg`` (keys, z list): dot products over the flat weight list by its layout."""
    h, o = nn.N_IN * nn.N_HIDDEN, nn.N_IN * nn.N_HIDDEN + nn.N_HIDDEN
    return f"""wt AS (SELECT {[float(v) for v in flat]} AS w),
hd AS (SELECT {keys}, w, [greatest(0.0, list_dot_product(x, [w[i * {nn.N_HIDDEN} + j + 1] FOR i IN range({nn.N_IN})]) + w[{h} + j + 1]) FOR j IN range({nn.N_HIDDEN})] AS h FROM xn, wt),
lg AS (SELECT {keys}, [list_dot_product(h, [w[{o} + j * {nn.N_OUT} + k + 1] FOR j IN range({nn.N_HIDDEN})]) + w[{o + nn.N_HIDDEN * nn.N_OUT} + k + 1] FOR k IN range({nn.N_OUT})] AS z FROM hd)"""


def _sql_scored(flat, pred: str = "pred") -> str:
    mm = ", ".join(f"min(f{i}) AS mn{i}, CASE WHEN max(f{i}) - min(f{i}) = 0 THEN 1.0 ELSE max(f{i}) - min(f{i}) END AS rg{i}"
                   for i in range(proxy.N_FEATURES))
    xn = ", ".join(f"CASE WHEN (f{i} - mn{i}) / rg{i} < 0 THEN 0.0 WHEN (f{i} - mn{i}) / rg{i} > 1 THEN 1.0 "
                   f"ELSE (f{i} - mn{i}) / rg{i} END AS x{i}" for i in range(proxy.N_FEATURES))
    return f"""WITH {proxy.SQL_FEATURES},
mm AS (SELECT {mm} FROM fv),
xc AS (SELECT id, label, {xn} FROM fv, mm),
xn AS (SELECT id, label, [{", ".join(f"x{i}" for i in range(proxy.N_FEATURES))}] AS x FROM xc),
{sql_scores(flat, "id, label")},
lz AS (SELECT id, label, z[1] AS z0, z[2] AS z1, z[3] AS z2 FROM lg),
ex AS (SELECT id, label, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS {pred},
              exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1,
              exp(z2 - greatest(z0, z1, z2)) AS e2 FROM lz),
sc AS (SELECT id, label, {pred}, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM ex)
"""


SQL_SCORED = _sql_scored(WEIGHTS)


@register("mlp_score", "I3 C10 A16 M11",
          SQL_SCORED + "SELECT id, label, pred, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM sc")
def mlp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select("id", "label", "pred", *[F.round(f"p{k}", 6).alias(f"p{k}") for k in range(K)])


@register("ce_loss", "C11 E33",
          SQL_SCORED + """, l AS (SELECT label, -ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 END + 1e-7) AS loss FROM sc)
SELECT CAST(label AS VARCHAR) AS scope, count(*) AS n, round(avg(loss), 6) AS mean_loss FROM l GROUP BY label
UNION ALL SELECT 'all', count(*), round(avg(loss), 6) FROM l""")
def ce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of the true class, mean per class and overall (the epoch loss)."""
    s = scored(spark, sf_dir)
    l = s.select("label", nn.cross_entropy([F.col(f"p{k}") for k in range(K)], F.col("label")).alias("loss"))
    per = l.groupBy(F.col("label").cast("string").alias("scope")).agg(F.count(F.lit(1)).alias("n"),
                                                                       F.round(F.avg("loss"), 6).alias("mean_loss"))
    tot = l.agg(F.lit("all").alias("scope"), F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("mean_loss"))
    return per.unionByName(tot)


@register("confusion", "E17 D6",
          SQL_SCORED + """, grid AS (SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted FROM range(0, 3) t(a), range(0, 3) u(p))
SELECT g.actual, g.predicted, count(sc.id) AS n FROM grid g LEFT JOIN sc ON sc.label = g.actual AND sc.pred = g.predicted
GROUP BY ALL""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(scored(spark, sf_dir), "label", "pred", K)


_SQL_CONF = SQL_SCORED + """, grid AS (SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted FROM range(0, 3) t(a), range(0, 3) u(p)),
conf AS (SELECT g.actual, g.predicted, count(sc.id) AS n FROM grid g LEFT JOIN sc ON sc.label = g.actual AND sc.pred = g.predicted GROUP BY ALL),
per AS (SELECT actual AS class, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp, sum(n) AS support FROM conf GROUP BY 1),
pr AS (SELECT predicted AS class, sum(n) AS n_predicted FROM conf GROUP BY 1),
m AS (SELECT class, CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, CAST(n_predicted AS BIGINT) AS n_predicted,
             tp / greatest(n_predicted, 1) AS precision, tp / greatest(support, 1) AS recall FROM per JOIN pr USING (class))
"""


@register("class_metrics", "E18",
          _SQL_CONF + """SELECT class, tp, support, n_predicted, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(2 * precision * recall / greatest(precision + recall, 1e-9), 6) AS f1 FROM m""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.class_metrics(ev.confusion(scored(spark, sf_dir), "label", "pred", K))
    return m.select("class", "tp", "support", "n_predicted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("accuracy_report", "E19",
          _SQL_CONF + """, f AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-9) AS f1 FROM m)
SELECT 'all' AS scope, (SELECT count(*) FROM sc) AS n, round((SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) FROM sc), 6) AS accuracy,
       round((SELECT avg(f1) FROM f), 6) AS macro_f1
UNION ALL SELECT CAST(class AS VARCHAR), support, round(recall, 6), NULL FROM f WHERE support > 0""")
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ev.accuracy_report(scored(spark, sf_dir), "label", "pred", K)
    return r.select("scope", "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@register("class_weights", "E16",
          f"WITH {proxy.SQL_FEATURES}" + """, c AS (SELECT label AS class, count(*) AS n FROM fv GROUP BY 1),
grid AS (SELECT CAST(i AS INTEGER) AS class FROM range(0, 3) t(i))
SELECT g.class, COALESCE(c.n, 0) AS n, round((SELECT count(*) FROM fv) / (3 * greatest(COALESCE(c.n, 0), 1)), 6) AS weight
FROM grid g LEFT JOIN c USING (class)""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    fv = proxy.feature_vectors(proxy.table(spark, sf_dir, "embeddings"))
    w = ev.class_weights(fv, "label", K)
    return w.select("class", "n", F.round("weight", 6).alias("weight"))


@register("scorer_compare", "E28 I7",
          f"""SELECT count(*) AS n, round(avg(CASE WHEN a.pred = a.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy_a,
       round(avg(CASE WHEN b.pred_b = a.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy_b,
       round(avg(CASE WHEN a.pred = b.pred_b THEN 1.0 ELSE 0.0 END), 6) AS agreement,
       round(100 * (avg(CASE WHEN b.pred_b = a.label THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN a.pred = a.label THEN 1.0 ELSE 0.0 END)), 6) AS gain_points
FROM ({SQL_SCORED} SELECT id, label, pred FROM sc) a JOIN ({_sql_scored(WEIGHTS_B, "pred_b")} SELECT id, pred_b FROM sc) b USING (id)""")
def scorer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of weights on the same rows: accuracies, agreement, gain in points."""
    a = scored(spark, sf_dir, WEIGHTS, "pred")
    b = scored(spark, sf_dir, WEIGHTS_B, "pred_b").select("id", "pred_b")
    c = ev.scorer_compare(a.join(b, "id"), "label", "pred", "pred_b")
    return c.select("n", *[F.round(x, 6).alias(x) for x in ("accuracy_a", "accuracy_b", "agreement", "gain_points")])


@register("confusion_labels", "E17 E18 D6",
          """WITH p AS (SELECT quality AS actual, 1 - toxic AS predicted FROM labels),
grid AS (SELECT CAST(a AS INTEGER) AS actual, CAST(b AS INTEGER) AS predicted FROM range(0, 2) t(a), range(0, 2) u(b))
SELECT g.actual, g.predicted, count(p.actual) AS n FROM grid g LEFT JOIN p USING (actual, predicted) GROUP BY ALL""")
def confusion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth/prediction pairs from ``labels``: quality vs (not toxic), 2×2 grid with zero cells."""
    lab = proxy.table(spark, sf_dir, "labels").select(F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("predicted"))
    return ev.confusion(lab, "actual", "predicted", 2)


@register("decoded_predictions", "B7 C18",
          SQL_SCORED + """SELECT id, pred, CASE pred WHEN 255 THEN 'unknown' WHEN 0 THEN 'Fresh' WHEN 1 THEN 'Aging'
       WHEN 2 THEN 'Degraded' END AS pred_label,
       CASE label WHEN 0 THEN 'Fresh' WHEN 1 THEN 'Aging' WHEN 2 THEN 'Degraded' END AS true_label FROM sc""")
def decoded_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class codes back to text; the serving code 255 reads 'unknown'."""
    from ripestream.functions.zones import decode_label

    s = scored(spark, sf_dir)
    return s.select("id", "pred", decode_label(F.col("pred")).alias("pred_label"), decode_label(F.col("label")).alias("true_label"))
