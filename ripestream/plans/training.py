"""Validation split, fold table and training queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripestream.functions import nn
from ripestream.operators import devices as dv
from ripestream.operators import evaluate as ev
from ripestream.operators import features as feat
from ripestream.operators import folds as fo
from ripestream.operators import minibatch as mb
from ripestream.operators import models as md
from ripestream.plans.features import _FIT_SQL, FEATURES, PREP_CTES, prepared
from ripestream.plans.models import SQL_SCORED, WEIGHTS, X
from ripestream.plans.registry import register, with_ctes
from ripestream.sources import proxy


def _named(p: DataFrame) -> DataFrame:
    return p.withColumn("batch_name", F.concat(F.lit("batch"), F.col("batch").cast("string")))


@register("val_split", "I1 G4",
          with_ctes(*PREP_CTES) + """
, tr AS (SELECT 'batch' || CAST(batch AS VARCHAR) AS batch_name FROM prep WHERE split = 'train')
SELECT batch_name, CASE WHEN batch_name = (SELECT max(batch_name) FROM tr) THEN 'val' ELSE 'fit' END AS role,
       count(*) AS n_rows FROM tr GROUP BY batch_name""")
def val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold out the lexically last training batch for validation."""
    tr = _named(prepared(spark, sf_dir).where(F.col("split") == "train"))
    s = md.validation_split(tr, "batch_name", "cycle_number")
    return s.groupBy("batch_name", "role").agg(F.count(F.lit(1)).alias("n_rows"))


@register("lobo_folds", "I2",
          with_ctes(*PREP_CTES) + """
, tr AS (SELECT 'batch' || CAST(batch AS VARCHAR) AS batch_name FROM prep WHERE split = 'train')
SELECT batch_name AS fold, count(*) AS n_test, (SELECT count(*) FROM tr) - count(*) AS n_train FROM tr GROUP BY 1""")
def lobo_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-batch-out folds: one row per fold with its test and train sizes (no batch × fold pairs)."""
    tr = _named(prepared(spark, sf_dir).where(F.col("split") == "train"))
    total = tr.agg(F.count(F.lit(1))).scalar()
    return tr.groupBy(F.col("batch_name").alias("fold")).agg(F.count(F.lit(1)).alias("n_test")).withColumn(
        "n_train", total - F.col("n_test"))


_DIST = " + ".join(f"(x{i} - c.c{i}) * (x{i} - c.c{i})" for i in range(len(FEATURES)))


@register("lobo_scores", "I2 E19",
          with_ctes(*PREP_CTES) + f"""
, fit AS (SELECT {", ".join(f"min({c}) AS mn{i}, CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE max({c}) - min({c}) END AS rg{i}" for i, c in enumerate(FEATURES))} FROM prep),
tr AS (SELECT 'batch' || CAST(batch AS VARCHAR) AS fold, cycle_number, label, {", ".join(f"least(1, greatest(0, ({c} - mn{i}) / rg{i})) AS x{i}" for i, c in enumerate(FEATURES))}
       FROM prep, fit WHERE split = 'train'),
f AS (SELECT DISTINCT fold FROM tr),
c AS (SELECT f.fold, tr.label, {", ".join(f"avg(x{i}) AS c{i}" for i in range(len(FEATURES)))} FROM f JOIN tr ON tr.fold <> f.fold GROUP BY ALL),
d AS (SELECT tr.fold, tr.cycle_number, tr.label, c.label AS pred, round({_DIST}, 9) AS dist FROM tr JOIN c ON c.fold = tr.fold),
b AS (SELECT fold, cycle_number, any_value(label) AS label, arg_min(pred, (dist, pred)) AS pred FROM d GROUP BY ALL),
k AS (SELECT fold, g.i AS class, count(*) FILTER (WHERE label = g.i AND pred = g.i) AS tp, count(*) FILTER (WHERE label = g.i) AS support, count(*) FILTER (WHERE pred = g.i) AS guessed
      FROM b, range(0, 3) g(i) GROUP BY ALL)
SELECT fold, CAST(sum(support) AS BIGINT) AS n_test, round(sum(tp) / sum(support), 6) AS accuracy,
       round(avg(CASE WHEN support + guessed > 0 THEN 2.0 * tp / (support + guessed) ELSE 0 END), 6) AS macro_f1 FROM k GROUP BY fold""")
def lobo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-batch-out accuracy and F1 of a nearest-centroid classifier on the scaled features.

    All folds in one pass: a fold's centroids are the totals less the fold's own
    sums, so no training set is built per fold.
    """
    p = prepared(spark, sf_dir)
    k = len(FEATURES)
    scaled = _named(feat.apply_minmax(p, FEATURES, feat.fit_minmax_struct(p, FEATURES)).where(F.col("split") == "train"))
    tr = scaled.select(F.col("batch_name").alias("fold"), "label", *[F.col(f"{c}_norm").alias(f"x{i}") for i, c in enumerate(FEATURES)])
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(k)]
    own = tr.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"), *sums)
    total = own.groupBy("label").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    cell = lambda d, c: F.coalesce(F.max(F.when(F.col("label") == c, F.col(d))), F.lit(0.0))
    wide = own.groupBy("fold").agg(*[cell(f"s{i}", c).alias(f"f{c}_{i}") for c in range(3) for i in range(k)], *[cell("n", c).alias(f"f{c}_n") for c in range(3)])
    tot = total.agg(F.struct(*[cell(f"s{i}", c).alias(f"t{c}_{i}") for c in range(3) for i in range(k)], *[cell("n", c).alias(f"t{c}_n") for c in range(3)])).scalar()
    left = wide.withColumn("t", tot).select("fold", *[((F.col(f"t.t{c}_{i}") - F.col(f"f{c}_{i}")) / F.nullif(F.col(f"t.t{c}_n") - F.col(f"f{c}_n"), F.lit(0.0))).alias(f"c{c}_{i}") for c in range(3) for i in range(k)])
    j = tr.join(left, "fold")
    dist = [F.round(sum(((F.col(f"x{i}") - F.col(f"c{c}_{i}")) ** 2 for i in range(k)), F.lit(0.0)), 9) for c in range(3)]
    nearest = F.array_min(F.array(*[F.when(d.isNotNull(), F.struct(d.alias("d"), F.lit(c).alias("c"))) for c, d in enumerate(dist)])).getField("c")
    b = j.select("fold", "label", nearest.alias("pred"))
    hits = lambda c: (F.count_if((F.col("label") == c) & (F.col("pred") == c)), F.count_if(F.col("label") == c) + F.count_if(F.col("pred") == c))
    f1 = sum((F.coalesce(2.0 * tp / F.nullif(both, F.lit(0)), F.lit(0.0)) for tp, both in map(hits, range(3))), F.lit(0.0)) / 3
    return b.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 6).alias("accuracy"), F.round(f1, 6).alias("macro_f1"))


def _train_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with role (I1) and class weight (E16) attached; scaled features."""
    p = prepared(spark, sf_dir)
    params = feat.fit_minmax_struct(p, FEATURES)
    scaled = feat.apply_minmax(p, FEATURES, params)
    tr = _named(scaled.where(F.col("split") == "train"))
    tr = md.validation_split(tr, "batch_name", "cycle_number")
    cw = ev.class_weights(tr.where(F.col("role") == "fit"), "label", 3).select(F.col("class").alias("label"), "weight")
    return tr.join(cw, "label", "left")


@register("train_classifier", "I4 I1 E16")
def train_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train the 6 -> 16 -> 3 network on the training split; one log row per epoch."""
    tr = _train_set(spark, sf_dir)
    _, log = md.train_mlp(tr, [c + "_norm" for c in FEATURES], "label", role="role", weight="weight",
                          n_hidden=16, n_out=3, epochs=200, patience=20)
    return spark.createDataFrame(log, "epoch int, loss double, fit_acc double, val_acc double")


def _held_and_test(spark: SparkSession, sf_dir: str):
    fv = proxy.feature_vectors(proxy.table(spark, sf_dir, "embeddings"))
    params = feat.fit_minmax_struct(fv, X)
    xs = fv.select("id", "label", *[feat.minmax_scale(F.col(c), params.getField(f"{c}_min"), params.getField(f"{c}_range"))
                                    .alias(c) for c in X])
    return xs.where(F.col("id") % 2 == 0), xs.where(F.col("id") % 2 != 0)


@register("finetune_head", "I5 I7 E28 E16")
def finetune_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine-tune the output layer on the held half, evaluate before / after on the other half."""
    held, test = _held_and_test(spark, sf_dir)
    cw = ev.class_weights(held, "label", 3, guard=False).select(F.col("class").alias("label"), "weight")
    held = held.join(cw, "label", "left")
    base = md.Net.from_flat(WEIGHTS, nn.N_IN, nn.N_HIDDEN, nn.N_OUT)
    tuned, log = md.finetune_head(held, X, "label", base, weight="weight", epochs=10)
    before = md.score_net(test, X, base, "pred_before")
    after = md.score_net(before, X, tuned, "pred_after")
    cmp = ev.scorer_compare(after, "label", "pred_before", "pred_after")
    logdf = spark.createDataFrame(log, "epoch int, loss double, fit_acc double")
    return (logdf.withColumn("accuracy_before", cmp.select("accuracy_a").scalar())
            .withColumn("accuracy_after", cmp.select("accuracy_b").scalar()))


@register("finetune_start", "I5 I7 E19 E33",
          SQL_SCORED + """, h AS (SELECT *, -ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END + 1e-7) AS loss FROM sc WHERE id % 2 = 0)
SELECT 1 AS epoch, round(avg(loss), 6) AS loss, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS fit_acc,
       (SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) FROM sc WHERE id % 2 <> 0) AS accuracy_before FROM h""")
def finetune_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of the fine-tuning log: loss and accuracy of the given weights, before any step, and accuracy on the other half."""
    held, test = _held_and_test(spark, sf_dir)
    base = md.Net.from_flat(WEIGHTS, nn.N_IN, nn.N_HIDDEN, nn.N_OUT)
    _, log = md.finetune_head(held, X, "label", base, epochs=1)
    before = md.score_net(test, X, base, "pred").agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6)).scalar()
    return spark.createDataFrame(log, "epoch int, loss double, fit_acc double").select("epoch", F.round("loss", 6).alias("loss"), F.round("fit_acc", 6).alias("fit_acc"), before.alias("accuracy_before"))


@register("backbone_eval", "I6 E17 E19")
def backbone_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak backbone: train on one training batch only, evaluate on the held split (confusion grid)."""
    return _backbone(spark, sf_dir, epochs=50)


def _backbone(spark: SparkSession, sf_dir: str, epochs: int) -> DataFrame:
    scaled = _named(_scaled(spark, sf_dir))
    first = scaled.where(F.col("split") == "train").agg(F.min("batch_name")).scalar()
    fit = scaled.where(F.col("batch_name") == first).withColumn("role", F.lit("fit"))
    val = scaled.where(F.col("split") == "held").withColumn("role", F.lit("val"))
    net, _ = md.train_mlp(fit.unionByName(val), NORM, "label", role="role", epochs=epochs, patience=10)
    return ev.confusion(md.score_net(val, NORM, net), "label", "pred", CLASSES)


# ------------------------------------------------ networks on the scaled features
HIDDEN, CLASSES = 16, 3
NORM = [f"{c}_norm" for c in FEATURES]
_CUT = [len(FEATURES) * HIDDEN, len(FEATURES) * HIDDEN + HIDDEN, len(FEATURES) * HIDDEN + HIDDEN + HIDDEN * CLASSES]
#: The network that devices start from.
DEVICE_WEIGHTS = nn.formula_weights(0.3, _CUT[2] + CLASSES)

_CLIPPED = ", ".join(f"least(1.0, greatest(0.0, ({c} - mn_{i}) / rg_{i}))" for i, c in enumerate(FEATURES))
#: All prepared rows with scaled features as a list.
SQL_XS = f"""fit AS (SELECT {_FIT_SQL} FROM prep),
xs AS (SELECT batch, cycle_number AS id, split, label AS y, [{_CLIPPED}] AS x FROM prep, fit)"""


def sql_hidden(flat, keys: str = "batch, id, split, y") -> str:
    """CTE ``hd``: hidden features of ``xs`` with a one behind them."""
    return f"""wt AS (SELECT {[float(v) for v in flat]} AS w),
hd AS (SELECT {keys}, list_concat([greatest(0.0, list_dot_product(x, [w[i * {HIDDEN} + j + 1] FOR i IN range({len(FEATURES)})]) + w[{_CUT[0]} + j + 1]) FOR j IN range({HIDDEN})], [1.0]) AS h FROM xs, wt)"""


def sql_heads(flat) -> list[str]:
    """The output layer as one list literal a class, bias last."""
    return [str([float(flat[_CUT[1] + j * CLASSES + k]) for j in range(HIDDEN)] + [float(flat[_CUT[2] + k])]) + "::DOUBLE[]" for k in range(CLASSES)]


def sql_probs(source: str, heads=("w0", "w1", "w2")) -> str:
    """``source`` (h, y) with p0..p2, the loss and whether the guess was right, for the heads."""
    z = ", ".join(f"list_dot_product(h, {w}) AS z{k}" for k, w in enumerate(heads))
    e = ", ".join(f"exp(z{k} - greatest(z0, z1, z2)) AS e{k}" for k in range(CLASSES))
    p = ", ".join(f"e{k} / (e0 + e1 + e2) AS p{k}" for k in range(CLASSES))
    return f"""(SELECT *, -ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END + 1e-7) AS l, (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = y)::INTEGER AS ok
 FROM (SELECT *, {p} FROM (SELECT *, {e} FROM (SELECT *, {z} FROM {source}))))"""


def sql_walk(steps: str, lr: float, flat=DEVICE_WEIGHTS) -> str:
    """CTE ``run``: the output layer of each batch after each of its ``steps`` (batch, s from 1, e, h, y, cw), one step a sample."""
    step = ", ".join(f"[w{k}[i] - {lr!r} * cw * (p{k} - (y = {k})::INTEGER) * h[i] FOR i IN range(1, {HIDDEN + 2})]" for k in range(CLASSES))
    return f"""run(batch, s, w0, w1, w2, e, loss, hit) AS (
  SELECT DISTINCT batch, CAST(0 AS BIGINT), {", ".join(sql_heads(flat))}, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), 0 FROM hd
  UNION ALL
  SELECT batch, s, {step}, e, l, ok FROM {sql_probs(f"(SELECT r.batch, t.s, t.e, t.h, t.y, t.cw, r.w0, r.w1, r.w2 FROM run r JOIN {steps} t ON t.batch = r.batch AND t.s = r.s + 1)")})"""


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return feat.apply_minmax(p, FEATURES, feat.fit_minmax_struct(p, FEATURES))


DEVICE_EPOCHS, DEVICE_LR = 10, 0.001
_LAST = ", ".join(f"round(list_sum(w{k}), 6) AS w{k}_sum, round(w{k}[{HIDDEN + 1}], 6) AS b{k}" for k in range(CLASSES))


@register("finetune_devices", "I5 I7 E16 E33 C11",
          "WITH RECURSIVE " + ",\n".join([*PREP_CTES, SQL_XS, sql_hidden(DEVICE_WEIGHTS)]) + f""",
cw AS (SELECT batch, y, sum(count(*)) OVER (PARTITION BY batch) / ({CLASSES} * count(*)) AS cw FROM hd WHERE id % 2 = 0 GROUP BY batch, y),
st AS (SELECT hd.batch, row_number() OVER (PARTITION BY hd.batch ORDER BY e, left(md5('42:' || e || ':' || id), 15), id) AS s, e, h, y, cw
       FROM hd JOIN cw USING (batch, y), range(1, {DEVICE_EPOCHS + 1}) t(e) WHERE id % 2 = 0),
{sql_walk("st", DEVICE_LR)},
ep AS (SELECT batch, count(*) FILTER (WHERE e = 1) AS n_fit, round(avg(loss) FILTER (WHERE e = 1), 6) AS loss_first, round(avg(loss) FILTER (WHERE e = {DEVICE_EPOCHS}), 6) AS loss_last,
              round(avg(hit) FILTER (WHERE e = {DEVICE_EPOCHS}), 6) AS fit_acc_last FROM run GROUP BY batch),
fin AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY batch ORDER BY s DESC) = 1),
b AS (SELECT batch, count(*) AS n_eval, round(avg(ok), 6) AS accuracy_before FROM {sql_probs("hd", sql_heads(DEVICE_WEIGHTS))} WHERE id % 2 <> 0 GROUP BY batch),
a AS (SELECT batch, round(avg(ok), 6) AS accuracy_after FROM {sql_probs("(SELECT hd.*, w0, w1, w2 FROM hd JOIN fin USING (batch))")} WHERE id % 2 <> 0 GROUP BY batch)
SELECT batch, n_fit, coalesce(n_eval, 0) AS n_eval, loss_first, loss_last, fit_acc_last, accuracy_before, accuracy_after, {_LAST}
FROM fin JOIN ep USING (batch) LEFT JOIN b USING (batch) LEFT JOIN a USING (batch)""")
def finetune_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every device's own output layer after ten epochs of single steps on its even cycles, scored on its odd ones."""
    net = md.Net.from_flat(DEVICE_WEIGHTS, len(FEATURES), HIDDEN, CLASSES)
    tuned = dv.tune_devices(_scaled(spark, sf_dir), "batch", "cycle_number", NORM, "label", net, fit=F.col("cycle_number") % 2 == 0, epochs=DEVICE_EPOCHS, lr=DEVICE_LR)
    at = lambda k: F.col("weights")[HIDDEN * CLASSES + k]
    total = lambda k: F.aggregate(F.filter("weights", lambda x, i: i % CLASSES == k), F.lit(0.0), lambda s, x: s + x)
    r = lambda c, name: F.round(c, 6).alias(name)
    return tuned.select(F.col("device").alias("batch"), "n_fit", "n_eval", r(F.get("losses", F.lit(0)), "loss_first"), r(F.get("losses", F.lit(DEVICE_EPOCHS - 1)), "loss_last"),
                        r(F.get("accuracies", F.lit(DEVICE_EPOCHS - 1)), "fit_acc_last"), r("before", "accuracy_before"), r("after", "accuracy_after"),
                        *[c for k in range(CLASSES) for c in (r(total(k), f"w{k}_sum"), r(at(k), f"b{k}"))])


# ---------------------------------------------------------------- I4: mini-batches
GLOROT = md.Net.glorot(len(FEATURES), HIDDEN, CLASSES, 42).flat()
_SQL_TRAIN = f""", tr AS (SELECT hd.*, CASE WHEN 'batch' || batch = (SELECT max('batch' || batch) FROM hd WHERE split = 'train') THEN 'val' ELSE 'fit' END AS role FROM hd WHERE split = 'train'),
sc AS (SELECT * FROM {sql_probs("tr", sql_heads(GLOROT))})"""


@register("train_minibatch", "I4 I1 E16 G4")
def train_minibatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train the 6 -> 16 -> 3 network on mini-batches of 32; one log row per epoch, line 0 before any step."""
    _, log = _minibatch(spark, sf_dir, epochs=40)
    return spark.createDataFrame(log, "epoch int, loss double, fit_acc double, val_acc double")


def _minibatch(spark: SparkSession, sf_dir: str, epochs: int) -> tuple[md.Net, list[tuple]]:
    return mb.train_minibatch(_train_set(spark, sf_dir).withColumn("_id", F.struct("batch", "cycle_number").cast("string")), NORM, "label", "_id", weight="weight", epochs=epochs, lr=0.005)


@register("train_start", "I4 E16 E33 E19",
          with_ctes(*PREP_CTES, SQL_XS, sql_hidden(GLOROT)) + _SQL_TRAIN + f""",
n AS (SELECT y, count(*) AS n FROM tr WHERE role = 'fit' GROUP BY y),
cw AS (SELECT {", ".join(f"round((SELECT sum(n) FROM n) / ({CLASSES} * greatest(coalesce((SELECT n FROM n WHERE y = {k}), 0), 1)), 6) AS weight{k}" for k in range(CLASSES))})
SELECT 0 AS epoch, round(avg(l) FILTER (WHERE role = 'fit'), 6) AS loss, round(avg(ok) FILTER (WHERE role = 'fit'), 6) AS fit_acc, round(avg(ok) FILTER (WHERE role = 'val'), 6) AS val_acc,
       any_value(weight0) AS weight0, any_value(weight1) AS weight1, any_value(weight2) AS weight2 FROM sc, cw""")
def train_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line 0 of the mini-batch log (losses and accuracies of the starting weights) and the class weights."""
    _, log = _minibatch(spark, sf_dir, epochs=0)
    fit = _train_set(spark, sf_dir).where("role = 'fit'")
    weight = {r["class"]: r["weight"] for r in ev.class_weights(fit, "label", CLASSES).collect()}
    line = spark.createDataFrame(log[:1], "epoch int, loss double, fit_acc double, val_acc double")
    return line.select("epoch", *[F.round(c, 6).alias(c) for c in ("loss", "fit_acc", "val_acc")], *[F.round(F.lit(weight[k]), 6).alias(f"weight{k}") for k in range(CLASSES)])


# ------------------------------------------------- I2: one trained network a fold
_FOLD_SQL = "'g' || (batch % 16)"


def _fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with their fold: batches dealt into groups by the last hexadecimal digit of their number."""
    return _scaled(spark, sf_dir).where("split = 'train'").withColumn("fold", F.concat(F.lit("g"), (F.col("batch") % 16).cast("string")))


@register("lobo_trained", "I2 E18 E19")
def lobo_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-group-out scores: a network for each fold, trained on the other folds, all in one pass an epoch."""
    got = fo.train_folds(_fold_rows(spark, sf_dir), NORM, "label", "fold", epochs=40)
    return spark.createDataFrame([(r.fold, r.n_train, r.n_test, r.loss, r.accuracy, r.macro_f1) for r in got], "fold string, n_train long, n_test long, loss double, accuracy double, macro_f1 double")


@register("lobo_start", "I2 E18 E19 E33",
          with_ctes(*PREP_CTES, SQL_XS, sql_hidden(GLOROT)) + f""", tr AS (SELECT *, {_FOLD_SQL} AS fold FROM hd WHERE split = 'train'),
sc AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM {sql_probs("tr", sql_heads(GLOROT))}),
k AS (SELECT fold, i AS c, count(*) FILTER (WHERE y = i AND pred = i) AS tp, count(*) FILTER (WHERE y = i) AS support, count(*) FILTER (WHERE pred = i) AS guessed FROM sc, range(0, {CLASSES}) t(i) GROUP BY ALL),
f AS (SELECT fold, avg(2 * (tp / greatest(guessed, 1)) * (tp / greatest(support, 1)) / greatest(tp / greatest(guessed, 1) + tp / greatest(support, 1), 1e-9)) AS macro_f1 FROM k GROUP BY fold),
own AS (SELECT fold, count(*) AS n, sum(l) AS l, avg(ok) AS acc FROM sc GROUP BY fold)
SELECT fold, (SELECT count(*) FROM sc) - n AS n_train, n AS n_test, round(((SELECT sum(l) FROM sc) - l) / ((SELECT count(*) FROM sc) - n), 6) AS loss, round(acc, 6) AS accuracy, round(macro_f1, 6) AS macro_f1
FROM own JOIN f USING (fold)""")
def lobo_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds before any step: sizes, training loss and test scores of the starting weights."""
    got = fo.train_folds(_fold_rows(spark, sf_dir), NORM, "label", "fold", epochs=0)
    rows = spark.createDataFrame([(r.fold, r.n_train, r.n_test, r.loss, r.accuracy, r.macro_f1) for r in got], "fold string, n_train long, n_test long, loss double, accuracy double, macro_f1 double")
    return rows.select("fold", "n_train", "n_test", *[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "macro_f1")])


@register("backbone_start", "I6 E17 E19",
          with_ctes(*PREP_CTES, SQL_XS, sql_hidden(GLOROT)) + f""", va AS (SELECT * FROM hd WHERE split = 'held'),
sc AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM {sql_probs("va", sql_heads(GLOROT))}),
grid AS (SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted FROM range(0, {CLASSES}) t(a), range(0, {CLASSES}) u(p))
SELECT g.actual, g.predicted, count(sc.id) AS n FROM grid g LEFT JOIN sc ON sc.y = g.actual AND sc.pred = g.predicted GROUP BY ALL""")
def backbone_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weak backbone's confusion grid on the held split before any step."""
    return _backbone(spark, sf_dir, epochs=0)
