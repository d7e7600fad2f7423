"""Evaluation operators (E16-E19, E28, E33), all grouped aggregates.

Class grids (K×K confusion cells, K classes) come from exploding a sequence
over one aggregated row, so empty cells are kept without driver loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _classes(df: DataFrame, k: int, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name))


def class_weights(df: DataFrame, label: str, k: int, guard: bool = True) -> DataFrame:
    """Inverse-frequency weights N / (K · max(n_c, 1)) per class.

    ``guard=False`` drops the ``max(·, 1)`` (the fine-tune code has none): an
    empty class then gets a NULL weight instead of a division by zero.
    """
    n_total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    j = _classes(df, k, "class").join(counts, "class", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    denom = F.greatest(n, F.lit(1)) if guard else F.nullif(n, F.lit(0))
    return j.select("class", n.alias("n"), (n_total / (F.lit(k) * denom)).alias("weight"))


def confusion(df: DataFrame, actual: str, predicted: str, k: int) -> DataFrame:
    """(actual, predicted, n) for every cell of the K×K grid, rows = actual."""
    cells = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = _classes(df, k, "actual").select("actual", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("predicted"))
    j = grid.join(cells, ["actual", "predicted"], "left")
    return j.select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(conf: DataFrame) -> DataFrame:
    """Per class precision / recall / F1 / support from a confusion grid.

    precision = tp / max(predicted, 1); recall = tp / max(support, 1);
    F1 = 2pr / max(p + r, 1e-9).
    """
    per = conf.groupBy(F.col("actual").alias("class")).agg(
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"))
    pred = conf.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("n_predicted"))
    j = per.join(pred, "class")
    p = F.col("tp") / F.greatest(F.col("n_predicted"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("support"), F.lit(1))
    return j.select("class", F.col("tp").cast("long").alias("tp"), F.col("support").cast("long").alias("support"),
                    F.col("n_predicted").cast("long").alias("n_predicted"), p.alias("precision"), r.alias("recall"),
                    (2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("f1"))


def accuracy_report(df: DataFrame, actual: str, predicted: str, k: int) -> DataFrame:
    """Overall accuracy, macro F1 and per-class accuracy (empty classes skipped) (E19), one row per class + 'all'."""
    m = class_metrics(confusion(df, actual, predicted, k))
    overall = df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"),
                     F.count(F.lit(1)).alias("n"))
    macro = m.agg(F.avg("f1").alias("macro_f1"))
    per = m.where(F.col("support") > 0).select(
        F.col("class").cast("string").alias("scope"), F.col("support").alias("n"), F.col("recall").alias("accuracy"),
        F.lit(None).cast("double").alias("macro_f1"))
    allrow = overall.select(F.lit("all").alias("scope"), "n", "accuracy", macro.select("macro_f1").scalar().alias("macro_f1"))
    return allrow.unionByName(per)


def scorer_compare(df: DataFrame, actual: str, a: str, b: str) -> DataFrame:
    """Accuracy of two scorers, their agreement and the gain in points (E28), one row."""
    acc = lambda c: F.avg((F.col(c) == F.col(actual)).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("n"), acc(a).alias("accuracy_a"), acc(b).alias("accuracy_b"),
                  F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement")).withColumn(
        "gain_points", 100 * (F.col("accuracy_b") - F.col("accuracy_a")))


def training_report(scored: DataFrame, label: str, pred: str, loss: Column, log: list[tuple], class_names: list[str], architecture: str, label_system: str) -> DataFrame:
    """One nested row with what a training run is judged by.

    ``scored`` holds the test rows, ``loss`` their losses, ``log`` the epochs
    (epoch, loss, fit accuracy, validation accuracy).  Per-class metrics are a map
    by class name, the confusion matrix a list of rows (actual) of counts.
    """
    from ripestream.sources.files import keyed_map

    k = len(class_names)
    name = F.element_at(F.array(*[F.lit(c) for c in class_names]), F.col("class") + 1)
    conf = confusion(scored, label, pred, k)
    m = class_metrics(conf)
    cells = conf.groupBy("actual").agg(F.transform(F.array_sort(F.collect_list(F.struct("predicted", "n"))), lambda c: c["n"]).alias("row"))  # k rows of k
    matrix = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("actual", "row"))), lambda c: c["row"]))
    lines = F.lit(None).cast("array<struct<epoch:int,loss:double,fit_acc:double,val_acc:double>>") if not log else F.array(
        *[F.struct(F.lit(int(e)).alias("epoch"), F.lit(float(a)).alias("loss"), F.lit(float(b)).alias("fit_acc"), F.lit(float(c)).alias("val_acc")) for e, a, b, c in log])
    whole = scored.agg(F.avg(loss).alias("test_loss"), F.avg((F.col(label) == F.col(pred)).cast("double")).alias("test_accuracy"))
    return whole.select(F.lit(label_system).alias("label_system"), F.lit(architecture).alias("architecture"), F.lit(max([0, *[int(r[0]) for r in log]])).alias("epochs_trained"), lines.alias("epochs"),
                        "test_loss", "test_accuracy", m.agg(F.avg("f1")).scalar().alias("macro_f1"),
                        keyed_map(m, name, F.struct("precision", "recall", "f1", "support")).scalar().alias("per_class_metrics"), matrix.scalar().alias("confusion_matrix"),
                        F.array(*[F.lit(c) for c in class_names]).alias("class_names"))
