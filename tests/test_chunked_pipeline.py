"""The bucketed plans give the same rows as textbook single-window plans on real data,
with tiny buckets and blocks so every halo / carry path is exercised."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ripestream.operators import asof, labeling
from ripestream.sources import proxy

from table_paths import SF01

HOUR_US = 3_600_000_000


@pytest.fixture()
def tiny_blocks(spark):
    spark.conf.set("ripestream.blockRows", "3")
    yield
    spark.conf.unset("ripestream.blockRows")


def plain_labels(spec):
    """The labelling chain with one window per batch."""
    w = Window.partitionBy("batch").orderBy("ts", "id")
    med = spec.groupBy("batch").agg(F.median("clear").alias("clear_median"))
    lit = F.when(F.col("clear_median") == 0, F.lit(False)).otherwise(F.col("clear") > 1.6 * F.col("clear_median"))
    s = spec.join(med, "batch").withColumn("lit", F.coalesce(lit, F.lit(False)))
    s = s.withColumn("nir_smooth", F.avg(F.when(~F.col("lit"), F.col("nir"))).over(w.rowsBetween(-3, 3)))
    ok = s.where("nir_smooth is not null")
    edge = lambda o: ok.withColumn("p", F.row_number().over(Window.partitionBy("batch").orderBy(*o))).where("p <= 3")
    first = edge([F.col("ts"), F.col("id")]).groupBy("batch").agg(F.avg("nir_smooth").alias("f3"))
    last = edge([F.col("ts").desc(), F.col("id").desc()]).groupBy("batch").agg(F.avg("nir_smooth").alias("l3"))
    z = ok.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("nir_smooth").alias("lo"), F.max("nir_smooth").alias("hi")).join(first, "batch").join(last, "batch")
    z = z.where("n >= 4 and hi > lo").select("batch", F.when(F.col("l3") > F.col("f3"), 1).otherwise(-1).alias("dir"),
                                             (F.col("lo") + (F.col("hi") - F.col("lo")) / 3).alias("b1"), (F.col("lo") + 2 * (F.col("hi") - F.col("lo")) / 3).alias("b2"))
    s = s.join(z, "batch", "left")
    zone = lambda below: F.when(below(F.col("nir_smooth"), F.col("b1")), "Fresh").when(below(F.col("nir_smooth"), F.col("b2")), "Aging").otherwise("Degraded")
    raw = F.when(F.col("lit") | F.col("dir").isNull() | F.col("nir_smooth").isNull(), None).when(F.col("dir") > 0, zone(lambda a, b: a < b)).otherwise(zone(lambda a, b: a > b))
    s = s.withColumn("raw_label", raw)
    return s.withColumn("nir_label", F.last("raw_label", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def test_labelling_and_asof_equal_plain(spark, tiny_blocks):
    ev = proxy.table(spark, SF01, "events")
    spec = proxy.spectral_feed(ev)
    plain = plain_labels(spec)
    chunk = labeling.label_spectral(spec, width=HOUR_US)
    cols = ["id", F.round("nir_smooth", 9).alias("s"), "lit", "raw_label", "nir_label"]
    assert chunk.count() == plain.count()
    assert plain.select(*cols).exceptAll(chunk.select(*cols)).count() == 0
    sensor = proxy.sensor_feed(ev)
    got = asof.asof_backward(sensor, plain, "batch", "ts", ["nir_label"], width=HOUR_US)
    both = sensor.select("batch", "id", "ts", F.lit(1).alias("side"), F.lit(None).cast("struct<l:string>").alias("r")).unionByName(
        plain.select("batch", "id", "ts", F.lit(0).alias("side"), F.struct(F.col("nir_label").alias("l")).alias("r")))
    w = Window.partitionBy("batch").orderBy("ts", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = both.withColumn("f", F.last("r", ignorenulls=True).over(w)).where("side = 1").select("id", F.col("f.l").alias("nir_label"))
    assert got.count() == want.count()
    assert want.exceptAll(got.select("id", "nir_label")).count() == 0


def test_nearest_forward_and_backward(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    right = spark.createDataFrame([(0, 1, t + timedelta(minutes=10), 1.0), (0, 2, t + timedelta(minutes=20), 2.0)],
                                  "k int, id long, ts timestamp_ntz, v double")
    left = spark.createDataFrame([(0, 10, t), (0, 11, t + timedelta(minutes=14)), (0, 12, t + timedelta(minutes=15)),
                                  (0, 13, t + timedelta(minutes=30))], "k int, id long, ts timestamp_ntz")
    for width in (None, 60_000_000):
        n = {r["id"]: (r["v"], r["gap_seconds"]) for r in asof.nearest(left, right, "k", "ts", ["v"], width=width).collect()}
        # 15 minutes is a tie between 10 and 20 -> the earlier reading
        assert n == {10: (1.0, 600.0), 11: (1.0, 240.0), 12: (1.0, 300.0), 13: (2.0, 600.0)}
