"""Bucketed sequence helpers must agree with single windows; wall-clock arithmetic with the clock on the wall."""

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripestream.functions.clock import from_wall_micros, wall_micros
from ripestream.operators import sequence as seq
from ripestream.operators.stats import exact_quantiles
from ripestream.sources import proxy

from table_paths import SF01


def _events(spark):
    ev = proxy.table(spark, SF01, "events")
    # sparse nulls so ffill has work to do
    return ev.select(
        F.col("user_id").alias("batch"), F.col("event_id").alias("id"), "ts",
        F.when(F.col("event_type") == "view", F.col("value")).alias("v"),
    )


def test_ffill_equals_plain(spark):
    df = _events(spark)
    w = Window.partitionBy("batch").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    a = df.withColumn("f", F.last("v", ignorenulls=True).over(w))
    for width in (3_600_000_000, seq.bucket_width(df, "batch", "ts", rows=3)):
        b = seq.ffill(df, "batch", ["ts", "id"], "v", "f", width=width)
        assert a.select("id", "f").exceptAll(b.select("id", "f")).count() == 0
        assert a.count() == b.count()


def test_position_and_rolling_equal_plain(spark):
    df = _events(spark)
    own = Window.partitionBy("batch")
    p1 = df.withColumn("pos", F.row_number().over(own.orderBy("ts", "id"))).withColumn("n", F.count(F.lit(1)).over(own))
    p2 = seq.with_position(df, "batch", ["ts", "id"], "pos", with_count="n", width=7_200_000_000)
    assert p1.select("id", "pos", "n").exceptAll(p2.select("id", "pos", "n")).count() == 0
    w = Window.partitionBy("batch").orderBy("pos")
    plain = p1.withColumn("m", F.avg("v").over(w.rowsBetween(-3, 3))).withColumn("l", F.lag("v").over(w))
    blocked = seq.rolling(p2, "batch", "pos", {
        "m": lambda ww: F.avg("v").over(ww.rowsBetween(-3, 3)),
        "l": lambda ww: F.lag("v").over(ww),
    }, 3, 3, block=5)
    key = ["id", F.round("m", 9).alias("m"), "l"]
    assert blocked.count() == plain.count()
    assert plain.select(*key).exceptAll(blocked.select(*key)).count() == 0


def test_bucket_width_shrinks_with_density(spark):
    df = _events(spark)
    width = lambda rows: df.limit(1).select(seq.bucket_width(df, "batch", "ts", rows).alias("w")).first().w
    assert width(10**6) == seq.DAY_US and width(1) < seq.DAY_US // 2


def test_wall_clock_differences_across_dst(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Amsterdam")
    try:
        rows = [(datetime(2024, 3, 31, 1, 45),), (datetime(2024, 3, 31, 2, 45),), (datetime(2024, 3, 31, 3, 0),)]
        got = [r.u for r in spark.createDataFrame(rows, "ts timestamp_ntz").select(wall_micros("ts").alias("u")).orderBy("u").collect()]
        assert [(b - a) / 6e7 for a, b in zip(got, got[1:])] == [60.0, 15.0]
        back = spark.createDataFrame(rows, "ts timestamp_ntz").where(from_wall_micros(wall_micros("ts")) == F.col("ts")).count()
        assert back == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_exact_quantiles_with_ties_and_constant_columns(spark):
    base = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, F.lit(50.0)).otherwise((F.col("id") * 7919) % 1000).alias("v"),
                                      F.lit(4.0).alias("c"), F.when(F.col("id") % 5 == 0, F.col("id") / 7).alias("n"))
    probs = [0.0, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    for col in ("v", "c", "n"):
        want = {r.k: r.q for r in base.groupBy("k").agg(F.percentile(col, probs).alias("q")).collect()}
        for accuracy in (10_000, 20):
            df = exact_quantiles(base, ["k"], col, probs, "q", accuracy)
            assert "collect_list" not in df._jdf.queryExecution().toString()
            got = {r.k: r.q for r in df.collect()}
            assert set(got) == set(want)
            assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def _with_nulls(spark):
    """Events with a tenth of the keys and of the times missing, times over several days."""
    ev = _events(spark)
    h = F.pmod(F.xxhash64("id"), F.lit(10))
    return ev.select("id", F.when(h != 1, F.col("batch") % 5).alias("batch"), F.when(h != 2, F.col("ts")).alias("ts"), "v")


def test_null_keys_and_times_are_as_in_plain_windows(spark):
    df = _with_nulls(spark)
    order = ["ts", "id"]
    w = Window.partitionBy("batch").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("batch").orderBy(F.col("ts").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce("v", F.lit(1.0))
    want = df.select("id", F.last("v", ignorenulls=True).over(upto).alias("f"), F.last("v", ignorenulls=True).over(back).alias("b"), F.row_number().over(w).cast("long").alias("p"),
                     F.round(F.sum(own).over(upto), 6).alias("s"), F.lag("v").over(w).alias("l"))
    for width in (3_600_000_000, seq.DAY_US):
        got = seq.ffill(df, "batch", order, "v", "f", width=width)
        got = seq.bfill(got, "batch", order, "v", "b", width=width)
        got = seq.running_sum(got, "batch", order, own, "s", width=width)
        got = seq.with_position(got, "batch", order, "p", width=width)
        got = seq.rolling(got, "batch", "p", {"l": lambda ww: F.lag("v").over(ww)}, 1, 0, block=7)
        got = got.select("id", "f", "b", "p", F.round("s", 6).alias("s"), "l")
        assert got.count() == want.count() and want.exceptAll(got).count() == 0


def test_asof_never_matches_a_null_key_or_time(spark):
    import duckdb

    from ripestream.operators import asof

    rows = _with_nulls(spark)
    left, right = rows.where("v is null").select("batch", "id", "ts"), rows.where("v is not null").select("batch", F.col("id").alias("oid"), "ts", "v")
    con = duckdb.connect()
    con.register("l", left.toPandas())
    con.register("r", right.toPandas())
    # of right rows with the same key and time, the larger id
    sql = """WITH u AS (SELECT batch, ts, v FROM r WHERE batch IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch, ts ORDER BY oid DESC) = 1)
             SELECT l.id, u.v FROM l ASOF LEFT JOIN u ON l.batch = u.batch AND l.ts >= u.ts ORDER BY 1"""
    want = [(i, v) for i, v in con.execute(sql).fetchall()]
    for width in (None, 3_600_000_000):
        got = asof.asof_backward(left, right, "batch", "ts", ["v"], right_id="oid", width=width)
        assert [(r["id"], r["v"]) for r in got.orderBy("id").collect()] == want
        near = asof.nearest(left, right, "batch", "ts", ["v"], right_id="oid", width=width)
        assert near.count() == len(want) and near.where("(batch is null or ts is null) and (v is not null or match_ts is not null or gap_seconds is not null)").count() == 0
