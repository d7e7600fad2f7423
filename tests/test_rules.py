"""Hand-made edge cases (FIXTURES §4) and golden arithmetic (§5)."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ripestream.functions import nn
from ripestream.functions import physics as ph
from ripestream.functions.zones import zone_for
from ripestream.operators import asof, evaluate as ev, labeling, stats as st
from ripestream.operators import features as feat

T0 = datetime(2024, 1, 1)


def spec_df(spark, clears, nirs=None, batch=1):
    nirs = nirs or [float(i) for i in range(len(clears))]
    rows = [(batch, i, T0 + timedelta(minutes=53 * i), nirs[i], clears[i]) for i in range(len(clears))]
    return spark.createDataFrame(rows, "batch long, id long, ts timestamp_ntz, nir double, clear int")


def col(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_lighting_flags_edges(spark):
    assert not any(col(labeling.lighting_flags(spec_df(spark, [0, 0, 0])), "lit"))
    assert col(labeling.lighting_flags(spec_df(spark, [10, 10, 16])), "lit") == [False, False, False]
    # median of 10, 10, 16.1 is 10: 16.1 > 16 is flagged (strict); ints: use 17
    assert col(labeling.lighting_flags(spec_df(spark, [10, 10, 17])), "lit") == [False, False, True]
    assert col(labeling.lighting_flags(spec_df(spark, [10, None, 10])), "lit") == [False, False, False]


@pytest.mark.parametrize("width", [None, 60_000_000])
def test_smoothing_and_labels(spark, width):
    # 8 rows, row 3 flagged: smoothed value still exists; its label is nulled then forward-filled
    clears = [10, 10, 10, 100, 10, 10, 10, 10]
    nirs = [1.0, 2.0, 3.0, 50.0, 5.0, 6.0, 7.0, 8.0]
    lab = labeling.label_spectral(spec_df(spark, clears, nirs), width=width)
    rows = lab.orderBy("id").collect()
    assert rows[3]["lit"] and rows[3]["nir_smooth"] is not None
    assert rows[3]["raw_label"] is None and rows[3]["nir_label"] == rows[2]["nir_label"]
    # smoothed row 0 = mean(1, 2, 3) (row 3 is flagged -> NULL)
    assert rows[0]["nir_smooth"] == pytest.approx(2.0)


def test_zones_need_four_points_and_span(spark):
    z = labeling.range_zones(labeling.smooth(labeling.lighting_flags(spec_df(spark, [1, 1, 1])))).first()
    assert z["direction"] is None and z["b1"] is None
    flat = spec_df(spark, [1, 1, 1, 1, 1], [5.0] * 5)
    z = labeling.range_zones(labeling.smooth(labeling.lighting_flags(flat))).first()
    assert z["direction"] is None


def test_zone_for_rising_falling(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 1.0), (1, 1.0, 2.0, 2.0), (-1, 1.0, 2.0, 1.5), (-1, 1.0, 2.0, 3.0)],
                               "d int, b1 double, b2 double, v double")
    ref = [r[0] for r in df.select(zone_for(F.col("v"), F.col("d"), F.col("b1"), F.col("b2"))).collect()]
    assert ref == ["Aging", "Degraded", "Fresh", "Fresh"]
    mir = [r[0] for r in df.select(zone_for(F.col("v"), F.col("d"), F.col("b1"), F.col("b2"), "mirrored")).collect()]
    assert mir[2] == "Aging"


@pytest.mark.parametrize("width", [None, 60_000_000])
def test_asof_inclusive_and_before_first(spark, width):
    right = spark.createDataFrame([(1, 10, T0 + timedelta(hours=1), "Fresh")], "batch long, id long, ts timestamp_ntz, lab string")
    left = spark.createDataFrame([(1, 1, T0), (1, 2, T0 + timedelta(hours=1)), (1, 3, T0 + timedelta(days=3))],
                                 "batch long, id long, ts timestamp_ntz")
    out = asof.asof_backward(left, right, "batch", "ts", ["lab"], width=width)
    assert col(out, "lab") == [None, "Fresh", "Fresh"]


def test_saturation_mask(spark):
    df = spark.createDataFrame([(58999.0,), (59000.0,), (None,)], "t double")
    assert [r[0] for r in feat.mask_saturated(df, ["t"], 59000).collect()] == [58999.0, None, None]


def test_impute_global_after_batch_fill(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, None), (2, None)], "batch long, x double")
    out = feat.impute_median(df, "batch", ["x"]).orderBy("batch", "x").collect()
    # batch 2 is fully NULL: global median over the batch-filled column (2, 2) = 2
    assert [r["x"] for r in out] == [1.0, 3.0, 2.0, 2.0]
    assert [r["x_src"] for r in out] == ["raw", "raw", "global", "global"]


def test_train_delta_and_serving_delta(spark):
    df = spark.createDataFrame([(1, 1, 100.0, 5.0), (1, 2, 110.0, None), (1, 3, 130.0, 7.0)],
                               "batch long, c long, a double, b double")
    d = feat.within_key_delta(df, "batch", ["c"], {"da": "a"})
    assert col(d, "da", "c") == [0.0, 10.0, 20.0]
    s = feat.serving_delta(df, "batch", ["c"], {"da": "a"}, F.col("b").isNotNull())
    assert col(s, "da", "c") == [100.0, None, 30.0]


def test_minmax_constant_feature(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    out = feat.apply_minmax(df, ["x"], feat.fit_minmax_struct(df, ["x"]))
    assert [r["x_norm"] for r in out.collect()] == [0.0, 0.0]


def test_adc_and_ppm(spark):
    df = spark.createDataFrame([(0,), (4095,)], "adc int")
    assert [r[0] for r in df.select(ph.adc_to_rs(F.col("adc"))).collect()] == [None, None]
    one = spark.createDataFrame([(20000.0,)], "rs double").select(ph.rs_to_ppm(F.col("rs"))).first()[0]
    assert one == pytest.approx(10 ** (0.35 / 0.47), rel=1e-9)


def test_arrival_adjust_golden(spark):
    df = spark.createDataFrame([(a,) for a in (40000, 50000, 57000, 70000, 90000)], "a int")
    got = [r[0] for r in df.select(ph.arrival_adjust(F.col("a"))).collect()]
    assert got == [12000, 0, -3150, -10000, -10000]


def test_cv_verdict(spark):
    df = spark.createDataFrame([("2", 1.0), ("1", 1.96), ("1", 2.0), ("1", None)], "run string, cv double")
    got = [r[0] for r in df.select(st.cv_verdict(F.col("cv"), F.col("run"), "2")).collect()]
    assert got == ["N/A", "pass", "fail", "fail"]


def test_confusion_golden_metrics(spark):
    grid = [[110, 0, 35], [2, 1, 65], [0, 0, 104]]
    rows = [(a, p) for a in range(3) for p in range(3) for _ in range(grid[a][p])]
    df = spark.createDataFrame(rows, "a int, p int")
    m = {r["class"]: r for r in ev.class_metrics(ev.confusion(df, "a", "p", 3)).collect()}
    assert m[0]["recall"] == pytest.approx(110 / 145) and m[1]["precision"] == pytest.approx(1.0)
    assert m[2]["f1"] == pytest.approx(0.6753, abs=1e-4)
    acc = {r["scope"]: r for r in ev.accuracy_report(df, "a", "p", 3).collect()}
    assert acc["all"]["accuracy"] == pytest.approx(215 / 317)
    assert acc["all"]["macro_f1"] == pytest.approx(0.5201, abs=1e-4)


def test_precision_of_never_predicted_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "a int, p int")
    m = {r["class"]: r for r in ev.class_metrics(ev.confusion(df, "a", "p", 3)).collect()}
    assert m[1]["precision"] == 0.0 and m[2]["support"] == 0


def test_class_weights_golden(spark):
    rows = [(0,)] * 67 + [(1,)] * 24 + [(2,)] * 287
    w = {r["class"]: r["weight"] for r in ev.class_weights(spark.createDataFrame(rows, "y int"), "y", 3).collect()}
    assert w[0] == pytest.approx(1.8806, abs=1e-4) and w[1] == pytest.approx(5.25) and w[2] == pytest.approx(0.4390, abs=1e-4)


def test_histogram_value_at_max_is_last_bin(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 29.0), ("a", 10.0)], "c string, v double")
    h = st.density_hist(df, "c", "v")
    assert {r["bin"]: r["n"] for r in h.collect()}[28] == 1


def test_average_ranks_match_pandas(spark):
    import pandas as pd

    vals = [3.0, 1.0, 3.0, 2.0, 5.0, 1.0, 3.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = sorted((r["x"], r["rk"]) for r in st.average_ranks(df, "x", "rk").collect())
    exp = sorted(zip(vals, pd.Series(vals).rank().tolist()))
    assert got == exp


def test_validation_split_lexical(spark):
    from ripestream.operators.models import validation_split

    df = spark.createDataFrame([("batch3", 1), ("batch10", 2)], "b string, id long")
    roles = {r["b"]: r["role"] for r in validation_split(df, "b", "id").collect()}
    assert roles == {"batch3": "val", "batch10": "fit"}


def test_board_routing(spark):
    from ripestream.sources.messages import route_board_lines

    lines = ['{"status":"ready"}', '{"sensor":"AS7341"}', '{"sensor":"AS7341","nir":5}', '{"status":"error"}', "boot junk"]
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    assert [r["kind"] for r in route_board_lines(df).collect()] == ["status", "status", "reading", "error", "malformed"]


def test_cycle_docs_rejects(spark):
    from ripestream.sources.messages import parse_cycle_docs

    lines = ['{"cycle":1,"master":{"received":false},"node1":{"received":true,"tvoc":1}}', "{bad"]
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    assert [r["verdict"] for r in parse_cycle_docs(df).collect()] == ["unexpected_keys", "malformed"]


def test_frozen_global_zones_apply_to_every_batch(spark):
    spec = spec_df(spark, [10] * 6, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    zones = spark.createDataFrame([(1, 2.6, 4.5)], "direction int, b1 double, b2 double")  # first smoothed = 2.5
    out = labeling.label_spectral(spec, zones=zones)
    labels = col(out, "nir_label")
    assert labels[0] == "Fresh" and labels[-1] == "Degraded"


def test_exact_median_matches_median(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    a = st.exact_median(ev, ["event_type"], "value", "m", accuracy=100)
    b = ev.groupBy("event_type").agg(F.median("value").alias("m"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_box_stats_reach_the_values_by_range(spark):
    """Quartiles, whiskers and outliers of few large keys, with ties, nulls and a key without values; no sketch and no row-wise join by key alone."""
    rows = [("a", float(i % 37)) for i in range(500)] + [("a", 900.0), ("a", None), ("b", 1.0), ("b", 2.0), ("c", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r["k"]: r.asDict() for r in st.box_stats(df, ["k"], "v").collect()}
    assert set(got) == {"a", "b", "c"}
    for k in ("a", "b"):
        values = sorted(v for x, v in rows if x == k and v is not None)
        at = lambda p: (lambda pos: values[math.floor(pos)] + (pos % 1) * (values[math.ceil(pos)] - values[math.floor(pos)]))((len(values) - 1) * p)
        q1, q2, q3 = at(0.25), at(0.5), at(0.75)
        inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        assert got[k] == {"k": k, "q1": q1, "median": q2, "q3": q3, "whisker_lo": min(inside), "whisker_hi": max(inside), "n_outliers": len(values) - len(inside), "n": len(values)}
    assert got["c"] == {"k": "c", "q1": None, "median": None, "q3": None, "whisker_lo": None, "whisker_hi": None, "n_outliers": 0, "n": 0}
    assert "percentile_approx" not in st.box_stats(df, ["k"], "v")._jdf.queryExecution().toString()


def test_density_joins_no_rows_and_ignores_a_far_single_value(spark):
    rows = [("a", float(i)) for i in range(30)] + [("b", 3.0), ("b", 4.0), ("c", -1e30), (None, 1e9), (None, 2e9)]
    df = spark.createDataFrame(rows, "k string, v double")
    h = st.density_hist(df, "k", "v")
    got = h.collect()
    assert {r["k"]: sum(x["n"] for x in got if x["k"] == r["k"]) for r in got} == {"a": 30, "b": 2, None: 0}
    assert min(r["edge_lo"] for r in got) == 0.0 and max(r["edge_lo"] for r in got) == 28.0
    assert "LeftSemi" not in h._jdf.queryExecution().optimizedPlan().toString()


def test_impute_by_batch_then_globally(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None), (2, None), (2, None), (3, 5.0), (3, 6.0)],
                               "batch long, x double")
    got = feat.impute_median(df, "batch", ["x"]).orderBy("batch", "x").collect()
    assert [(r["batch"], r["x"], r["x_src"]) for r in got] == [
        (1, 1.0, "raw"), (1, 2.0, "batch"), (1, 3.0, "raw"), (2, 3.0, "global"), (2, 3.0, "global"), (3, 5.0, "raw"), (3, 6.0, "raw")]


def test_exact_quantiles_match_percentile(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    probs = [0.25, 0.5, 0.75, 1.0 / 3]
    a = {r[0]: r[1] for r in st.exact_quantiles(li, ["l_returnflag"], "l_extendedprice", probs, accuracy=200).collect()}
    b = {r[0]: r[1] for r in li.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", probs)).collect()}
    for k in b:
        assert a[k] == pytest.approx(b[k], rel=1e-12)


def test_finetuning_does_not_depend_on_the_number_of_rows(spark):
    """The same rows a hundred times over give the same steps, and the loss goes down."""
    import numpy as np

    from ripestream.operators import models as md

    rng = np.random.default_rng(3)
    rows = [(*map(float, x), int(abs(x).argmax() % 3)) for x in rng.normal(size=(60, 10))]
    cols = [f"f{i}" for i in range(10)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", label int")
    net = md.Net.from_flat(nn.formula_weights(), 10, 16, 3)
    once, log = md.finetune_head(df, cols, "label", net, epochs=4)
    many, log_many = md.finetune_head(df.crossJoin(spark.range(100)).drop("id"), cols, "label", net, epochs=4)
    assert np.allclose(once.flat(), many.flat()) and np.allclose([r[1] for r in log], [r[1] for r in log_many])
    assert log[-1][1] < log[0][1]


def test_p_value_of_a_correlation():
    from ripestream.functions.dist import correlation_p

    # t distribution with 1 and 2 degrees of freedom has closed forms
    for r in (0.0, 0.1, -0.5, 0.95):
        t = abs(r) / (1 - r * r) ** 0.5
        assert correlation_p(r, 3) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        t *= 2**0.5
        assert correlation_p(r, 4) == pytest.approx(1 - t / (2 + t * t) ** 0.5, abs=1e-12)
    assert correlation_p(1.0, 10) == 0.0 and correlation_p(0.3, 2) is None and correlation_p(None, 5) is None
