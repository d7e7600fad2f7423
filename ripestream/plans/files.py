"""File round-trip queries: collector CSVs written per batch folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripestream.functions import nn
from ripestream.operators import features as feat
from ripestream.plans.common import write_table
from ripestream.plans.features import FEATURES, PREP_CTES, RAW, prepared
from ripestream.plans.models import SQL_SCORED, WEIGHTS, scored
from ripestream.plans.registry import register, with_ctes
from ripestream.sources import files, proxy
from ripestream.streaming.feeds import run_dir


@register("csv_roundtrip", "A1 A3 A7 H1 H3 B4 M1",
          with_ctes(proxy.SQL_CYCLE) + """SELECT batch, cycle_number, date_trunc('second', ts) AS ts, """ + ", ".join(RAW)
          + " FROM cycle")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle rows appended as collector CSV (fixed column order, ``N/A`` gaps, time to the second, one
    ``..._batch<N>`` folder per batch), then read back with one scan of all folders; the batch comes from the
    folder and every batch must be present."""
    cyc = proxy.cycle_wide(proxy.table(spark, sf_dir, "events"))
    base = run_dir(spark, "csv")
    # The collector's fixed column order: every node quantity, missing ones as N/A.
    order = [f.name for f in files.SENSOR_SCHEMA.fields]
    cols = [F.col("ts").alias("timestamp"), F.col("cycle_number")] + [
        (F.col(c) if c in RAW else F.lit(None).cast("double")).alias(c) for c in order[2:]]
    out = cyc.select(*cols, F.concat(F.lit("trial_batch"), F.col("batch")).alias("folder"))
    files.append_csv(out, base, order, partition_by="folder")
    back = write_table(files.read_batches(spark, base, files.SENSOR_SCHEMA, nested=True), "csv_rows")  # read twice below: the folders are opened once
    files.require_batches(spark, back, cyc.select("batch"))
    back = files.drop_if_present(back, [f"{n}_eco2" for n in files.NODES] + ["master_temp", "master_hum"])
    return back.select(F.col("batch").cast("long").alias("batch"), "cycle_number", F.col("timestamp").alias("ts"), *RAW)


# Free-form headers a collector may write for the four proxy node columns.
_ALIASES = {"node1_tvoc": "n1_voc", "node1_mq3_ppm": "Node_1 Alcohol", "node2_tvoc": "NODE2_TVOC",
            "node2_mq3_ppm": "n2_mq3"}


@register("header_mapping", "A14 A15",
          with_ctes(proxy.SQL_CYCLE) + "SELECT batch, cycle_number, " + ", ".join(RAW) + " FROM cycle")
def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle rows under free-form headers, recognised as a sensor table and renamed to canonical names."""
    cyc = proxy.cycle_wide(proxy.table(spark, sf_dir, "events"))
    raw = cyc.select("batch", "cycle_number", *[F.col(c).alias(a) for c, a in _ALIASES.items()])
    if files.table_kind(raw.columns) != "sensor":
        raise ValueError("expected a sensor table")
    return files.normalise_headers(raw).select("batch", "cycle_number", *RAW)


_BAND_SQL = ", ".join(f"CAST(floor(value) AS INTEGER) + {i} AS {b}" for i, b in enumerate(files.BANDS))


@register("spectral_roundtrip", "A2 A3 A7 H1",
          f"""SELECT user_id AS batch, date_trunc('second', ts) AS ts, {_BAND_SQL}, CAST(json_extract_string(props, '$.k') AS INTEGER) AS clear,
       CAST(floor(value) AS INTEGER) AS nir FROM events WHERE event_type = 'view'""")
def spectral_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optical rows appended as spectral CSV, one folder per batch, and read back in one scan."""
    spec = proxy.spectral_feed(proxy.table(spark, sf_dir, "events"))
    base = run_dir(spark, "spectral")
    whole = F.floor("nir").cast("int")
    order = [f.name for f in files.SPECTRAL_SCHEMA.fields]
    made = {"timestamp": F.col("ts"), "clear": F.col("clear"), "nir": whole} | {b: whole + i for i, b in enumerate(files.BANDS)}
    rows = spec.select(*[made.get(c, F.lit(None).cast("int")).alias(c) for c in order], F.concat(F.lit("batch"), F.col("batch")).alias("folder"))
    files.append_csv(rows, base, order, partition_by="folder")
    back = write_table(files.read_batches(spark, base, files.SPECTRAL_SCHEMA, nested=True), "spectral_rows")  # read twice below: the folders are opened once
    files.require_batches(spark, back, spec.select("batch"))
    return back.select(F.col("batch").cast("long").alias("batch"), F.col("timestamp").alias("ts"), *files.BANDS, "clear", "nir")


# Run number: folder and condition of the three condition runs; the folders' names hold no number.
RUNS = {1: ("dark_box", "dark"), 2: ("ambient", "room light"), 3: ("led_only", "led")}
_FLAGS = {"N": 1, "A": 2, "R": 3}


@register("condition_runs", "A4 C15",
          """SELECT CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS run,
       CASE l_returnflag WHEN 'N' THEN 'dark' WHEN 'A' THEN 'room light' ELSE 'led' END AS condition, count(*) AS n,
       min(l_shipdate)::TIMESTAMP AS first_ts, max(CAST(l_quantity AS INTEGER)) AS max_nir, round(avg(CAST(l_quantity AS INTEGER)), 6) AS mean_nir
FROM lineitem GROUP BY 1, 2""")
def condition_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition runs written to one folder each and read back with their run number and condition."""
    li = proxy.table(spark, sf_dir, "lineitem")
    base = run_dir(spark, "runs")
    order = [f.name for f in files.SPECTRAL_SCHEMA.fields]
    made = {"timestamp": F.col("l_shipdate").cast("timestamp_ntz"), "nir": F.col("l_quantity").cast("int")}
    rows = li.select("l_returnflag", *[made.get(c, F.lit(None).cast("int")).alias(c) for c in order])
    for flag, run in _FLAGS.items():
        files.append_csv(rows.where(F.col("l_returnflag") == flag), f"{base}/{RUNS[run][0]}", order, partition_by=None)
    back = files.read_condition_runs(spark, base, RUNS)
    return back.groupBy("run", "condition").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("nir").alias("max_nir"), F.round(F.avg("nir"), 6).alias("mean_nir"))


_FIT = ", ".join(f"min({c}) AS mn_{c}, CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE max({c}) - min({c}) END AS rg_{c}" for c in FEATURES)
_SCALED = ", ".join(f"round(least(1, greatest(0, ({c} - mn_{c}) / rg_{c})), 6) AS {c}_norm" for c in FEATURES)


@register("split_export", "A9 A10 H2",
          with_ctes(*PREP_CTES) + f""", fit AS (SELECT {_FIT} FROM prep),
rows AS (SELECT split, batch, cycle_number, {_SCALED}, nir_label, label FROM prep, fit)
SELECT 'split' AS exported, * FROM rows UNION ALL SELECT 'combined', * FROM rows WHERE split <> 'test'""")
def split_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared rows exported by split, and the combined train + held set, both read back."""
    p = prepared(spark, sf_dir)
    rows = feat.apply_minmax(p, FEATURES, feat.fit_minmax_struct(p, FEATURES))
    base = run_dir(spark, "export")
    files.export_split(rows, f"{base}/split", FEATURES, fmt="parquet")
    files.export_split(rows.where("split <> 'test'"), f"{base}/combined", FEATURES, fmt="parquet")
    back = [spark.read.parquet(f"{base}/{e}").select(F.lit(e).alias("exported"), "split", "batch", "cycle_number", *[F.round(f"{c}_norm", 6).alias(f"{c}_norm") for c in FEATURES], "nir_label", "label")
            for e in ("split", "combined")]
    return back[0].unionByName(back[1])


@register("stats_json", "A11 E5 E10",
          with_ctes(*PREP_CTES) + "\nUNION ALL\n".join(
              [f"SELECT 'feature' AS section, '{c}.{k}' AS name, round({e}, 6) AS value FROM prep" for c in FEATURES for k, e in
               (("min", f"min({c})"), ("max", f"max({c})"), ("range", f"CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE max({c}) - min({c}) END"))]
              + ["SELECT 'rows', split, CAST(count(*) AS DOUBLE) FROM prep GROUP BY split",
                 "SELECT 'class', split || '.' || nir_label, CAST(count(*) AS DOUBLE) FROM prep GROUP BY split, nir_label"]))
def stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset statistics written as one JSON document and read back: feature limits, rows and class balance of each split."""
    p = prepared(spark, sf_dir)
    feature = p.agg(*[F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.when(F.max(c) == F.min(c), 1.0).otherwise(F.max(c) - F.min(c)).alias("range")).alias(c) for c in FEATURES])
    splits = ("train", "held", "test")
    rows = p.agg(*[F.count_if(F.col("split") == s).alias(s) for s in splits])
    classes = p.agg(*[F.struct(*[F.count_if((F.col("split") == s) & (F.col("nir_label") == c)).alias(c) for c in ("Fresh", "Aging", "Degraded")]).alias(s) for s in splits])
    doc = p.sparkSession.range(1).select(F.lit(FEATURES).alias("feature_names"), feature.select(F.struct("*")).scalar().alias("feature"),
                                         rows.select(F.struct("*")).scalar().alias("rows"), classes.select(F.struct("*")).scalar().alias("class"))
    path = f"{run_dir(spark, 'stats')}/stats.json"
    files.write_stats_json(doc, path)
    back = spark.read.schema(doc.schema).json(path)
    cells = [("feature", f"{c}.{k}", F.col(f"feature.{c}.{k}")) for c in FEATURES for k in ("min", "max", "range")]
    cells += [("rows", s, F.col(f"rows.{s}")) for s in splits] + [("class", f"{s}.{c}", F.col(f"class.{s}.{c}")) for s in splits for c in ("Fresh", "Aging", "Degraded")]
    long = back.select(F.inline(F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("name"), F.round(v.cast("double"), 6).alias("value")) for a, b, v in cells])))
    return long.where("section = 'feature' or value > 0")


@register("weights_file", "A16 I3",
          SQL_SCORED + "SELECT id, pred FROM sc")
def weights_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network weights written as a text file, loaded and used for scoring."""
    path = f"{run_dir(spark, 'weights')}/weights.txt"
    spark.createDataFrame([("\n".join(map(repr, WEIGHTS)),)], "value string").coalesce(1).write.text(path)
    flat = files.load_weights(spark, path)
    assert len(flat) == nn.N_WEIGHTS
    return scored(spark, sf_dir, flat).select("id", "pred")


# ------------------------------------------------ A11: the whole statistics document
_NAMES = ["Fresh", "Aging", "Degraded"]
_BY_SPLIT = lambda s: "\nUNION ALL\n".join(f"SELECT 'class_balance', '{s}.{c}', CAST(count(*) FILTER (WHERE nir_label = '{c}') AS DOUBLE) FROM prep WHERE split = '{s}'" for c in _NAMES)


@register("dataset_document", "A11 E2 E4 E5 E10 B1",
          with_ctes(*PREP_CTES) + """, lit_n AS (SELECT batch, count(*) AS n_spectral, count(*) FILTER (WHERE lit) AS n_lit FROM flagged GROUP BY batch),
train_keys AS (SELECT DISTINCT user_id AS batch FROM events WHERE user_id % 4 IN (1, 3)),
gsm AS (SELECT batch, ts, id, avg(CASE WHEN NOT lit THEN nir / NULLIF(clear, 0) END) OVER (PARTITION BY batch ORDER BY ts, id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v
        FROM flagged WHERE batch IN (SELECT batch FROM train_keys)),
grk AS (SELECT v, row_number() OVER (ORDER BY batch, ts, id) AS ra, row_number() OVER (ORDER BY batch DESC, ts DESC, id DESC) AS rd FROM gsm WHERE v IS NOT NULL),
gst AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, avg(CASE WHEN ra <= 3 THEN v END) AS f3, avg(CASE WHEN rd <= 3 THEN v END) AS l3 FROM grk),
doc AS (
""" + "\nUNION ALL\n".join(
              [f"SELECT 'feature' AS section, '{c}.{k}' AS name, CAST({e} AS DOUBLE) AS value FROM prep" for c in FEATURES for k, e in
               (("min", f"min({c})"), ("max", f"max({c})"), ("range", f"CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE max({c}) - min({c}) END"))]
              + [f"SELECT 'size', '{n}', CAST({e} AS DOUBLE) FROM prep" for n, e in (("n_features", f"max({len(FEATURES)})"), ("n_train", "count(*) FILTER (WHERE split = 'train')"), ("n_test", "count(*) FILTER (WHERE split = 'test')"),
                 ("train_batches", "count(DISTINCT batch) FILTER (WHERE split = 'train')"), ("test_batches", "count(DISTINCT batch) FILTER (WHERE split = 'test')"))]
              + [_BY_SPLIT("train"), _BY_SPLIT("test")]
              + [f"SELECT 'global_zones', '{n}', CAST({e} AS DOUBLE) FROM gst" for n, e in (("direction", "CASE WHEN n >= 4 AND hi > lo THEN CASE WHEN l3 > f3 THEN 1 ELSE -1 END END"),
                 ("b1", "CASE WHEN n >= 4 AND hi > lo THEN lo + (hi - lo) / 3 END"), ("b2", "CASE WHEN n >= 4 AND hi > lo THEN lo + 2 * (hi - lo) / 3 END"))]
              + [f"SELECT 'nir_zones', 'batch' || l.batch || '.{n}', CAST({e} AS DOUBLE) FROM lit_n l LEFT JOIN zones z USING (batch)" for n, e in
                 (("n_spectral", "n_spectral"), ("n_lighting_flagged", "n_lit"), ("direction", "direction"), ("b1", "b1"), ("b2", "b2"))]
              + ["SELECT 'exclusions', 'tvoc_saturation_ppb', 150.0"]) + """)
SELECT section, name, round(value, 6) AS value FROM doc""")
def dataset_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole statistics document, written as JSON and read back: feature limits, sizes, class balance, pooled zones, zones and lighting events by batch, settings."""
    from ripestream.operators import labeling
    from ripestream.plans.common import bucket_width, write_table

    p = prepared(spark, sf_dir)
    width = bucket_width(spark, sf_dir)
    flagged = write_table(labeling.lighting_flags(proxy.spectral_feed(proxy.table(spark, sf_dir, "events"))), "flagged")
    zones = labeling.range_zones(labeling.smooth(flagged, width=width))
    counts = flagged.groupBy("batch").agg(F.count(F.lit(1)).alias("n_spectral"), F.count_if("lit").alias("n_lighting_flagged"))
    train = flagged.where((F.col("batch") % 4).isin(1, 3)).select("batch").distinct()
    pooled = labeling.global_zones(proxy.spectral_feed(proxy.table(spark, sf_dir, "events")), train, width=width)
    of = lambda f: F.array(*[f(c) for c in FEATURES])
    span = lambda c: F.when(F.max(c) == F.min(c), F.lit(1.0)).otherwise(F.max(c) - F.min(c))
    named = lambda s: F.array_sort(F.collect_set(F.when(F.col("split") == s, F.concat(F.lit("batch"), F.col("batch").cast("string")))))
    balance = lambda s: F.map_from_arrays(F.lit(_NAMES), F.array(*[F.count_if((F.col("split") == s) & (F.col("nir_label") == c)) for c in _NAMES]))
    summary = p.agg(F.lit("NIR-based 3-class (Fresh=0, Aging=1, Degraded=2)").alias("label_system"), F.lit(FEATURES).alias("feature_names"), F.lit(len(FEATURES)).alias("n_features"),
                    F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"), named("train").alias("train_batches"), named("test").alias("test_batches"),
                    F.lit("min-max fitted on all batches").alias("normalisation"), F.lit("per-batch").alias("boundary_mode"),
                    of(F.min).alias("feature_min"), of(F.max).alias("feature_max"), of(span).alias("feature_range"), balance("train").alias("train_class_balance"), balance("test").alias("test_class_balance"))
    by_batch = files.keyed_map(counts.join(zones.select("batch", "direction", "b1", "b2"), "batch", "left"), F.concat(F.lit("batch"), F.col("batch").cast("string")),
                               F.struct("n_spectral", "n_lighting_flagged", "direction", "b1", "b2"))
    doc = summary.select("*", pooled.select(F.struct("direction", "b1", "b2")).scalar().alias("global_zones"), by_batch.scalar().alias("nir_zones"),
                         F.struct(F.lit(proxy.PROXY_SATURATION).alias("tvoc_saturation_ppb"), F.lit(f"clear above {labeling.LIGHTING_FACTOR} x its median").alias("lighting_events")).alias("exclusions"),
                         F.map_from_arrays(F.array(F.lit("delta_node1_tvoc"), F.lit("delta_node2_tvoc")), F.array(*[F.lit("change within the batch, 0 in its first row")] * 2)).alias("engineered_features"))
    path = f"{run_dir(spark, 'document')}/dataset_stats.json"
    files.write_stats_json(doc, path)
    back = spark.read.schema(doc.schema).json(path)
    line = lambda section, name, value: F.struct(F.lit(section).alias("section"), (F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("double").alias("value"))
    cells = [line("feature", f"{c}.{k}", F.col(f"feature_{k}")[i]) for i, c in enumerate(FEATURES) for k in ("min", "max", "range")]
    cells += [line("size", n, F.col(n)) for n in ("n_features", "n_train", "n_test")] + [line("size", n, F.size(n)) for n in ("train_batches", "test_batches")]
    cells += [line("class_balance", f"{s}.{c}", F.col(f"{s}_class_balance")[c]) for s in ("train", "test") for c in _NAMES]
    cells += [line("global_zones", n, F.col(f"global_zones.{n}")) for n in ("direction", "b1", "b2")] + [line("exclusions", "tvoc_saturation_ppb", F.col("exclusions.tvoc_saturation_ppb"))]
    one = back.select(F.inline(F.array(*cells)))
    zone = back.select(F.explode("nir_zones").alias("batch", "z"))
    each = zone.select(F.inline(F.array(*[line("nir_zones", F.concat("batch", F.lit(f".{n}")), F.col(f"z.{n}")) for n in ("n_spectral", "n_lighting_flagged", "direction", "b1", "b2")])))
    return one.unionByName(each).select("section", "name", F.round("value", 6).alias("value"))


# ------------------------------------------------ A12: the report of a training run
def _report(spark: SparkSession, sf_dir: str, net, log: list[tuple]) -> DataFrame:
    """The report of ``net`` on the test split, written as JSON and read back, as (section, name, value)."""
    from ripestream.operators import evaluate as ev
    from ripestream.plans import training as tr

    test = tr._scaled(spark, sf_dir).where("split = 'test'")
    z = nn.forward(test.select("label", *tr.NORM), tr.NORM, net.flat(), tr.HIDDEN, tr.CLASSES)
    zs = [F.col(f"z{k}") for k in range(tr.CLASSES)]
    scored = z.select("label", nn.argmax(zs).alias("pred"), nn.cross_entropy(nn.softmax(zs), F.col("label")).alias("loss"))
    doc = ev.training_report(scored, "label", "pred", F.col("loss"), log, _NAMES, f"Input({len(tr.NORM)}) -> Dense({tr.HIDDEN}, ReLU) -> Dense({tr.CLASSES}, Softmax)", "NIR 3-class (Fresh=0, Aging=1, Degraded=2)")
    path = f"{run_dir(spark, 'report')}/training_report.json"
    files.write_stats_json(doc, path)
    back = spark.read.schema(doc.schema).json(path)
    line = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), F.round(value.cast("double"), 6).alias("value"))
    cells = [line("test", n, F.col(n)) for n in ("test_loss", "test_accuracy", "macro_f1")]
    cells += [line("per_class_metrics", f"{c}.{m}", F.col("per_class_metrics")[c][m]) for c in _NAMES for m in ("precision", "recall", "f1", "support")]
    cells += [line("confusion_matrix", f"{a}.{b}", F.col("confusion_matrix")[i][j]) for i, a in enumerate(_NAMES) for j, b in enumerate(_NAMES)]
    cells += [line("epochs", f"{r[0]}.{n}", F.col("epochs")[i][n]) for i, r in enumerate(log) for n in ("loss", "fit_acc", "val_acc")]
    return back.select(F.inline(F.array(*cells)))


@register("training_report", "A12 I4 E17 E18 E19")
def training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the mini-batch run: epochs, test loss and accuracy, macro F1, metrics by class, confusion matrix."""
    from ripestream.plans import training as tr

    net, log = tr._minibatch(spark, sf_dir, epochs=40)
    return _report(spark, sf_dir, net, log)


def _report_sql() -> str:
    from ripestream.plans import training as tr

    ratio = {"precision": "tp / greatest(guessed, 1)", "recall": "tp / greatest(support, 1)", "support": "support",
             "f1": "2 * (tp / greatest(guessed, 1)) * (tp / greatest(support, 1)) / greatest(tp / greatest(guessed, 1) + tp / greatest(support, 1), 1e-9)"}
    parts = ["SELECT 'test' AS section, 'test_loss' AS name, round(avg(l), 6) AS value FROM sc", "SELECT 'test', 'test_accuracy', round(avg(ok), 6) FROM sc", f"SELECT 'test', 'macro_f1', round(avg({ratio['f1']}), 6) FROM k"]
    parts += [f"SELECT 'per_class_metrics', '{c}.{m}', round(CAST({e} AS DOUBLE), 6) FROM k WHERE c = {i}" for i, c in enumerate(_NAMES) for m, e in ratio.items()]
    parts += [f"SELECT 'confusion_matrix', '{a}.{b}', CAST(count(*) FILTER (WHERE y = {i} AND pred = {j}) AS DOUBLE) FROM sc" for i, a in enumerate(_NAMES) for j, b in enumerate(_NAMES)]
    return with_ctes(*PREP_CTES, tr.SQL_XS, tr.sql_hidden(tr.GLOROT)) + f""", te AS (SELECT * FROM hd WHERE split = 'test'),
sc AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM {tr.sql_probs("te", tr.sql_heads(tr.GLOROT))}),
k AS (SELECT i AS c, count(*) FILTER (WHERE y = i AND pred = i) AS tp, count(*) FILTER (WHERE y = i) AS support, count(*) FILTER (WHERE pred = i) AS guessed FROM sc, range(0, {tr.CLASSES}) t(i) GROUP BY i)
""" + "\nUNION ALL\n".join(parts)


@register("report_start", "A12 E17 E18 E19 E33", _report_sql())
def report_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report of the starting weights, before any step."""
    from ripestream.operators.models import Net
    from ripestream.plans import training as tr

    return _report(spark, sf_dir, Net.from_flat(tr.GLOROT, len(tr.NORM), tr.HIDDEN, tr.CLASSES), [])
