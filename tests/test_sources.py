"""File sources: header detection and mapping, CSV nulls, weights layout."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ripestream.functions import nn
from ripestream.sources import files


def test_table_kind():
    assert files.table_kind(["timestamp", "f1_415nm", "nir"]) == "spectral"
    assert files.table_kind(["timestamp", "F3 480nm"]) == "spectral"
    assert files.table_kind(["timestamp", "node1_tvoc"]) == "sensor"


@pytest.mark.parametrize("raw,expected", [
    ("node1_tvoc", "node1_tvoc"), ("n1_voc", "node1_tvoc"), ("node_2_alcohol", "node2_mq3_ppm"),
    ("ref_co2", "master_eco2"), ("master_eco2", "master_eco2"), ("node1_temp", "node1_temp"),
    ("n2_hum", "node2_hum"), ("timestamp", None),
])
def test_canonical_names(raw, expected):
    assert files.canonical_name(raw) == expected


def test_csv_reader_nulls_and_batch(spark):
    d = tempfile.mkdtemp(prefix="rs-csv-")
    folder = os.path.join(d, "trial_batch7")
    os.makedirs(folder)
    header = ",".join(f.name for f in files.SENSOR_SCHEMA.fields)
    n = len(files.SENSOR_SCHEMA.fields) - 2
    with open(os.path.join(folder, "sensors.csv"), "w") as fh:
        fh.write(header + "\n")
        fh.write("2024-01-01 00:00:00,1," + ",".join(["N/A"] * n) + "\n")
        fh.write("2024-01-01 00:15:00,N/A," + ",".join(["NaN"] + ["1.5"] * (n - 1)) + "\n")
    df = files.read_batches(spark, os.path.join(d, "*", "*.csv"), files.SENSOR_SCHEMA).orderBy("timestamp").collect()
    assert df[0]["batch"] == 7 and df[0]["master_temp"] is None
    assert df[1]["cycle_number"] is None and df[1]["master_temp"] is None and df[1]["master_hum"] == 1.5
    files.require_batches(spark, spark.createDataFrame([(7,)], "batch int"), [7])
    with pytest.raises(FileNotFoundError):
        files.require_batches(spark, spark.createDataFrame([(7,)], "batch int"), [7, 8])


def test_folders_are_read_below_a_path_without_a_pattern_or_a_regular_expression(spark, tmp_path):
    order = [f.name for f in files.SPECTRAL_SCHEMA.fields]
    rows = spark.range(6).select(F.expr("timestamp_ntz '2024-01-01 00:00:05'").alias("timestamp"), *[F.col("id").cast("int").alias(c) for c in order[1:]], F.concat(F.lit("trial_batch"), F.col("id") % 3).alias("folder"))
    files.append_csv(rows, f"{tmp_path}/in", order, partition_by="folder")
    (tmp_path / "in" / "folder=trial_batch0" / "notes.txt").write_text("not a table")
    back = files.read_batches(spark, f"{tmp_path}/in", files.SPECTRAL_SCHEMA, nested=True)
    assert back.columns == [*order, "batch"]
    assert sorted((r["nir"], r["batch"]) for r in back.collect()) == [(i, i % 3) for i in range(6)]
    runs = {1: ("folder=trial_batch0", "dark"), 2: ("folder=trial_batch2", "led|room")}
    made = files.read_condition_runs(spark, f"{tmp_path}/in", {k: v for k, v in runs.items()})
    assert sorted((r["nir"], r["run"], r["condition"]) for r in made.select("nir", "run", "condition").where("nir is not null").collect()) == [(0, 1, "dark"), (2, 2, "led|room"), (3, 1, "dark"), (5, 2, "led|room")]
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString() and "split(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_weights_layout(spark):
    d = tempfile.mkdtemp(prefix="rs-w-")
    p = os.path.join(d, "w.txt")
    flat = nn.formula_weights()
    with open(p, "w") as fh:
        fh.write("\n".join(str(v) for v in flat))
    w = files.load_weights(spark, p)
    w1, b1, w2, b2 = nn.unpack(w)
    assert len(w1) == 10 and len(w1[0]) == 16 and len(b1) == 16 and len(w2) == 16 and len(b2) == 3
    assert w1[1][0] == flat[16] and b2[2] == flat[226]


def test_images_in_nested_folders_are_listed_by_path(spark, tmp_path):
    from datetime import datetime

    from ripestream.sources import files

    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("capture_20240229_235959.jpg", "a/cam_2024-03-01_00-00-01.jpg", "a/b/other.jpg", "a/b/20240230_000000.jpg", "a/notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r["ts"] for r in files.image_listing(spark, str(tmp_path)).collect()}
    assert got == {"capture_20240229_235959.jpg": datetime(2024, 2, 29, 23, 59, 59), "cam_2024-03-01_00-00-01.jpg": datetime(2024, 3, 1, 0, 0, 1), "other.jpg": None, "20240230_000000.jpg": None}


def test_training_report_document(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from ripestream.operators import evaluate as ev
    from ripestream.sources import files

    rows = spark.createDataFrame([(0, 0, 0.1), (0, 1, 2.0), (1, 1, 0.3), (1, 1, 0.2)], "label int, pred int, loss double")
    doc = ev.training_report(rows, "label", "pred", F.col("loss"), [(0, 1.5, 0.2, 0.1), (1, 0.9, 0.5, 0.4)], ["Fresh", "Aging", "Degraded"], "net", "labels")
    files.write_stats_json(doc, str(tmp_path / "report"))
    got = json.loads(next((tmp_path / "report").glob("*.json")).read_text())
    assert got["epochs_trained"] == 1 and [e["loss"] for e in got["epochs"]] == [1.5, 0.9] and abs(got["test_loss"] - 0.65) < 1e-12 and got["test_accuracy"] == 0.75
    assert got["confusion_matrix"] == [[1, 1, 0], [0, 2, 0], [0, 0, 0]] and got["class_names"] == ["Fresh", "Aging", "Degraded"]
    m = got["per_class_metrics"]
    assert list(m) == ["Aging", "Degraded", "Fresh"] and m["Fresh"] == {"precision": 1.0, "recall": 0.5, "f1": 2 / 3, "support": 2} and m["Degraded"]["f1"] == 0
    assert abs(got["macro_f1"] - (2 / 3 + 0.8) / 3) < 1e-12
    empty = ev.training_report(rows.where("label > 5"), "label", "pred", F.col("loss"), [], ["Fresh", "Aging"], "net", "labels").first()
    assert empty["epochs_trained"] == 0 and empty["test_accuracy"] is None


def test_scratch_is_the_applications_own_and_can_be_cleared(spark, tmp_path, monkeypatch):
    from ripestream import session
    from ripestream.plans.common import write_table

    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda s: str(tmp_path))
    (tmp_path / "other").mkdir()
    assert write_table(spark.range(3), "t").count() == 3
    own = f"ripestream-{spark.sparkContext.applicationId}"
    assert sorted(os.listdir(tmp_path)) == ["other", own]
    session.clear_scratch(spark)
    assert os.listdir(tmp_path) == ["other"]
