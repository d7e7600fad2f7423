"""Streams are complete on any file layout, restart without duplicates and never drop late rows in silence."""

import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ripestream.plans import load_all
from ripestream.sources import messages as msg
from ripestream.sources import proxy
from ripestream.streaming import carries as ca
from ripestream.streaming import feeds as fd

from table_paths import SF001

T0 = datetime(2024, 1, 1)
PACKETS = "batch long, id long, ts timestamp_ntz, node string, value double"


def canon(df):
    """Rows in a fixed order; sums of floats depend on the order of rows in their last digits."""
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


def at(m, s):
    return T0 + timedelta(minutes=m, seconds=s)


def test_cycle_assembly_early_close_and_expiry(spark):
    rows = [
        (1, 1, at(0, 5), "node1", 1.0), (1, 2, at(0, 7), "node2", 2.0),
        (1, 3, at(15, 5), "node1", 3.0), (1, 4, at(17, 0), "node2", 9.0),
        (1, 5, at(30, 5), "node1", 4.0), (1, 6, at(30, 9), "node1", 4.5), (1, 7, at(30, 50), "node2", 5.0),
        (1, 8, at(45, 0), "node1", 6.0),
    ]
    flush = spark.createDataFrame([(2, 9, T0 + timedelta(days=1), "node1", 0.0)], PACKETS)
    packets = spark.createDataFrame(rows, PACKETS)
    for slices in (1, 3):
        out = fd.replay(spark, "j3-test", {"p": packets}, "ts", lambda s: fd.assemble_cycles_stream(s["p"], "30 minutes"), slices=slices, flush={"p": flush})
        got = sorted((r["cycle_start"].minute, r["node1_value"], r["node2_value"], r["status"]) for r in out.where("batch = 1").collect())
        assert got == [(0, 1.0, 2.0, "both"), (15, 3.0, None, "expired"), (30, 4.5, 5.0, "both"), (45, 6.0, None, "expired")]


@pytest.fixture(scope="module")
def shuffled_dir(spark):
    """sf0.001 with ``events`` as five files in no time order."""
    root = tempfile.mkdtemp(prefix="rs-many-")
    for f in os.listdir(SF001):
        if f != "events.parquet":
            os.symlink(os.path.join(SF001, f), os.path.join(root, f))
    rows = proxy.table(spark, SF001, "events")
    parts = rows.randomSplit([1.0] * 5, seed=3)
    random.Random(1).shuffle(parts)
    for p in parts:
        p.orderBy(F.rand(7)).coalesce(1).write.mode("append").parquet(os.path.join(root, "events.parquet"))
    assert len([f for f in os.listdir(os.path.join(root, "events.parquet")) if f.endswith(".parquet")]) >= 5
    return root


@pytest.mark.parametrize("name", ["stream_gaps", "stream_sessions", "stream_interval_join", "stream_label", "stream_cycles", "stream_delta", "stream_score", "stream_ingest", "stream_rejects", "stream_router", "stream_timing"])
def test_many_files_give_the_same_rows(spark, shuffled_dir, name):
    q = load_all()[name].build
    one, many = q(spark, SF001), q(spark, shuffled_dir)
    assert canon(one) == canon(many)


def test_stream_equals_batch_for_cycles(spark):
    reg = load_all()
    cols = ["batch", "cycle_start", "node1_value", "node2_value", "n_nodes", "status", "sync_offset_s"]
    stream, batch = (reg[n].build(spark, SF001).select(*cols) for n in ("stream_cycles", "cycle_assembly"))
    assert canon(stream) == canon(batch)


def test_restart_without_duplicates_in_any_zone(spark):
    """A stream that is stopped and started again goes on where it was; a folder URI and a zone with DST change nothing."""
    ev = proxy.table(spark, SF001, "events").select(F.col("user_id").alias("batch"), "ts")
    base = "file://" + tempfile.mkdtemp(prefix="rs-resume-")
    day = ev.agg(F.max("ts")).first()[0]
    middle = ev.agg(F.min("ts")).first()[0] + (day - ev.agg(F.min("ts")).first()[0]) / 2
    flush = spark.createDataFrame([(-1, day + timedelta(days=3))], "batch long, ts timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Amsterdam")
    try:
        build = lambda s: fd.cadence_windows(s["e"], "batch", "ts")
        fd.replay(spark, "r", {"e": ev.where(F.col("ts") < F.lit(middle))}, "ts", build, slices=1, base=base)
        out = fd.replay(spark, "r", {"e": ev.where(F.col("ts") >= F.lit(middle))}, "ts", build, slices=2, base=base, flush={"e": flush})
        want = ev.groupBy("batch", F.window(fd.event_time("ts"), "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("batch", fd.clock_time("w.start").alias("window_start"), "n")
        assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_late_rows_raise(spark):
    early = spark.createDataFrame([(1, at(0, 0))], "batch long, ts timestamp_ntz")
    late = spark.createDataFrame([(1, at(10_000, 0))], "batch long, ts timestamp_ntz")
    build = lambda s: fd.cadence_windows(s["e"], "batch", "ts")
    base = tempfile.mkdtemp(prefix="rs-late-")
    fd.replay(spark, "r", {"e": late}, "ts", build, slices=1, base=base)
    fd.replay(spark, "r", {"e": late}, "ts", build, slices=1, base=base)  # the watermark moves with the next run
    with pytest.raises(fd.LateRows):
        fd.replay(spark, "r", {"e": early}, "ts", build, slices=1, base=base)


def _labels(spark, base, rows):
    """Feed rows (batch, minutes, side, id, label) to the label carry as one more run; its output."""
    schema = "batch long, us long, side int, id long, nir_label string, event_type string, value double"
    df = spark.createDataFrame([(b, m * 60_000_000, s, i, l, "click" if s else None, 1.0 if s else None) for b, m, s, i, l in rows], schema)
    df.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = ca.carried(spark.readStream.schema(schema).parquet(f"{base}/in"), ["batch"], ca.LabelCarry(), ca.LabelCarry.out_schema)
    ca.in_keyed_store(fd.to_parquet)(stream, base)
    return {r["id"]: r["nir_label"] for r in spark.read.parquet(f"{base}/out").collect()}


def test_labels_are_carried_over_restarts_and_late_rows_raise(spark):
    base = tempfile.mkdtemp(prefix="rs-carry-")
    assert _labels(spark, base, [(1, 5, 1, 10, None), (1, 6, 0, 1, "Fresh"), (1, 6, 1, 11, None), (None, 7, 0, 2, "Aging"), (None, 8, 1, 12, None)]) == {10: None, 11: "Fresh", 12: "Aging"}
    got = _labels(spark, base, [(1, 9, 1, 13, None), (1, 9, 0, 3, None), (1, 10, 1, 14, None), (2, 1, 1, 15, None), (None, 9, 1, 16, None)])
    # of equal times, the optical row comes first; a row without a label carries that
    assert got == {10: None, 11: "Fresh", 12: "Aging", 13: None, 14: None, 15: None, 16: "Aging"}
    with pytest.raises(fd.LateRows):
        _labels(spark, base, [(1, 8, 1, 17, None)])


def test_keyed_work_follows_the_rows_of_a_micro_batch(spark):
    """A micro-batch of one device touches one key of the store, whatever the number of devices."""
    base = tempfile.mkdtemp(prefix="rs-keys-")
    _labels(spark, base, [(b, 1, 0, b, "Fresh") for b in range(300)])
    seen = []

    def sink(sdf, base):
        q = sdf.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        seen.extend(q.recentProgress)

    spark.createDataFrame([(7, 120_000_000, 1, 900, None, "click", 1.0)], "batch long, us long, side int, id long, nir_label string, event_type string, value double").write.mode("append").parquet(f"{base}/in")
    with ca.keyed_store(spark):
        sink(ca.carried(spark.readStream.schema("batch long, us long, side int, id long, nir_label string, event_type string, value double").parquet(f"{base}/in"), ["batch"], ca.LabelCarry(), ca.LabelCarry.out_schema), base)
    ops = [op for p in seen for op in p.stateOperators]
    assert sum(op.numRowsUpdated for op in ops) <= 1 and {r["id"]: r["nir_label"] for r in spark.read.parquet(f"{base}/out").collect()}[900] == "Fresh"


def test_a_late_row_among_the_first_of_many_micro_batches_raises(spark):
    base = tempfile.mkdtemp(prefix="rs-many-batches-")
    day = lambda d: T0 + timedelta(days=d)
    for i in range(108):  # one file a micro-batch; the sixth is ten days behind
        when = day(20) + timedelta(minutes=i) if i != 5 else day(0)
        spark.createDataFrame([(1, when)], "batch long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema("batch long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    totals = {}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        with pytest.raises(fd.LateRows):
            fd.to_parquet(fd.cadence_windows(stream, "batch", "ts"), base, totals=totals)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert totals["batches"] >= 108 and totals["late"] == 1 and totals["rows"] == 108


def test_a_poll_ends_at_its_first_reading_or_error_or_after_five_lines(spark):
    import pandas as pd

    kinds = {1: ["status", "reading", "status"], 2: ["malformed", "status", "status", "status", "malformed", "status", "reading"], 3: ["error", "reading"], 4: ["status"] * 4 + ["reading", "status"], 5: ["status"]}
    want = {1: [True, True, False], 2: [True] * 5 + [False] * 2, 3: [True, False], 4: [True] * 5 + [False], 5: [True]}
    rows = [(p, 0, i, i, k) for p, ks in kinds.items() for i, k in enumerate(ks)] + [(None, 0, 0, 0, "reading"), (None, 0, 1, 1, "status")]
    df = spark.createDataFrame(rows, "batch long, poll long, ts long, id long, kind string")
    got = {}
    for r in msg.polled(df).orderBy("id").collect():
        got.setdefault(r["batch"], []).append(r["consumed"])
    assert got == want | {None: [True, False]}

    class Timers:
        def registerTimer(self, ms):
            self.at = ms

    for cut in range(8):  # the same in two micro-batches
        carry = ca.PollCarry()
        carry.handle = Timers()
        for p, ks in kinds.items():
            both, state = [], None
            for part in (list(enumerate(ks))[:cut], list(enumerate(ks))[cut:]):
                if part:
                    out, state = carry.step((p, 0), pd.DataFrame({"us": [i for i, _ in part], "id": [i for i, _ in part], "kind": [k for _, k in part]}), state)
                    both += out["consumed"].tolist()
            assert both == want[p]


class Store:
    """Map state and timers of one group of devices, in memory."""

    def __init__(self):
        self.map, self.timers, self.writes = {}, [], 0

    def getMapState(self, name, key, value, ttl=None):
        return self

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value
        self.writes += 1

    def removeKey(self, key):
        del self.map[key]

    def iterator(self):
        return iter(self.map.items())

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, ms):
        self.timers.append(ms)


class Times:
    def __init__(self, now=0):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def _in_parts(carry, rows, columns, cuts):
    """``rows`` (devices among one another) to a group of the carry in parts: its output and its store."""
    import pandas as pd

    store, out = Store(), []
    carry.init(store)
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        if b > a:
            part = pd.DataFrame(rows[a:b], columns=columns)
            out += list(carry.handleInputRows((3,), iter([part.assign(_shard=3)]), Times()))
    return pd.concat(out, ignore_index=True), store


@pytest.mark.parametrize("cuts", [[], [40], [1, 2, 75]])
def test_one_call_moves_many_devices_on(cuts):
    """Deltas and labels of a group of devices are those of a plain loop over each, in any parts."""
    rnd = random.Random(5)
    turns = sorted((c, b) for b in range(20) for c in range(6))
    deltas = [(b, c, ok, float(c * b), float(c + b)) if (ok := rnd.random() < 0.6) else (b, c, ok, None, None) for c, b in turns]
    out, store = _in_parts(ca.DeltaCarry(("p", "q"), ("dp", "dq")), deltas, ["batch", "cycle", "complete", "p", "q"], cuts)
    got = {(r.batch, r.cycle): (r.dp, r.dq) for r in out.itertuples()}
    last = {}
    for b, c, ok, p, q in deltas:
        want = (p - last.get(b, (0, 0))[0], q - last.get(b, (0, 0))[1]) if ok else None
        assert got[b, c] == want if ok else all(x != x for x in got[b, c])
        last |= {b: (p, q)} if ok else {}
    assert {k[0]: v[1:] for k, v in store.map.items()} == last

    marks = [(b, c, side, 2 * c + side, rnd.choice(["Fresh", "Aging", None]) if not side else None, None, None) for c, b in turns for side in (0, 1) if rnd.random() < 0.7]
    out, store = _in_parts(ca.LabelCarry(), marks, ["batch", "us", "side", "id", "nir_label", "event_type", "value"], [])
    again, _ = _in_parts(ca.LabelCarry(), marks, ["batch", "us", "side", "id", "nir_label", "event_type", "value"], [i for i, (a, b) in enumerate(zip(marks, marks[1:]), 1) if a[1] != b[1]])
    want, last = {}, {}
    for b, _us, side, i, label, *_ in marks:
        if side:
            want[b, i] = last.get(b)
        else:
            last[b] = label
    for o in (out, again):
        assert {(r.batch, r.id): r.nir_label if isinstance(r.nir_label, str) else None for r in o.itertuples()} == want


def test_polls_of_many_devices_are_one_call_and_end_by_event_time():
    poll_us = ca.POLL_SECONDS * 1_000_000
    kinds = {0: ["status", "reading", "status"], 1: ["status"] * 7, 2: ["error", "reading"]}
    want = {0: [True, True, False], 1: [True] * 5 + [False] * 2, 2: [True, False]}
    rows = [(d, p, p * poll_us + i, i, kinds[(d + p) % 3][i]) for p in range(4) for i in range(7) for d in range(9) if i < len(kinds[(d + p) % 3])]
    for cuts in ([], [17], [5, 30, 90]):
        carry = ca.PollCarry()
        out, store = _in_parts(carry, rows, ["batch", "poll", "us", "id", "kind"], cuts)
        got = {}
        for r in out.sort_values(["batch", "poll", "us"]).itertuples():
            got.setdefault((r.batch, r.poll), []).append(bool(r.consumed))
        assert got == {(d, p): want[(d + p) % 3] for d in range(9) for p in range(4)}
        assert store.writes <= 9 * (len(cuts) + 1) and set(store.timers) <= {(p + 1) * ca.POLL_SECONDS * 1000 for p in range(4)}
        list(carry.handleExpiredTimer((3,), Times(3 * ca.POLL_SECONDS * 1000), None))
        assert {tuple(v[0]) for v in store.map.values()} == {(3,)}
        list(carry.handleExpiredTimer((3,), Times(4 * ca.POLL_SECONDS * 1000), None))
        assert not store.map


def test_one_call_assembles_the_cycles_of_many_devices():
    import pandas as pd

    class State:
        hasTimedOut, exists, now = False, False, 0

        def update(self, value):
            self.get, self.exists = value, True

        def setTimeoutTimestamp(self, ms):
            self.due = ms

        def remove(self):
            self.exists = False

        def getCurrentWatermarkMs(self):
            return self.now

    s = 1_000_000
    rows = [(1, 1, "node1", 1.0, 20 * s, 0), (1, 2, "node2", 2.0, 30 * s, 0), (1, 3, "node1", 9.0, 40 * s, 0),  # closes; the third is late
            (2, 4, "node1", 3.0, 5 * s, 0), (2, 5, "node1", 4.0, 9 * s, 0),  # one node
            (2, 6, "node2", 5.0, 1000 * s, 900 * s), (3, 7, "node1", 6.0, 200 * s, 0)]  # after its deadline
    state = State()
    first = pd.concat(fd._assemble_cycles((7,), iter([pd.DataFrame(rows, columns=["batch", "id", "node", "value", "us", "cycle_us"])]), state))
    assert first[["batch", "cycle_us", "node1_value", "node2_value", "status", "sync_offset_s"]].values.tolist() == [[1, 0, 1.0, 2.0, "both", 10.0]]
    assert sorted(zip(*state.get[:2])) == [(1, 0), (2, 0), (2, 900 * s)] and state.due == 105_000
    state.hasTimedOut, state.now = True, 105_000
    second = pd.concat(fd._assemble_cycles((7,), iter([]), state))
    assert second[["batch", "cycle_us", "node1_value", "n_nodes", "status"]].values.tolist() == [[2, 0, 4.0, 1, "expired"]]
    assert list(zip(*state.get[:2])) == [(2, 900 * s)] and state.due == 1_005_000
    state.now = 1_005_000
    assert [len(f) for f in fd._assemble_cycles((7,), iter([]), state)] == [1] and not state.exists


def test_files_and_micro_batches_of_the_ingest_do_not_follow_the_batches(spark, tmp_path):
    from ripestream.plans import streams

    ids = spark.range(400).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"),
                                  F.when(F.col("id") != 7, F.col("id")).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"))
    ids.write.parquet(f"{tmp_path}/events.parquet")
    totals = {}
    base = streams._ingest(spark, str(tmp_path), totals)
    files = [f for _, _, names in os.walk(f"{base}/in".removeprefix("file:")) for f in names if f.endswith(".txt")]
    assert len(files) < 64 and totals["batches"] == 1
    seen = [r["batch"] for part in ("accepted", "rejects") for r in spark.read.parquet(f"{base}/{part}").select("batch").collect()]
    assert sorted(seen, key=str) == sorted([b if b != 7 else None for b in range(400)], key=str)


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
