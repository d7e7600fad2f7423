"""Structured Streaming versions of the feed operators.

Source contract: files arrive in time order, that is a micro-batch holds no row
older than the rows of earlier ones by more than the stream's lateness.
``replay`` keeps it for bounded tables, whatever their files hold: the rows are
written to the source folder in time slices, and the query runs once
(``availableNow``) after each slice, always from the same checkpoint, so every
run but the first is a restart.  Rows that break the contract are never dropped
in silence: a run that lost rows to the watermark, or an ordered stream that
meets a row older than its state, fails.

Event time is the wall clock read as UTC, so results don't depend on the
session's zone.  State is kept in the state store.  Sinks write one folder per
micro-batch and overwrite it on a retry.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ripestream.functions.clock import from_wall_micros, wall_micros
from ripestream.session import scratch_path
from ripestream.streaming.carries import SHARD, LateRows, shard_of

# Fixed values of the cycle protocol.
CYCLE_SECONDS = 900
WARMUP_SECONDS = 15
RECEIVE_WINDOW_SECONDS = 90


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream under the shared checkpoint folder."""
    return scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}")


def event_time(ts: str | Column) -> Column:
    """Wall clock as event time (read as UTC in every session zone)."""
    return F.timestamp_micros(wall_micros(ts))


def clock_time(ts: str | Column) -> Column:
    """Event time back to the wall clock."""
    return from_wall_micros(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts))


class RunTotals(StreamingQueryListener):
    """Sums over every micro-batch of a run: rows read, rows lost to the watermark, observed metrics by name."""

    def __init__(self) -> None:
        self.by_run: dict[str, dict] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _of(self, run: str) -> dict:
        with self.lock:
            self.ended.setdefault(run, threading.Event())
            return self.by_run.setdefault(run, {"batches": 0, "rows": 0, "late": 0, "observed": {}})

    def onQueryStarted(self, event) -> None:
        self._of(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self._of(str(p.runId))
        own["batches"] += 1
        own["rows"] += max(p.numInputRows, 0)
        own["late"] += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        for name, row in (p.observedMetrics or {}).items():
            sums = own["observed"].setdefault(name, {})
            for k, v in row.asDict().items():
                sums[k] = sums.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._of(str(event.runId))
        self.ended[str(event.runId)].set()

    def wait_for(self, run: str, seconds: float = 60.0) -> dict:
        """The sums of a run that has ended; events come in order, so its last progress is in."""
        own = self._of(run)
        if not self.ended[run].wait(seconds):
            raise RuntimeError("the end of the stream was not reported")
        return own


def run_once(writer, base: str, totals: dict | None = None) -> None:
    """Process what is there with the stream's checkpoint; fail if rows were lost to the watermark.

    What the run counted is added to ``totals`` (batches, rows, late, observed).
    """
    spark = SparkSession.active()
    listener = RunTotals()
    spark.streams.addListener(listener)
    try:
        q = writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException as e:
            if LateRows.__name__ in str(e):  # raised by a carry, in a worker
                raise LateRows(str(e).split(LateRows.__name__ + ": ", 1)[-1].splitlines()[0]) from e
            raise
        got = listener.wait_for(str(q.runId))
    finally:
        spark.streams.removeListener(listener)
    if totals is not None:
        for k in ("batches", "rows", "late"):
            totals[k] = totals.get(k, 0) + got[k]
        for name, sums in got["observed"].items():
            own = totals.setdefault("observed", {}).setdefault(name, {})
            for k, v in sums.items():
                own[k] = own.get(k, 0) + v
    if got["late"]:
        raise LateRows(f"{got['late']} rows were older than the watermark; raise the lateness or feed files in time order")


def to_parquet(sdf: DataFrame, base: str, mode: str = "append", totals: dict | None = None) -> None:
    """One run into ``base``/out: appended by the file sink, or one folder per micro-batch, overwritten on a retry."""
    if mode == "append":
        run_once(sdf.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append"), base, totals)
    else:
        run_once(sdf.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/batch_id={i}")).outputMode(mode), base, totals)


def replay(spark: SparkSession, name: str, sources: dict[str, DataFrame], ts: str, build: Callable[[dict[str, DataFrame]], DataFrame],
           sink: Callable[..., None] = to_parquet, slices: int = 3, flush: dict[str, DataFrame] | None = None, base: str | None = None, totals: dict | None = None) -> DataFrame:
    """Run a stream over bounded tables slice by slice in time order; the result table.

    ``flush`` rows are fed last: far ahead in time, they move the watermark past
    every other row, so nothing stays open.  Null times go with the first slice.
    """
    base = base or run_dir(spark, name)
    main = next(iter(sources.values()))
    t = wall_micros(ts)
    cuts = main.agg(F.percentile_approx(t, [i / slices for i in range(1, slices)], 1000)).first()[0] if slices > 1 else []
    edges = sorted(set(cuts or []))
    turn = uuid.uuid4().hex[:6]  # of this replay: a stream may be fed again
    number = F.lit(0)
    for e in edges:
        number = number + F.coalesce((t >= e).cast("int"), F.lit(0))
    for k, df in sources.items():
        df.withColumn("_slice", number).write.partitionBy("_slice").parquet(f"{base}/in/{k}/{turn}")
    for k, df in (flush or {}).items():
        df.write.parquet(f"{base}/in/{k}/{turn}/_slice={len(edges) + 1}")
    for i in range(len(edges) + 1 + bool(flush)):
        seen = ",".join(map(str, range(i + 1)))
        streams = {k: spark.readStream.schema(df.schema).option("basePath", f"{base}/in/{k}/{turn}").parquet(f"{base}/in/{k}/{turn}/_slice={{{seen}}}").select(*df.columns) for k, df in sources.items()}
        sink(build(streams), base, totals=totals)
    return spark.read.parquet(f"{base}/out")


# ------------------------------------------------------------------ J3
CYCLE_OUT = "batch long, cycle_us long, node1_value double, node2_value double, n_nodes int, status string, sync_offset_s double"
CYCLE_STATE = "batch array<bigint>, cycle_us array<bigint>, node1_value array<double>, node1_us array<bigint>, node2_value array<double>, node2_us array<bigint>, closed array<boolean>"
DEADLINE_US = (WARMUP_SECONDS + RECEIVE_WINDOW_SECONDS) * 1_000_000


def _assemble_cycles(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per (device, cycle): the last packet of each node wins (F11); the cycle closes as soon as
    warm-up is over and both nodes are in (packets during warm-up count), else at the event-time
    deadline = start + warm-up + receive window, with the missing node empty (J3).  Packets after
    the close or the deadline are late and not counted (J4); a closed cycle keeps a tombstone
    until its deadline so late packets cannot reopen it.  Times are wall-clock microseconds.

    One call serves a group of devices.  Its state holds the cycles whose deadline is not over;
    the group is called again when the first of them is.
    """
    now = state.getCurrentWatermarkMs()
    cycles = {(b, start): list(cell) for b, start, *cell in zip(*state.get)} if state.exists else {}
    out = []

    def emit(batch: int, start: int, v1: float | None, t1: int | None, v2: float | None, t2: int | None) -> None:
        n = int(t1 is not None) + int(t2 is not None)
        out.append((batch, start, v1, v2, n, "both" if n == 2 else "expired", abs(t1 - t2) / 1e6 if n == 2 else None))

    if not state.hasTimedOut:
        rows = pd.concat(list(pdfs), ignore_index=True)
        rows = rows[rows["us"] <= rows["cycle_us"] + DEADLINE_US].sort_values(["us", "id"])
        for batch, start, us, node, value in zip(*(rows[c].tolist() for c in ("batch", "cycle_us", "us", "node", "value"))):
            cell = cycles.setdefault((batch, start), [None, None, None, None, False])
            if cell[4]:
                continue
            warm = us >= start + WARMUP_SECONDS * 1_000_000
            if not (warm and cell[1] is not None and cell[3] is not None):
                cell[0 if node == "node1" else 2], cell[1 if node == "node1" else 3] = value, us
            if warm and cell[1] is not None and cell[3] is not None:
                cell[4] = True
                emit(batch, start, *cell[:4])
    for (batch, start), cell in list(cycles.items()):
        if (start + DEADLINE_US) // 1000 <= now:  # nothing else can come
            del cycles[batch, start]
            if not cell[4]:
                emit(batch, start, *cell[:4])
    if cycles:
        state.update(tuple(map(list, zip(*((*at, *cell) for at, cell in cycles.items())))))
        state.setTimeoutTimestamp((min(start for _, start in cycles) + DEADLINE_US) // 1000)
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["batch", "cycle_us", "node1_value", "node2_value", "n_nodes", "status", "sync_offset_s"])


def assemble_cycles_stream(packets: DataFrame, watermark: str = "30 minutes") -> DataFrame:
    """Stateful cycle assembly over a packet stream (batch, id, ts, node, value).

    Packets without device or time belong to no cycle, as in the batch form.
    """
    p = packets.select("batch", "id", "node", "value", wall_micros("ts").alias("us"), event_time("ts").alias("event_time")).where("batch is not null and us is not null")
    p = p.withColumn("cycle_us", F.floor(F.col("us") / (CYCLE_SECONDS * 1_000_000)) * (CYCLE_SECONDS * 1_000_000))
    out = p.withColumn(SHARD, shard_of("batch")).withWatermark("event_time", watermark).groupBy(SHARD).applyInPandasWithState(
        _assemble_cycles, CYCLE_OUT, CYCLE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("cycle_start", from_wall_micros(F.col("cycle_us"))).drop("cycle_us")


# ------------------------------------------------------------------ J8
def cadence_windows(stream: DataFrame, key: str, ts: str, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Readings per key per tumbling window."""
    s = stream.select(key, event_time(ts).alias("event_time")).withWatermark("event_time", watermark)
    return s.groupBy(key, F.window("event_time", window)).agg(F.count(F.lit(1)).alias("n")).select(
        key, clock_time("window.start").alias("window_start"), "n")


def outage_sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", watermark: str = "2 hours") -> DataFrame:
    """Activity sessions per key: a gap longer than ``gap`` starts a new session (outage detection, J8)."""
    s = stream.select(key, event_time(ts).alias("event_time")).withWatermark("event_time", watermark)
    return s.groupBy(key, F.session_window("event_time", gap)).agg(F.count(F.lit(1)).alias("n")).select(
        key, clock_time("session_window.start").alias("session_start"), clock_time("session_window.end").alias("session_end"), "n")


# ------------------------------------------------------------------ D9
def interval_join_stream(left: DataFrame, right: DataFrame, key: str, lookback: str, watermark: str) -> DataFrame:
    """Stream-stream left outer join of each left row with the right rows of the same key in
    ``[left.ts - lookback, left.ts]`` (D9).  Both sides carry a watermark so the join state is
    bounded by ``watermark + lookback``; picking the latest match per left row happens in the sink
    (see :func:`latest_match`)."""
    l = left.withColumn("ts", event_time("ts")).withWatermark("ts", watermark).alias("l")
    r = (right.withColumnRenamed(key, "r_key").withColumnRenamed("ts", "r_ts")
         .withColumn("r_ts", event_time("r_ts")).withWatermark("r_ts", watermark).alias("r"))
    cond = (F.col(f"l.{key}") == F.col("r.r_key")) & (F.col("r.r_ts") <= F.col("l.ts")) & (
        F.col("r.r_ts") >= F.col("l.ts") - F.expr(f"INTERVAL {lookback}"))
    return l.join(r, cond, "leftOuter")


def latest_match(pairs: DataFrame, left_id: str, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """One row per left id: the right columns of the latest matching right row, the larger ``oid`` on equal times (NULL if none)."""
    return pairs.groupBy(left_id).agg(
        *[F.first(c).alias(c) for c in left_cols if c != left_id],
        *[F.max_by(c, F.struct("r_ts", "oid")).alias(c) for c in right_cols])
