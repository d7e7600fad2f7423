"""Keyed state of ordered streams: what a device carries from one micro-batch to the next.

Devices are dealt into ``SHARDS`` groups by hash.  A carry is a
``StatefulProcessor`` over a group with one entry a device in the state store: a
micro-batch reads and writes the devices it has rows for, and the store drops
its old versions itself.  All devices of a group are moved on in one call, so
calls don't grow with the number of devices.  The rows of a group in one
micro-batch are put in order by the processor; the trigger's limit bounds them.
A row older than what its device has seen breaks the feed's contract and ends
the stream with ``LateRows``.

``idle_ms`` lets a store forget devices that weren't written for so long (processing
time); by default a device stays.  Polls end by event time, and are forgotten then.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ripestream.operators.devices import flat_head, head_from, head_of, hidden_of, walk_samples
from ripestream.operators.models import Net
from ripestream.sources.messages import POLL_LINES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value of the collector: seconds between two polls.
POLL_SECONDS = 3180


class LateRows(RuntimeError):
    """A row came after its time had been closed."""


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed values need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def in_keyed_store(sink):
    """``sink`` with its streams' state in RocksDB."""
    def run(sdf: DataFrame, base: str, totals: dict | None = None) -> None:
        with keyed_store(sdf.sparkSession):
            sink(sdf, base, totals=totals)

    return run


#: Groups of devices; fixed, because the state of a stream is kept by group.
SHARDS = 512
SHARD = "_shard"


def shard_of(device: str) -> F.Column:
    """Group of a device; rows without a device are a group of their own."""
    return F.when(F.col(device).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(device), F.lit(SHARDS))).cast("int")


class Carry(StatefulProcessor):
    """One value a device; subclasses order the rows and move the values on."""

    state_schema = ""
    order: list[str] = []
    device, device_type = "batch", "bigint"

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getMapState("value", f"device {self.device_type}", self.state_schema, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).drop(columns=SHARD, errors="ignore").sort_values([self.device, *self.order], kind="stable", ignore_index=True)
        if key[0] < 0:
            starts, devices = np.zeros(1, np.int64), [None]
        else:
            ids = pdf[self.device].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            devices = ids[starts].tolist()
        found = [self.value.getValue((d,)) for d in devices]
        befores = [tuple(v) if v is not None else None for v in found]
        out, afters = self.steps(devices, pdf, starts, befores, timerValues)
        for d, before, after in zip(devices, befores, afters):
            if after is not None and after != before:
                self.value.updateValue((d,), after)
        yield out

    def steps(self, devices: list, rows: pd.DataFrame, starts: np.ndarray, befores: list[tuple | None], times) -> tuple[pd.DataFrame, list[tuple | None]]:
        """Rows of several devices, one behind the other from ``starts`` on: what comes out, and the value of each device after them."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n)


def _numbers(starts: np.ndarray, n: int) -> np.ndarray:
    """Number of each row's run, for runs that begin at ``starts``."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


class LabelCarry(Carry):
    """Latest optical label of each batch, put on the sensor rows behind it.

    Rows: (batch, us, side, id, nir_label, event_type, value); side 0 optical, 1 sensor.
    """

    state_schema = "us long, nir_label string"
    order = ["us", "side", "id"]
    out_schema = "batch long, id long, us long, event_type string, value double, nir_label string"

    def steps(self, devices, rows, starts, befores, times):
        us = rows["us"].to_numpy()
        for d, first, before in zip(devices, us[starts].tolist(), befores):
            if before is not None and first < before[0]:
                raise LateRows(f"LateRows: batch {d} has rows older than its last optical row")
        optical = (rows["side"] == 0).to_numpy()
        last = np.maximum.accumulate(np.where(optical, np.arange(len(rows)), -1))
        labels = rows["nir_label"].to_numpy(dtype=object)
        of = _numbers(starts, len(rows))
        kept = np.array([before[1] if before else None for before in befores], dtype=object)
        carried = np.where(last >= starts[of], labels[np.maximum(last, 0)], kept[of])
        out = rows.assign(nir_label=[x if isinstance(x, str) else None for x in carried])[~optical]
        afters = []
        for lo, at, before in zip(starts.tolist(), last[_ends(starts, len(rows)) - 1].tolist(), befores):
            afters.append((int(us[at]), labels[at] if isinstance(labels[at], str) else None) if at >= lo else before)
        return out[["batch", "id", "us", "event_type", "value", "nir_label"]], afters


class DeltaCarry(Carry):
    """Serving delta: the pair of readings of the last complete cycle, 0 before the first.

    Rows hold ``batch``, ``cycle``, ``complete`` and the two columns of ``pair``; they come out with the deltas behind them.
    """

    state_schema = "cycle long, p1 double, p2 double"
    order = ["cycle"]

    def __init__(self, pair: tuple[str, str], out: tuple[str, str], idle_ms: int | None = None) -> None:
        super().__init__(idle_ms)
        self.pair, self.out = pair, out

    def steps(self, devices, rows, starts, befores, times):
        cycle = rows["cycle"].to_numpy()
        for d, first, before in zip(devices, cycle[starts].tolist(), befores):
            if before is not None and first < before[0]:
                raise LateRows(f"LateRows: batch {d} has cycles older than its last complete one")
        done = np.flatnonzero(rows["complete"].to_numpy(dtype=bool))
        of = _numbers(starts, len(rows))[done]
        first = np.flatnonzero(np.diff(of, prepend=-1))  # first complete cycle of each device that has one
        last = np.flatnonzero(np.diff(of, append=len(starts)))
        rows, pairs = rows.copy(), []
        for i, (c, o) in enumerate(zip(self.pair, self.out)):
            own = rows[c].to_numpy(dtype=np.float64)[done]
            previous = np.concatenate([[0.0], own[:-1]])[: len(own)]
            previous[first] = [befores[d][1 + i] if befores[d] is not None else 0.0 for d in of[first].tolist()]
            delta = np.full(len(rows), np.nan)
            delta[done] = own - previous
            rows[o] = delta
            pairs.append(own[last].tolist())
        afters = list(befores)
        for d, at, *values in zip(of[last].tolist(), done[last].tolist(), *pairs):
            afters[d] = (int(cycle[at]), *values)
        return rows, afters


class HeadCarry(Carry):
    """Output layer of each device, moved on by every sample (J10); a row a device and micro-batch: (batch, version, n, loss, hits, first_loss, weights).

    Rows: (batch, turn, sample, y, x0, x1, ...).  ``loss`` and ``hits`` are sums before the steps.
    """

    state_schema = "turn long, version long, weights array<double>"
    order = ["turn", "sample"]
    out_schema = "batch long, version long, n long, loss double, hits long, first_loss double, weights array<double>"

    def __init__(self, flat: list[float], shape: tuple[int, int, int], lr: float, idle_ms: int | None = None) -> None:
        super().__init__(idle_ms)
        self.flat, self.shape, self.lr = flat, shape, lr

    def steps(self, devices, rows, starts, befores, times):
        net = Net.from_flat(self.flat, *self.shape)
        turn = rows["turn"].to_numpy()
        h = hidden_of(rows[[f"x{i}" for i in range(self.shape[0])]].to_numpy(dtype=np.float64), net)
        y, one = rows["y"].to_numpy(dtype=np.int64), np.ones(len(rows))
        out, afters = [], []
        for d, a, b, before in zip(devices, starts.tolist(), _ends(starts, len(rows)).tolist(), befores):
            if before is not None and turn[a] < before[0]:
                raise LateRows(f"LateRows: device {d} has samples older than the last one it learnt from")
            head = head_from(before[2], self.shape[2]) if before is not None else head_of(net)
            first, hit = walk_samples(head, h[a:a + 1], y[a:a + 1], one[a:a + 1], self.lr)
            loss, hits = walk_samples(head, h[a + 1:b], y[a + 1:b], one[a + 1:b], self.lr)
            version, weights = (before[1] if before is not None else 0) + 1, flat_head(head)
            out.append((d, version, b - a, first + loss, hit + hits, first, weights))
            afters.append((int(turn[b - 1]), version, weights))
        return pd.DataFrame(out, columns=["batch", "version", "n", "loss", "hits", "first_loss", "weights"]), afters


class PollCarry(Carry):
    """Lines that a poll reads: up to its first reading or error, five at most.

    A device's value holds its polls that may still get lines.  Rows hold ``poll``, ``us``, ``id``
    and ``kind`` and come out with ``consumed``.
    """

    state_schema = "polls array<bigint>, lines array<int>, over array<boolean>"
    order = ["poll", "us", "id"]

    @staticmethod
    def _end_ms(poll: int) -> int:
        return (poll + 1) * POLL_SECONDS * 1000

    def _read(self, kind: pd.Series, starts: np.ndarray, befores: list[tuple | None]) -> tuple[np.ndarray, list[tuple]]:
        """``consumed`` of the lines of polls that begin at ``starts``, and (lines read, whether it is over) of each poll after them."""
        n = len(kind)
        lines, over = (np.array([b[i] if b is not None else 0 for b in befores]) for i in (0, 1))
        of, over = _numbers(starts, n), over.astype(bool)
        ends = kind.isin(["reading", "error"]).to_numpy()
        until = np.concatenate([[0], np.cumsum(ends)])
        place = np.arange(n) - starts[of]
        consumed = ~over[of] & (until[:-1] == until[starts][of]) & (lines[of] + place < POLL_LINES)
        stops = _ends(starts, n)
        after = lines + np.add.reduceat(consumed.astype(np.int64), starts)
        over = over | (until[stops] > until[starts]) | (lines + stops - starts >= POLL_LINES)
        return consumed, list(zip(after.tolist(), over.tolist()))

    def step(self, key, rows, before):
        """Lines of one poll in order: the rows with ``consumed``, and the poll's value after them."""
        consumed, after = self._read(rows["kind"], np.zeros(1, np.int64), [before])
        return rows.assign(consumed=consumed), after[0]

    def steps(self, devices, rows, starts, befores, times):
        known = rows["poll"].notna().to_numpy()
        poll = rows["poll"].fillna(-1).to_numpy().astype(np.int64)
        first = np.zeros(len(rows), dtype=bool)
        first[starts] = True
        first[1:] |= (poll[1:] != poll[:-1]) | (known[1:] != known[:-1])
        begins = np.flatnonzero(first)
        of = _numbers(starts, len(rows))[begins].tolist()
        polls = [p if k else None for p, k in zip(poll[begins].tolist(), known[begins].tolist())]
        values = [dict(zip(b[0], zip(b[1], b[2]))) if b is not None else {} for b in befores]
        consumed, after = self._read(rows["kind"], begins, [values[d].get(p) for d, p in zip(of, polls)])
        for d, p, value in zip(of, polls, after):
            values[d][p] = value
        if known.any():
            due = self._end_ms(int(poll[known].max()))
            if due not in set(self.handle.listTimers()):
                self.handle.registerTimer(due)
        return rows.assign(consumed=consumed), [self._open(v, times.getCurrentWatermarkInMs()) for v in values]

    def _open(self, polls: dict, now: int) -> tuple[list, list, list]:
        left = [(p, *v) for p, v in polls.items() if p is None or self._end_ms(p) > now]
        return tuple(map(list, zip(*left))) if left else ([], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        for device, value in list(self.value.iterator()):  # polls that are over: their rows can't come any more
            left = self._open(dict(zip(value[0], zip(value[1], value[2]))), now)
            if not left[0]:
                self.value.removeKey(tuple(device))
            elif len(left[0]) < len(value[0]):
                self.value.updateValue(tuple(device), left)
        yield pd.DataFrame()


def carried(rows: DataFrame, keys: list[str], processor: Carry, out_schema, timed: bool = False) -> DataFrame:
    """``processor`` over the rows of each device, the first of ``keys``; further keys are told apart by the processor."""
    processor.device, processor.device_type = keys[0], rows.schema[keys[0]].dataType.simpleString()
    return rows.withColumn(SHARD, shard_of(keys[0])).groupBy(SHARD).transformWithStateInPandas(processor, outputStructType=out_schema, outputMode="Append", timeMode="EventTime" if timed else "None")


def with_columns(schema: T.StructType, **more: T.DataType) -> T.StructType:
    """``schema`` with further columns."""
    return T.StructType([*schema.fields, *[T.StructField(k, v) for k, v in more.items()]])


def poll_of(us) -> F.Column:
    return F.floor(us / (POLL_SECONDS * 1_000_000)).cast("long")
