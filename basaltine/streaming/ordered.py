"""Stateful streams that do not depend on the order of arrival: delivery in order, and folds that wait for the watermark.

All keep their state in Spark's state store (``transformWithState``; it needs the RocksDB
provider, see ``keyed_state``), so a restarted query goes on where its checkpoint stands.

* ``delivered_in_order``: batches of a stream reach their consumer in order of offset, however
  they arrive. A map state holds those that wait, by blocks of offsets, a value state the last ones delivered.
* ``sampled_in_order``, ``first_of``, ``session_lives``: rows wait until the watermark has passed
  them (an event-time timer); then they are folded in order of time. So rows may be late by as
  much as the watermark's delay, and the result is that of the batch operator on all rows. A key that has
  been idle for ``idle`` (by event time) leaves the state; a later row begins it anew.

Rows without key, time or (for the sampler) value are left out; rows later than the watermark are dropped by
Spark, as everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Set the session's state store to the one that several states a key, and timers, need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def _time(us: int | None):
    return pd.NaT if us is None else pd.Timestamp(us, unit="us")


#: Batches that travel as one row; that wait in a task's memory; that are one value of the state.
PACKED, HELD, BLOCK = 32, 1 << 19, 1 << 14


def _packed(rows: DataFrame, stream: list[str]) -> DataFrame:
    """Rows (stream, start, ready) with up to PACKED of a stream as one: their numbers one after another, as bytes."""
    kinds = StructType([*(rows.schema[s] for s in stream), StructField("start", BinaryType()), StructField("ready", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.select(stream)
            code = keys.to_pandas().groupby(stream, sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            code, first = code[order], np.searchsorted(code[order], np.arange(code.max() + 1))
            cuts = np.flatnonzero((np.arange(len(code)) - first[code]) % PACKED == 0)
            ends = [*cuts[1:].tolist(), len(code)]
            numbers = [b.column(n).to_numpy()[order].astype(np.int64) for n in ("start", "ready")]
            parts = [pa.array([x[i:j].tobytes() for i, j in zip(cuts.tolist(), ends, strict=True)], pa.binary()) for x in numbers]
            yield pa.RecordBatch.from_arrays([*keys.take(pa.array(order[cuts])).columns, *parts], [*stream, "start", "ready"])

    return rows.select(*stream, "start", "ready").mapInArrow(run, kinds)


def _first(place: np.ndarray, ready: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In order of place; of equal ones the first."""
    place, at = np.unique(place, return_index=True)
    return place, ready[at]


class _Delivery(StatefulProcessor):
    """State: ``waiting`` (number of a block of offsets -> places and times of those that wait in it), ``last`` (how many are delivered, and when the last ``prefetch`` of them).

    Neither a stream nor what waits of it is held whole: rows come in batches, and when more wait than HELD, they go to the state, a block a value.
    """

    def __init__(self, names: list[str], size: int, prefetch: int):
        self.names, self.size, self.prefetch = names, size, prefetch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "block long", "place binary, ready binary")
        self.last = handle.getValueState("last", "n long, delivered binary")

    def _stored(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(x, np.int64) for x in self.waiting.getValue((block,)))

    def _delivered(self, key, ready: np.ndarray) -> pd.DataFrame:
        """The next ones, whose times of being ready are given."""
        before = len(self.recent)
        line = np.concatenate([self.recent, np.maximum.accumulate(np.concatenate([self.recent[-1:], ready]))[min(before, 1) :]])
        delivered, none = line[before:], max(0, min(len(ready), self.prefetch - before))
        opened = before - self.prefetch + np.arange(none, len(ready))
        admitted = np.concatenate([np.zeros(none, np.int64), line[opened]])
        first = np.arange(len(ready)) < none
        place = self.n + np.arange(len(ready))
        # The last one stands for all before it, even if none is admitted by it.
        self.n, self.recent = self.n + len(ready), line[-max(1, self.prefetch) :]
        return pd.DataFrame({**dict(zip(self.names, key, strict=True)), "start": place * self.size, "ready": ready, "delivered": delivered, "admitted": pd.arrays.IntegerArray(admitted, first), "waited": ~first & (ready < admitted)})

    def _advance(self, key, place: np.ndarray, ready: np.ndarray, blocks: set[int]) -> Iterator[pd.DataFrame | tuple[np.ndarray, np.ndarray]]:
        """What can be delivered now; at last (places, times) of what waits in memory."""
        place, ready = _first(place, ready)
        while True:
            block = self.n // BLOCK
            to = np.searchsorted(place, (block + 1) * BLOCK)
            own = place[:to], ready[:to]
            if block in blocks:
                own = _first(*(np.concatenate(x) for x in zip(self._stored(block), own, strict=True)))
            run = int((own[0] == self.n + np.arange(len(own[0]))).sum())
            if not run:
                yield place, ready
                return
            done = self._delivered(key, own[1][:run])
            if block in blocks:
                # What was stored of the block and still waits is in memory again.
                self.waiting.removeKey((block,))
                blocks.remove(block)
            place, ready = (np.concatenate([x[run:], y[to:]]) if run < len(x) else y[to:] for x, y in zip(own, (place, ready), strict=True))
            yield done

    def _store(self, place: np.ndarray, ready: np.ndarray, blocks: set[int]) -> None:
        for block, at in zip(*np.unique(place // BLOCK, return_index=True), strict=True):
            k, to = int(block), np.searchsorted(place, (block + 1) * BLOCK)
            own = place[at:to], ready[at:to]
            if k in blocks:
                own = _first(*(np.concatenate(x) for x in zip(self._stored(k), own, strict=True)))
            self.waiting.updateValue((k,), tuple(x.tobytes() for x in own))
            blocks.add(k)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.n, packed = self.last.get() if self.last.exists() else (0, b"")
        self.recent, began = np.frombuffer(packed, np.int64), self.n
        blocks = {k[0] for k in self.waiting.keys()} if self.waiting.exists() else set()
        parts, many = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        for pdf in rows:
            start, ready = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("start", "ready"))
            # A batch that is sent again is known; one between two offsets is never next.
            new = (start % self.size == 0) & (start >= self.n * self.size)
            parts.append((start[new] // self.size, ready[new]))
            many += int(new.sum())
            if many >= HELD:
                for got in self._advance(key, *joined(), blocks):
                    if isinstance(got, pd.DataFrame):
                        yield got
                    else:
                        parts = [got]
                if len(parts[0][0]) > HELD // 2:
                    self._store(*parts[0], blocks)
                    parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
                many = len(parts[0][0])
        for got in self._advance(key, *joined(), blocks):
            if isinstance(got, pd.DataFrame):
                yield got
            else:
                self._store(*got, blocks)
        if self.n > began:
            self.last.update((int(self.n), self.recent.tobytes()))

    def close(self) -> None:
        pass


def delivered_in_order(df: DataFrame, stream: list[str], offset: str, ready: str, size: int, prefetch: int) -> DataFrame:
    """(stream, offset, ready, delivered, admitted, waited) of each batch once it and all before it are there; as ``dataset.ordered_delivery``.

    Offsets of a stream are 0, size, 2 * size and so on; one that is sent again is ignored. A batch is admitted when its offset is
    at most ``size * prefetch`` beyond the last delivered one, which is when ``admitted`` stands. If producers wait for that, no more
    than ``prefetch`` batches wait in the state; those of a producer that runs ahead are held as well, and are ``waited``.
    """
    keyed_state(df.sparkSession)
    kinds = dict(df.dtypes)
    rows = df.select(*stream, F.col(offset).cast("long").alias("start"), F.unix_micros(F.col(ready).cast("timestamp")).alias("ready")).dropna()
    schema = ", ".join(f"{s} {kinds[s]}" for s in stream) + ", start long, ready long, delivered long, admitted long, waited boolean"
    got = _packed(rows, stream).groupBy(*stream).transformWithStateInPandas(_Delivery(stream, size, prefetch), schema, "Append", "None")
    times = (F.timestamp_micros(c).alias(n) for c, n in (("ready", ready), ("delivered", "delivered"), ("admitted", "admitted")))
    return got.select(*stream, F.col("start").alias(offset), *times, "waited")


class _Waiting(StatefulProcessor):
    """Rows (time, tie, value) wait in a list until the watermark has passed them and are folded in that order.

    One timer for each key stands at the earliest waiting row, or, where none waits, at the end of the key's idle time.
    """

    def __init__(self, key: str, idle_ms: int):
        self.key, self.idle = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, tie long, value double")
        self.fold_state = handle.getValueState("fold", "value double")
        self.seen = handle.getValueState("seen", "at long")

    def fold(self, state: float | None, rows: list[tuple]) -> tuple[float | None, list[tuple]]:
        raise NotImplementedError

    def _set_timer(self, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(_micros(t), tie, value) for pdf in rows for t, tie, value in zip(pdf["at"], pdf["tie"].tolist(), pdf["value"].tolist(), strict=True)]
        if new:
            self.rows.appendList(new)
            first = min(r[0] for r in self.rows.get())
            self._set_timer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.rows.get()) if self.rows.exists() else []
        ready = sorted(tuple(r) for r in held if r[0] < passed)
        rest = [tuple(r) for r in held if r[0] >= passed]
        state = self.fold_state.get()[0] if self.fold_state.exists() else None
        if ready:
            state, out = self.fold(state, ready)
            if state is not None:
                self.fold_state.update((state,))
            self.seen.update((ready[-1][0],))
            if out:
                yield pd.DataFrame([(*key, _time(t), tie, value) for t, tie, value in out], columns=[self.key, "at", "tie", "value"])
        if rest:
            self.rows.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
            return
        self.rows.clear()
        gone = self.seen.get()[0] // 1000 + self.idle if self.seen.exists() else 0
        if gone > passed // 1000:
            self.handle.registerTimer(gone)
        else:
            self.fold_state.clear()
            self.seen.clear()

    def close(self) -> None:
        pass


class _Sampler(_Waiting):
    def __init__(self, key: str, idle_ms: int, threshold: float):
        super().__init__(key, idle_ms)
        self.threshold = threshold

    def fold(self, state, rows):
        out = []
        for r in rows:
            if state is None or abs(r[2] - state) > self.threshold:
                state = r[2]
                out.append(r)
        return state, out


class _First(_Waiting):
    def fold(self, state, rows):
        return 0.0, [] if state is not None else rows[:1]


def _folded(df: DataFrame, processor: _Waiting, key: str, ts: str, tie: str, value, delay: str) -> DataFrame:
    keyed_state(df.sparkSession)
    rows = df.select(F.col(key), F.col(ts).alias("at"), F.col(tie).cast("long").alias("tie"), value.cast("double").alias("value")).dropna()
    schema = f"{key} {dict(df.dtypes)[key]}, at timestamp, tie long, value double"
    got = rows.withWatermark("at", delay).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return got.withColumnRenamed("at", ts).withColumnRenamed("tie", tie)


def sampled_in_order(df: DataFrame, key: str, ts: str, tie: str, value: str, threshold: float, delay: str, idle_ms: int = 86_400_000) -> DataFrame:
    """(key, ts, tie, value) of rows that differ from the last kept one of their key by more than the threshold, in order of (ts, tie)."""
    return _folded(df, _Sampler(key, idle_ms, threshold), key, ts, tie, F.col(value), delay).withColumnRenamed("value", value)


def first_of(df: DataFrame, key: str, ts: str, tie: str, delay: str, idle_ms: int = 86_400_000) -> DataFrame:
    """(key, ts, tie) of the earliest row of each key, once no earlier one can come; later ones within ``idle`` of the last are repeats."""
    return _folded(df, _First(key, idle_ms), key, ts, tie, F.lit(0.0), delay).drop("value")


class _Lives(StatefulProcessor):
    """A session's earliest row, its number of rows and the time of its final one; its end is told once, by a timer."""

    def __init__(self, key: str, hours: int):
        self.key, self.span = key, hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, final boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.rows.appendList([(_micros(t), bool(f)) for pdf in rows for t, f in zip(pdf["at"], pdf["final"], strict=True)])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(min(r[0] for r in self.rows.get()) // 1000 + self.span)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rest, out = sorted(tuple(r) for r in self.rows.get()), []
        # The watermark may have passed the ends of several lives at once.
        while rest and rest[0][0] // 1000 + self.span <= timerValues.getCurrentWatermarkInMs():
            began = rest[0][0]
            end = began + self.span * 1000
            mine, rest = [r for r in rest if r[0] < end], [r for r in rest if r[0] >= end]
            done = [t for t, final in mine if final]
            n = sum(t <= done[0] for t, _ in mine) if done else len(mine)
            out.append((*key, _time(began), "finalized" if done else "expired", n))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "began", "status", "n"])
        if rest:
            self.rows.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + self.span)
        else:
            self.rows.clear()

    def close(self) -> None:
        pass


def session_lives(df: DataFrame, key: str, ts: str, final, delay: str, hours: int = 24) -> DataFrame:
    """(key, began, status, n): each session once, ``hours`` after its first row by event time: finalized, with the rows up to the first final one, or expired. The next row after that begins a new session."""
    keyed_state(df.sparkSession)
    rows = df.select(F.col(key), F.col(ts).alias("at"), final.alias("final")).dropna().withWatermark("at", delay)
    return rows.groupBy(key).transformWithStateInPandas(_Lives(key, hours), f"{key} {dict(df.dtypes)[key]}, began timestamp, status string, n long", "Append", "EventTime")
