"""Streams give what the batch operators give, whatever the order of arrival, restarts included."""

import random
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basaltine.operators import dataset, series
from basaltine.streaming import ordered, stateful

DAY = datetime(2024, 1, 1)


@pytest.fixture
def streamed(spark, tmp_path):
    """A function that writes parts one by one and runs a streaming plan after each, with one checkpoint."""

    def run(parts, schema, plan, name):
        path, spark_parts = str(tmp_path / f"{name}-in"), [spark.createDataFrame(p, schema) for p in parts]
        out = str(tmp_path / f"{name}-out")
        for k, part in enumerate(spark_parts):
            part.coalesce(1).write.mode("append").parquet(path)
            if k == 0 or k >= len(spark_parts) - 2:  # the query is started anew three times
                q = plan(stateful.file_stream(spark, path, part.schema)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
                q.awaitTermination()
        return spark.read.parquet(out)

    return run


def test_delivery(spark, streamed):
    g = random.Random(1)
    rows = [(s, 8 * k, DAY + timedelta(seconds=g.randint(0, 500) + 20 * k)) for s in ("a", "b") for k in range(30)]
    schema = "stream string, start long, ready timestamp"
    shuffled = [*rows, *rows[:5]]
    g.shuffle(shuffled)
    parts = [shuffled[i : i + 16] for i in range(0, len(shuffled), 16)]
    parts[1].append((None, 0, DAY))
    got = streamed(parts, schema, lambda s: ordered.delivered_in_order(s, ["stream"], "start", "ready", 8, 4), "delivery")
    want = dataset.ordered_delivery(spark.createDataFrame(rows, schema), ["stream"], "start", "ready", 4)
    names = ["stream", "start", "ready", "delivered", "admitted", "waited"]
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))
    assert got.where("waited").count() > 0


class Held(dict):
    """The states of one key."""

    def getMapState(self, name, *_):
        return self.setdefault(name, Map())

    def getValueState(self, name, *_):
        return self.setdefault(name, Value())


class Map(dict):
    exists = lambda self: bool(self)
    getValue = dict.get
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class Value(list):
    exists = lambda self: bool(self)
    get = lambda self: self[0]

    def update(self, v):
        self[:] = [v]


def delivering(state, size, prefetch):
    p = ordered._Delivery(["stream"], size, prefetch)
    p.init(state)
    return p


def packets(start, ready, many):
    for i in range(0, len(start), many):
        yield pd.DataFrame({"start": [x.astype(np.int64).tobytes() for x in np.array_split(start[i : i + many], 3)], "ready": [x.astype(np.int64).tobytes() for x in np.array_split(ready[i : i + many], 3)]})


@pytest.mark.parametrize("held, block, prefetch", [(1 << 19, 1 << 14, 3), (40, 16, 3), (7, 5, 1), (1, 1, 8), (40, 16, 600)])
def test_delivery_by_blocks(monkeypatch, held, block, prefetch):
    """Any order, gaps that are filled later, batches sent again and ones between two offsets, over many triggers: as if told one by one; nothing that was delivered stays in the state."""
    monkeypatch.setattr(ordered, "HELD", held)
    monkeypatch.setattr(ordered, "BLOCK", block)
    g = np.random.default_rng(held)
    ready = g.integers(-1000, 10**6, 500)
    place = np.concatenate([*(g.permutation(np.arange(i, min(i + 150, 500))) for i in range(0, 500, 100))])
    place = np.concatenate([place, g.permutation(500)])
    state, out = Held(), []
    for part in np.array_split(place, 9):
        starts = np.concatenate([part * 8, [3, -8, 8 * 499 + 4]])
        known = ready[np.clip(starts // 8, 0, 499)]
        out += [tuple(r) for pdf in delivering(state, 8, prefetch).handleInputRows(("a",), packets(starts, known, 50), None) for r in pdf.itertuples(index=False)]
    top = np.maximum.accumulate(ready)
    want = [("a", 8 * k, ready[k], top[k], top[k - prefetch] if k >= prefetch else None, k >= prefetch and ready[k] < top[k - prefetch]) for k in range(500)]
    assert [tuple(None if v is pd.NA else v for v in r) for r in out] == want
    assert not state["waiting"] and state["last"].get()[0] == 500


@pytest.mark.parametrize("order", ["forward", "backward"])
def test_delivery_holds_little(order):
    """1,500,000 batches of one stream, in order or all waiting for the last to come: few are in memory at once."""
    n, state, seen = 1_500_000, Held(), 0
    start = 8 * (np.arange(n) if order == "forward" else np.arange(n)[::-1])
    tracemalloc.start()
    for pdf in delivering(state, 8, 3).handleInputRows((1,), packets(start, start, 10_000), None):
        assert pdf["start"].iloc[0] == 8 * seen
        seen += len(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The state, which here is in memory too, has 16 bytes a waiting batch.
    assert seen == n and not state["waiting"] and peak < (60 if order == "forward" else 85) * 1_000_000


def late(rows, ts, delay, g):
    """Rows in an order in which none comes later than the delay allows, and a last part that moves the watermark on."""
    return sorted(rows, key=lambda r: r[ts] + timedelta(seconds=g.uniform(0, delay)))


@pytest.fixture
def events():
    g = random.Random(2)
    rows = [(g.choice(["x", "y", "z"]), DAY + timedelta(seconds=g.randint(0, 20_000)), i, g.uniform(0, 100)) for i in range(240)]
    return g, rows, "key string, ts timestamp, id long, value double"


def dealt(rows, g):
    moved = late(rows, 1, 3000, g)
    parts = [moved[i : i + 40] for i in range(0, len(moved), 40)]
    return [*parts, [("end", DAY + timedelta(days=9), 10**6, 0.0)]]


def test_sampler(spark, streamed, events):
    g, rows, schema = events
    got = streamed(dealt(rows, g), schema, lambda s: ordered.sampled_in_order(s, "key", "ts", "id", "value", 25.0, "2 hours"), "sampled")
    want = series.delta_sample(spark.createDataFrame(rows, schema), "key", ["ts", "id"], "value", 25.0)
    names = ["key", "ts", "id", "value"]
    assert sorted(map(str, got.where("key <> 'end'").select(names).collect())) == sorted(map(str, want.select(names).collect()))


def test_first(spark, streamed, events):
    g, rows, schema = events
    got = streamed(dealt(rows, g), schema, lambda s: ordered.first_of(s, "key", "ts", "id", "2 hours"), "first")
    want = {r.key: (r.m.ts, r.m.id) for r in spark.createDataFrame(rows, schema).groupBy("key").agg(F.min(F.struct("ts", "id")).alias("m")).collect()}
    assert {r.key: (r.ts, r.id) for r in got.where("key <> 'end'").collect()} == want


def test_lives(streamed, events):
    g, rows, schema = events
    got = streamed(dealt(rows, g), schema, lambda s: ordered.session_lives(s, "key", "ts", F.col("value") > 97, "2 hours", 1), "lives")
    want = []
    for key in "xyz":
        mine = sorted((r[1], r[3] > 97) for r in rows if r[0] == key)
        while mine:
            end = mine[0][0] + timedelta(hours=1)
            life = [r for r in mine if r[0] < end]
            done = [t for t, f in life if f]
            want.append((key, mine[0][0], "finalized" if done else "expired", sum(t <= done[0] for t, _ in life) if done else len(life)))
            mine = [r for r in mine if r[0] >= end]
    assert sorted(tuple(r) for r in got.where("key <> 'end'").select("key", "began", "status", "n").collect()) == sorted(want)


def test_idle_keys_leave():
    """The timer that ends a key's idle time clears all its state."""
    p = ordered._Sampler("key", 1000, 1.0)

    class State:
        def __init__(self, v=None):
            self.v = v

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def clear(self):
            self.v = None

    class Handle:
        timers = []

        def registerTimer(self, t):
            self.timers.append(t)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    p.handle, p.rows, p.fold_state, p.seen = Handle(), State(), State((5.0,)), State((4_000_000,))
    assert list(p.handleExpiredTimer(("k",), Now(4500), None)) == [] and p.handle.timers == [5000] and p.seen.exists()
    assert list(p.handleExpiredTimer(("k",), Now(5001), None)) == [] and not p.seen.exists() and not p.fold_state.exists()
    assert isinstance(ordered._time(None), type(pd.NaT))
