"""Streaming twins of the stateful operators, and an endless batch source.

Built on file streams; each returns a streaming DataFrame, ``drained`` runs one
to its end for tests and backfills. State is per key and bounded: one number for
the sampler and the limiter, one row for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", glob).parquet(path)


def drained(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a streaming DataFrame gives for all data there is now."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def deduplicated(df: DataFrame, digest: str, ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of each digest within the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([digest])


def hits_per_window(df: DataFrame, key: str, ts: str, seconds: int = 60, delay: str = "0 seconds") -> DataFrame:
    return df.withWatermark(ts, delay).groupBy(F.window(ts, f"{seconds} seconds")["start"].alias("window_start"), key).agg(F.count("*").alias("hits"))


def rate_limited(df: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """(key, ts, hit, allowed) with a fixed window per key that starts anew on the first hit after its end."""
    kinds = dict(df.dtypes)

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState):
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(ts)
        hits = []
        for t in rows[ts]:
            s = t.timestamp() // seconds * seconds
            if start is None or s > start:
                start, n = s, 0
            n += 1
            hits.append(n)
        state.update((float(start), n))
        yield pd.DataFrame({key: k[0], ts: rows[ts].to_numpy(), "hit": hits, "allowed": [h <= limit for h in hits]})

    return df.select(key, ts).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {ts} timestamp, hit int, allowed boolean", "start double, n int", "append", GroupStateTimeout.NoTimeout)


def delta_sampled(df: DataFrame, key: str, order: str, value: str, threshold: float) -> DataFrame:
    """(key, order, value) of rows that differ from the last kept one by more than the threshold."""
    kinds = dict(df.dtypes)

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        keep = []
        for v in rows[value]:
            ok = last is None or abs(v - last) > threshold
            last = v if ok else last
            keep.append(ok)
        state.update((float(last),))
        yield rows[keep][[key, order, value]]

    return df.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double", "last double", "append", GroupStateTimeout.NoTimeout)


def sessions(df: DataFrame, key: str, ts: str, kind: str, final: str, hours: int = 24) -> DataFrame:
    """(key, status, n): a session's status after each batch that touches it; open ones expire by event time."""
    kinds = dict(df.dtypes)

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            n = state.get[1]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "status": ["expired"], "n": [n]})
            return
        first, n, done = state.get if state.exists else (None, 0, False)
        for rows in batches:
            t = int(rows[ts].min().timestamp() * 1000)
            first = t if first is None else min(first, t)
            n += len(rows)
            done = done or bool((rows[kind] == final).any())
        state.update((first, n, done))
        if not done:
            state.setTimeoutTimestamp(max(first + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "status": ["finalized" if done else "open"], "n": [n]})

    return df.withWatermark(ts, "0 seconds").select(key, ts, kind).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, status string, n long", "first long, n long, done boolean", "update", GroupStateTimeout.EventTimeTimeout)


class _Slice(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceStreamReader):
    def __init__(self, n: int, size: int, per_trigger: int):
        self.n, self.size, self.per_trigger, self.at = n, size, per_trigger, 0

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        self.at += self.per_trigger
        return {"batch": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["batch"])
        return [_Slice(k, k + 1) for k in range(start["batch"], end["batch"])]

    def read(self, partition: _Slice):
        for k in range(partition.lo, partition.hi):
            for pos in range(self.size):
                i = k * self.size + pos
                yield (k, k * self.size, pos, i % self.n)

    def commit(self, end: dict) -> None:
        pass


class CyclicBatches(DataSource):
    """Endless stream (batch_id, start_offset, pos, entry_idx); offsets are checkpointed, so undelivered batches are replayed. Options: n, size, perTrigger."""

    @classmethod
    def name(cls) -> str:
        return "cyclic_batches"

    def schema(self) -> str:
        return "batch_id long, start_offset long, pos int, entry_idx long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(int(self.options["n"]), int(self.options["size"]), int(self.options.get("perTrigger", 1)))
