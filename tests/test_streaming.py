"""Streaming twins give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from basaltine.operators import series
from basaltine.streaming import stateful


@pytest.fixture
def stream(spark, small, tmp_path):
    """Events in four files, in order of time."""
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("user_id is not null")
    path = str(tmp_path / "in")
    for k in range(4):
        e.where(F.col("event_id").between(k * 250, k * 250 + 249)).coalesce(1).write.mode("append").parquet(path)
    return e, stateful.file_stream(spark, path, e.schema), str(tmp_path)


def test_delta_sampler(stream):
    e, s, tmp = stream
    got = stateful.drained(stateful.delta_sampled(s, "user_id", "event_id", "value", 20.0), "sampled", f"{tmp}/c1")
    want = series.delta_sample(e.select("user_id", "event_id", "value"), "user_id", ["event_id"], "value", 20.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rate_limit(stream):
    e, s, tmp = stream
    got = stateful.drained(stateful.rate_limited(s, "event_type", "ts", 2, 3600), "limited", f"{tmp}/c2")
    assert got.count() == e.count()
    per = e.groupBy("event_type", F.window("ts", "1 hour")).count()
    assert got.where("allowed").count() == per.select(F.sum(F.least("count", F.lit(2)))).first()[0]


def test_dedup_and_windows(stream):
    e, s, tmp = stream
    got = stateful.drained(stateful.deduplicated(s.select("props", "ts"), "props", "ts", "60 days"), "dedup", f"{tmp}/c3")
    assert got.count() == e.select("props").distinct().count()
    hits = stateful.drained(stateful.hits_per_window(s, "event_type", "ts", 3600), "hits", f"{tmp}/c4", "update")
    assert hits.count() >= 1


def test_sessions(stream):
    e, s, tmp = stream
    got = stateful.drained(stateful.sessions(s, "user_id", "ts", "event_type", "purchase", 24), "lives", f"{tmp}/c5", "update")
    done = {r.user_id for r in e.where("event_type = 'purchase'").select("user_id").distinct().collect()}
    said = {}
    for r in got.collect():
        said.setdefault(r.user_id, set()).add(r.status)
    assert {k for k, v in said.items() if "finalized" in v} <= done


def test_cyclic_source(spark, tmp_path):
    spark.dataSource.register(stateful.CyclicBatches)
    s = spark.readStream.format("cyclic_batches").option("n", 10).option("size", 4).load()
    q = s.writeStream.format("memory").queryName("cyc").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    q.awaitTermination()
    rows = spark.table("cyc").orderBy("batch_id", "pos").collect()
    assert [r.entry_idx for r in rows] == [i % 10 for i in range(len(rows))] and rows
