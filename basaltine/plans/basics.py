"""Filters, projections and small functions on the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import catalog, graph
from .registry import query


@query("SELECT l_orderkey, l_linenumber, l_extendedprice >= 50000 AS confident FROM lineitem WHERE l_extendedprice BETWEEN 0.005 * 4000000 AND 0.1 * 600000 AND l_quantity > 0")
def area_band(t):
    """A band of areas as a filter, a threshold as a column. Both tests reach the scan."""
    x = t("lineitem").where(F.col("l_extendedprice").between(0.005 * 4000000, 0.1 * 600000) & (F.col("l_quantity") > 0))
    return x.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") >= 50000).alias("confident"))


@query("SELECT event_id FROM events WHERE event_id BETWEEN 100 AND 250")
def frame_range(t):
    return t("events").where(F.col("event_id").between(100, 250)).select("event_id")


@query("SELECT event_id, value FROM events WHERE event_id IN (3, 5, 8, 13, 21, 34, 55, 89)")
def wanted_frames(t):
    """A wanted set, pushed to the scan."""
    from ..sources.files import frames

    return frames(t("events").select("event_id", "value"), "event_id", [3, 5, 8, 13, 21, 34, 55, 89])


@query("SELECT p_partkey FROM part WHERE list_has_any(list_transform(string_split(p_name, ' '), lambda x: lower(x)), ['red', 'ring'])")
def any_category(t):
    return t("part").where(catalog.any_category(F.split("p_name", " "), ["RED", "ring"])).select("p_partkey")


@query("""WITH f AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_id FROM f)
SELECT user_id, event_type, n, CAST(first_id AS BIGINT) AS first_id FROM o""")
def instance_union(t):
    """Lists of instances appended frame after frame: each frame's ids start where the ones before end."""
    f = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("user_id").rowsBetween(Window.unboundedPreceding, -1)
    return f.withColumn("first_id", F.coalesce(F.sum("n").over(w), F.lit(0)))


@query("SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(strlen(text)) / 1048576.0 / 0.5, 6) AS mb_per_s FROM documents GROUP BY source")
def throughput(t):
    """Bytes and rate for a time of half a second."""
    size = F.sum(F.octet_length("text"))
    return t("documents").groupBy("source").agg(size.alias("bytes"), F.round(size / 1048576.0 / 0.5, 6).alias("mb_per_s"))


@query("WITH a AS (SELECT l_suppkey, l_partkey, l_quantity FROM lineitem WHERE l_suppkey = 1), b AS (SELECT l_suppkey, l_partkey, l_quantity FROM lineitem WHERE l_suppkey = 2) SELECT a.l_partkey, a.l_quantity AS x, b.l_quantity AS u FROM a JOIN b USING (l_partkey)")
def correspondences(t):
    """Points of two images that carry the same marker."""
    l = t("lineitem")
    a = l.where("l_suppkey = 1").select("l_partkey", F.col("l_quantity").alias("x"))
    return a.join(l.where("l_suppkey = 2").select("l_partkey", F.col("l_quantity").alias("u")), "l_partkey")


@query("""WITH x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS s, embedding[i + 33]::DOUBLE AS v FROM embeddings, (SELECT unnest(generate_series(0, 31)) AS i) WHERE embedding[i + 1] > 0),
m AS (SELECT vec_id, max(s) AS top FROM x GROUP BY vec_id)
SELECT e.vec_id, round(y, 6) AS y FROM embeddings e LEFT JOIN (SELECT vec_id, sum(exp(s - top) * v) / sum(exp(s - top)) AS y FROM x JOIN m USING (vec_id) GROUP BY vec_id) USING (vec_id)""")
def masked_attention(t):
    """Softmax-weighted mean over the neighbours that are not masked; null where all are."""
    xs = F.transform("embedding", lambda x: x.cast("double"))
    s = F.transform(F.slice(xs, 1, 32), lambda x: F.when(x > 0, x))
    return t("embeddings").select("vec_id", s.alias("s"), F.slice(xs, 33, 32).alias("v")).select("vec_id", F.round(graph.attention(F.col("s"), F.col("v")), 6).alias("y"))


@query("SELECT event_id, round(date_diff('second', ts, TIMESTAMP '2024-02-01 00:00:00') / 3600.0, 3) >= 24 AS old FROM events")
def age_in_hours(t):
    age = columns.age_hours(F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp"))
    return t("events").select("event_id", (F.round(age, 3) >= 24).alias("old"))


@query("SELECT vec_id, [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 130, 140, 150, 160][1 + label % 16] AS level FROM embeddings")
def table_lookup(t):
    """Values through a table."""
    lut = F.array(*(F.lit(10 * k) for k in range(1, 17)))
    return t("embeddings").select("vec_id", F.get(lut, (F.col("label") % 16).cast("int")).alias("level"))


@query("SELECT c_mktsegment, count(*) AS n, c_mktsegment <> 'BUILDING' AS other FROM customer GROUP BY c_mktsegment")
def negated_class(t):
    return t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("other", F.col("c_mktsegment") != "BUILDING")


@query("SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS rank FROM supplier QUALIFY rank <= 20")
def largest_first(t):
    """The twenty largest (a report of the top), in order."""
    top = t("supplier").orderBy(F.col("s_acctbal").desc(), "s_suppkey").limit(20)
    return top.select("s_suppkey", "s_nationkey", F.row_number().over(Window.orderBy(F.col("s_acctbal").desc(), "s_suppkey")).alias("rank"))


@query("SELECT n_regionkey, arg_max(n_name, (length(n_name) * 1000 - n_nationkey)) AS longest FROM nation GROUP BY n_regionkey")
def largest_contour(t):
    return t("nation").groupBy("n_regionkey").agg(F.max_by("n_name", F.struct(F.length("n_name"), -F.col("n_nationkey"))).alias("longest"))


@query("SELECT o_orderkey, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS short_hash, md5(CAST(o_orderkey AS VARCHAR)) AS random_id, base64(CAST(o_orderstatus AS BLOB)) AS chunk FROM orders")
def hashes(t):
    key = F.col("o_orderkey").cast("string")
    return t("orders").select("o_orderkey", F.substring(F.sha2(key, 256), 1, 8).alias("short_hash"), columns.random_id(key).alias("random_id"), F.base64("o_orderstatus").alias("chunk"))
