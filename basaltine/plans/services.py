"""Collection services: listing, dedup, caps, expiry, chunks, limits, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, sessions
from .registry import query

NOW = "2024-01-20 00:00:00"


def _sessions(t):
    """Customers as sessions: some without a name, some finalized."""
    c = t("customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_name")).alias("name"), F.concat(F.lit("user"), F.col("c_custkey") % 97, F.lit("@Example.org")).alias("email"), F.when(F.col("c_custkey") % 3 == 0, "SAME_TYPE").otherwise("MIXED_UNIQUES").alias("mode"), F.when(F.col("c_custkey") % 2 == 0, F.lit(NOW).cast("timestamp")).alias("finalized_at"), F.col("c_custkey").alias("k"))


_S = "s AS (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS name, 'user' || (c_custkey % 97) || '@Example.org' AS email, CASE WHEN c_custkey % 3 = 0 THEN 'SAME_TYPE' ELSE 'MIXED_UNIQUES' END AS mode, c_custkey % 2 = 0 AS finalized, c_custkey AS k FROM customer)"


@query(f"WITH {_S} SELECT id, name, email, mode FROM s WHERE lower(name) LIKE '%customer#0000001%' AND mode = 'SAME_TYPE' AND finalized")
def session_listing(t):
    """Optional filters; unset ones leave no trace in the plan."""
    return sessions.listing(_sessions(t), name="CUSTOMER#0000001", mode="SAME_TYPE", status="Finalized").select("id", "name", "email", "mode")


@query(f"WITH {_S} SELECT id, email FROM s WHERE lower(email) = 'user5@example.org' AND NOT finalized")
def session_listing_by_email(t):
    return sessions.listing(_sessions(t), email="USER5@example.org", status="open").select("id", "email")


@query(f"WITH {_S} SELECT id, k FROM s ORDER BY k LIMIT 10 OFFSET 20")
def session_page(t):
    """Third page of ten."""
    return sessions.page(_sessions(t), ["k"], 2).select("id", "k")


@query(f"WITH {_S} SELECT id, coalesce(name, '') AS name, CASE WHEN finalized THEN '2024-01-20T00:00:00Z' ELSE '' END AS finalized_at FROM s")
def session_summary(t):
    df = _sessions(t)
    return df.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.date_format("finalized_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("finalized_at"))


@query("WITH h AS (SELECT doc_id, sha256(text) AS digest FROM documents) SELECT doc_id, digest, doc_id <> min(doc_id) OVER (PARTITION BY digest) AS duplicate FROM h")
def global_dedup(t):
    """First writer of a SHA-256 wins."""
    h = t("documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
    return sessions.global_dedup(h, None, "digest", ["doc_id"]).select("doc_id", "digest", "duplicate")


@query("SELECT item_id FROM benchmark WHERE EXISTS (SELECT 1 FROM documents WHERE contains(text, benchmark.text))")
def contaminated_items(t):
    """Benchmark items whose text stands in a document. Documents are matched on shared five-word runs before the text test."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    runs = lambda c: F.when(F.size(c) >= 5, F.transform(F.sequence(F.lit(1), F.size(c) - 4), lambda i: F.xxhash64(F.array_join(F.slice(c, i, 5), " "))))
    # An item's own first and last words may be parts of longer ones: its second to sixth words are whole.
    items = t("benchmark").select("item_id", F.col("text").alias("needle")).withColumn("w", words(F.col("needle")))
    # Of three to six words the second is whole. Which join it is, Spark decides by the sizes.
    keyed = items.where(F.size("w") >= 7).select("item_id", "needle", F.xxhash64(F.array_join(F.slice("w", 2, 5), " ")).alias("run"))
    single = items.where(F.size("w").between(3, 6)).select("item_id", "needle", F.xxhash64(F.lit("one"), F.get("w", F.lit(1))).alias("run"))
    # Words are a column of their own: within a lambda they would be split anew for each run.
    docs = t("documents").where(F.col("text").isNotNull()).select("text", F.struct(F.xxhash64("text"), F.xxhash64("text", F.lit(1))).alias("key"), words(F.col("text")).alias("w"))
    parts = F.coalesce(runs(F.col("w")), F.array().cast("array<bigint>"))
    if not single.isEmpty():
        parts = F.concat(parts, F.coalesce(F.transform("w", lambda w: F.xxhash64(F.lit("one"), w)), F.array().cast("array<bigint>")))
    # Runs travel with the text's hash; texts are fetched for those that share one with an item.
    narrow = docs.select("key", F.explode(F.array_distinct(parts)).alias("run"))
    shared = narrow.join(keyed.unionByName(single), "run").select("key", "item_id", "needle").distinct()
    hits = docs.select("key", "text").join(shared, "key").where(F.contains("text", "needle")).select("item_id")
    # Items of one or two words are parts of words: they are looked for in every text, one after the other.
    bits = items.where(F.size("w") < 3).select("item_id", "needle")
    if not bits.isEmpty():
        hits = hits.unionByName(docs.select("text").join(bits, F.contains("text", "needle")).select("item_id"))
    return hits.distinct()


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 20")
def session_cap(t):
    return sessions.capped(t("events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 20).select("event_id", "user_id")


@query(f"WITH f AS (SELECT user_id, min(ts) AS created_at, bool_or(event_type = 'purchase' AND value > 95) AS done FROM events GROUP BY user_id), x AS (SELECT user_id FROM f WHERE NOT done AND created_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM x)")
def ttl_cleanup(t):
    """Expired open sessions go, with their children."""
    e = t("events")
    f = e.groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("created_at"), F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 95), F.col("ts"))).alias("finalized_at"))
    gone = sessions.expired(f, F.lit(NOW).cast("timestamp"), 24)
    return sessions.cascaded(e.select("event_id", "user_id"), "user_id", gone, "user_id").select("event_id", "user_id")


@query(f"SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 95) THEN 'finalized' WHEN min(ts) < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR THEN 'expired' ELSE 'open' END AS status FROM events GROUP BY user_id")
def session_life_cycle(t):
    f = t("events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("c"), F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 95), F.col("ts"))).alias("f"))
    return f.select("user_id", sessions.life_cycle(F.col("f"), F.col("c"), F.lit(NOW).cast("timestamp"), 24).alias("status"))


@query("SELECT conv_id, count(*) AS n_chunks, CAST(sum(strlen(text)) AS BIGINT) AS received, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations WHERE conv_id % 5 <> 0 OR turn > 0 GROUP BY conv_id HAVING min(turn) = 0")
def chunk_reassembly(t):
    """Chunks in order of their index, of uploads whose size is complete: of every fifth the first chunk never came."""
    c = t("conversations").select("conv_id", "turn", "text")
    totals = c.groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("total_size"))
    got = sessions.assembled(c.where("conv_id % 5 <> 0 OR turn > 0"), "conv_id", "turn", "text", totals)
    return got.select("conv_id", "n_chunks", "received", F.sha2(F.encode("content", "UTF-8"), 256).alias("digest"))


@query("SELECT event_id, CAST(n AS INT) AS hit, n <= 3 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events)")
def rate_limit(t):
    """Hits numbered within fixed windows of an hour."""
    r = sessions.rate_limited(t("events"), "event_type", "ts", ["ts", "event_id"], 3, 3600)
    return r.select("event_id", "hit", "allowed")


@query("SELECT user_id, arg_min(value, ts) AS value FROM events WHERE event_type = 'click' GROUP BY user_id")
def first_known_value(t):
    """A conditional update sets a value once: the first known one stays."""
    v = t("events").select("user_id", "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("value"))
    return sessions.first_focal(v, "user_id", "ts", "value")


@query("SELECT count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 99)")
def cascading_delete(t):
    gone = t("events").where((F.col("event_type") == "error") & (F.col("value") > 99)).select("user_id")
    return sessions.cascaded(t("events").select("user_id"), "user_id", gone, "user_id").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 4 = 1), x AS (SELECT a AS idx, b AS partner FROM p UNION ALL SELECT b, a FROM p) SELECT s_suppkey AS idx, coalesce(partner, 0) AS partner FROM supplier LEFT JOIN x ON x.idx = s_suppkey")
def pair_partner(t):
    s = t("supplier").select(F.col("s_suppkey").alias("idx"))
    pairs = s.where(F.col("idx") % 4 == 1).select(F.col("idx").alias("idx1"), (F.col("idx") + 1).alias("idx2"))
    return sessions.partners(pairs, s)


@query("SELECT event_type AS \"group\", o_orderstatus AS status, count(*) AS n, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 9 END AS INT) AS rank FROM events JOIN orders ON event_id = o_orderkey GROUP BY ALL")
def status_order(t):
    """Counts by status with a custom rank, 9 for the rest."""
    rank = F.create_map(F.lit("F"), F.lit(0), F.lit("O"), F.lit(1))
    j = t("events").select("event_id", "event_type").join(t("orders").select("o_orderkey", "o_orderstatus"), F.col("event_id") == F.col("o_orderkey"))
    return j.groupBy(F.col("event_type").alias("group"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).withColumn("rank", F.coalesce(F.element_at(rank, F.col("status")), F.lit(9)))


@query("SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 'hello' WHEN 'de' THEN 'hallo' WHEN 'fr' THEN 'hello' ELSE 'greeting' END AS text FROM documents GROUP BY lang")
def message_fallback(t):
    """Messages by locale, falling back to English, then to the key."""
    cat = t.spark.createDataFrame([("en", "greeting.en", "hello"), ("de", "greeting.de", "hallo"), ("en", "greeting.fr", "hello")], "locale string, key string, text string")
    langs = t("documents").groupBy("lang").agg(F.count("*").alias("n"))
    keys = langs.select(F.concat(F.lit("greeting."), "lang").alias("key"))
    m = catalog.messages(keys, cat, "de").withColumn("lang", F.substring("key", 10, 9)).select("lang", F.when(F.col("text") == F.col("key"), "greeting").otherwise(F.col("text")).alias("text"))
    return langs.join(m, "lang").select("lang", "n", "text")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_props(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("SELECT event_type, count(*) FILTER (WHERE hour(ts) < 12) AS morning, count(*) FILTER (WHERE hour(ts) >= 12) AS evening FROM events GROUP BY event_type")
def count_by_status(t):
    return t("events").groupBy("event_type").agg(F.count_if(F.hour("ts") < 12).alias("morning"), F.count_if(F.hour("ts") >= 12).alias("evening"))


@query("SELECT c_mktsegment, greatest(1, CAST(ceil(count(*) / 10.0) AS BIGINT)) AS pages FROM customer GROUP BY c_mktsegment")
def page_count(t):
    return t("customer").groupBy("c_mktsegment").agg(sessions.pages_needed(F.count("*")).alias("pages"))


