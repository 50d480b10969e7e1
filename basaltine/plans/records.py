"""Records of scans, sessions and labels: joins, trims, changes of tables, small functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import columns
from ..operators import catalog, detect, geometry, sessions, tracks
from ..operators.rng import uniform_sql
from .registry import query


@query("SELECT o_orderkey AS upload_id, o_custkey AS scan_id, c_name AS scan_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey = 7")
def scan_uploads(t):
    """Uploads of one multipart scan."""
    scans = t("customer").select(F.col("c_custkey").alias("scan_id"), F.col("c_name").alias("scan_name"))
    uploads = t("orders").select(F.col("o_orderkey").alias("upload_id"), F.col("o_custkey").alias("scan_id"))
    return sessions.scan_uploads(uploads, scans, 7)


@query("SELECT o_custkey AS scan_id, count(*) AS n_uploads, bool_and(o_orderstatus = 'F') AS done FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def scan_progress(t):
    """Scans with the number of their uploads and whether all are done."""
    scans = t("customer").select(F.col("c_custkey").alias("scan_id"))
    uploads = t("orders").select(F.col("o_custkey").alias("scan_id"), (F.col("o_orderstatus") == "F").alias("done"))
    return sessions.scan_progress(uploads, scans)


@query("SELECT c_custkey AS id, trim(c_name) AS name, nullif(trim(' ' || (c_custkey % 3) || ' '), '0') AS handle FROM customer")
def trimmed_inputs(t):
    """Inputs without surrounding blanks."""
    c = t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"), F.concat(F.lit(" "), F.col("c_custkey") % 3, F.lit(" ")).alias("handle"))
    return sessions.trimmed(c, ["name", "handle"]).withColumn("handle", F.nullif("handle", F.lit("0")))


@query("SELECT o_orderkey, o_custkey % 5 = 1 AS owned FROM orders")
def owner_flag(t):
    """Whether a row belongs to the one who asks."""
    return t("orders").select("o_orderkey", sessions.owned(F.col("o_custkey") % 5, F.lit(1)).alias("owned"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 5) + 0.0 AS x1, round(embedding[4]::DOUBLE, 5) + 0.0 AS y2, embedding[5]::DOUBLE > 0 AS present, CAST(floor(abs(embedding[6]::DOUBLE) * 10) AS INT) AS kind FROM embeddings")
def label_slices(t):
    """Packed labels of six values as box, presence and class."""
    packed = F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 6)
    box, present, kind = columns.label_slices(packed)
    r = lambda c: F.round(c, 5) + 0.0
    return t("embeddings").select("vec_id", r(box[0]).alias("x1"), r(box[3]).alias("y2"), (present > 0).alias("present"), F.floor(F.abs(kind) * 10).cast("int").alias("kind"))


@query("SELECT vec_id, list_sum(list_transform(generate_series(1, 16), lambda i: CASE WHEN abs(embedding[i]::DOUBLE) >= 0.1 THEN 1 ELSE 0 END))::BIGINT AS n FROM embeddings")
def score_filter(t):
    """How many of 16 candidates reach the least score."""
    s = F.transform(F.slice("embedding", 1, 16), lambda x: F.abs(x.cast("double")))
    return t("embeddings").select("vec_id", F.size(detect.above(F.transform(s, lambda x: F.struct(x.alias("score"))), 0.1)).cast("long").alias("n"))


@query("SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS base, regexp_extract(url, '(\\.[^./]*)$', 1) AS ext, regexp_replace(url, '\\.[^./]*$', '') AS name FROM pages")
def path_parts(t):
    name, ext = columns.splitext(F.col("url"))
    return t("pages").select("page_id", columns.basename(F.col("url")).alias("base"), ext.alias("ext"), name.alias("name"))


@query("SELECT page_id, split_part(url, '/', 1) AS head, CASE WHEN contains(url, '/') THEN substr(url, strpos(url, '/') + 1) ELSE '' END AS rest FROM pages")
def prefix_and_rest(t):
    head, rest = columns.prefix_rest(F.col("url"))
    return t("pages").select("page_id", head.alias("head"), rest.alias("rest"))


@query(f"SELECT event_id, k, round(CASE WHEN k < 7 THEN sin({math.pi} * pow(2.0, k) * value / 100) ELSE cos({math.pi} * pow(2.0, k - 7) * value / 100) END, 6) + 0.0 AS v FROM events, (SELECT unnest(generate_series(0, 13)) AS k)")
def fourier_features(t):
    f = columns.fourier(F.col("value") / 100)
    return t("events").select("event_id", F.posexplode(f).alias("k", "v")).select("event_id", F.col("k").cast("long").alias("k"), (F.round("v", 6) + 0.0).alias("v"))


@query("SELECT event_id, list_concat(list_reverse(list_slice([event_id, event_id + 1, event_id + 2], 2, 3)), [event_id, event_id * 2])::VARCHAR AS joined FROM events")
def spliced_passes(t):
    """A backward pass reversed without its first frame, then the forward pass."""
    e = F.col("event_id")
    both = tracks.spliced(F.array(e, e + 1, e + 2), F.array(e, e * 2))
    return t("events").select("event_id", F.concat(F.lit("["), F.array_join(both, ", "), F.lit("]")).alias("joined"))


@query("SELECT c_custkey, CAST(c_custkey % 7 AS INT) AS k, CASE WHEN c_custkey % 7 = 3 THEN 'later' ELSE c_name END AS v FROM customer")
def merged_maps(t):
    """Maps with integer keys; of equal keys the later map's value."""
    c = t("customer")
    a = F.create_map((F.col("c_custkey") % 7).cast("string"), "c_name", F.lit("x"), F.lit("dropped"))
    m = columns.merged_maps(columns.integer_keys(a), F.create_map(F.lit(3), F.lit("later")))
    return c.select("c_custkey", (F.col("c_custkey") % 7).cast("int").alias("k"), m.alias("m")).select("c_custkey", "k", F.col("m")[F.col("k")].alias("v"))


@query("SELECT p_partkey, ascii(substr(p_name, 1, 1)) * 256 + ascii(substr(p_name, 2, 1)) AS big, ascii(substr(p_name, 2, 1)) * 256 + ascii(substr(p_name, 1, 1)) AS little FROM part")
def header_integers(t):
    """Two-byte integers in both orders from the head of a binary."""
    head = F.encode("p_name", "UTF-8")
    return t("part").select("p_partkey", columns.uint_at(head, 0, 2).alias("big"), columns.uint_at(head, 0, 2, big=False).alias("little"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND coalesce(n_chars, 0) <= 1024")
def admissible_uploads(t):
    """By kind and size."""
    return t("documents").where(sessions.admissible(F.concat(F.col("lang"), F.lit("/x")), F.coalesce("n_chars", F.lit(0)) * 1024, "en/", 1)).select("doc_id")


_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@query(f"SELECT c_custkey::VARCHAR AS id, CAST(CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-01' WHEN c_custkey % 3 = 0 THEN {_NOW} END AS VARCHAR) AS finalized_at FROM customer")
def finalized_once(t):
    """Open sessions of the given ids get the time; what is finalized stays."""
    c = t("customer")
    s = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2024-01-01").cast("timestamp")).alias("finalized_at"))
    ids = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    return sessions.finalize(s, ids, F.lit("2024-01-20").cast("timestamp")).select("id", F.date_format("finalized_at", "yyyy-MM-dd HH:mm:ss").alias("finalized_at"))


@query("SELECT CAST(s_suppkey % 2 AS INT) AS id, CAST(10 + max(s_suppkey) AS INT) AS session_image_cap, 4 AS min_required_mixed, 5 AS min_required_same, 25 AS file_size_limit_mb FROM supplier WHERE s_suppkey % 2 = 1 GROUP BY s_suppkey % 2")
def updated_config(t):
    """A config row that is there, with one value changed; tests do the same without a row."""
    held = t("supplier").where("s_suppkey % 2 = 1").agg(F.max("s_suppkey").alias("m")).select(F.lit(1).alias("id"), (10 + F.col("m")).cast("int").alias("session_image_cap"), F.lit(4).alias("min_required_mixed"), F.lit(3).alias("min_required_same"), F.lit(25).alias("file_size_limit_mb"))
    return sessions.updated_config(held, min_required_same=5)


@query("SELECT 'sessions' AS name, count(*) AS n FROM customer UNION ALL SELECT v.name, 0 FROM (VALUES ('images'), ('dedup_index'), ('uploads'), ('config')) AS v(name)")
def migrated_tables(t):
    """Tables that all migrations make, applied twice, and their rows: a table that is there keeps its own."""
    once = sessions.migrated({"sessions": t("customer")}, t.spark)
    out = None
    for name, df in sessions.migrated(once, t.spark).items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT max(o_orderkey) + 1 AS id FROM orders")
def next_key(t):
    return t("orders").agg(sessions.next_key("o_orderkey").alias("id"))


@query("""WITH i AS (SELECT event_id AS seq, user_id::VARCHAR AS session_id, md5((event_id % 3000)::VARCHAR) AS sha256 FROM events WHERE event_type <> 'error' AND value <= 90),
n AS (SELECT seq, session_id FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY seq, session_id) AS k FROM i) WHERE k = 1 AND sha256 NOT IN (SELECT md5((c_custkey * 10)::VARCHAR) FROM customer))
SELECT seq, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM n) WHERE k <= 4""")
def accepted_uploads(t):
    """Admissible uploads, new anywhere, within each session's cap."""
    mb = 1024.0 * 1024
    mime = F.when(F.col("event_type") != "error", "image/jpeg").otherwise("text/plain")
    i = t("events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("session_id"), F.md5((F.col("event_id") % 3000).cast("string")).alias("sha256"), mime.alias("original_mime"), (F.col("value") / 90 * 25 * mb - 1).cast("long").alias("size_bytes"))
    known = t("customer").select(F.md5((F.col("c_custkey") * 10).cast("string")).alias("sha256"), F.col("c_custkey").alias("image_id"))
    none = t.spark.createDataFrame([], sessions.IMAGES)
    return sessions.accepted(i, none, known, 4).select("seq", "session_id")


@query("SELECT c_custkey AS id FROM customer WHERE lower('u' || (c_custkey % 50) || '@X.org') <> 'u7@x.org'")
def deleted_by_email(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("u"), F.col("c_custkey") % 50, F.lit("@X.org")).alias("email"))
    return sessions.deleted_by_email(c, "U7@x.org").select("id")


@query("SELECT o_custkey AS id, count(*) AS image_count FROM orders GROUP BY o_custkey")
def image_counter(t):
    """The counter kept with each session, added up from its images."""
    return sessions.counted(t("orders").select(F.col("o_custkey").alias("id")), "id", "image_count")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'blu')")
def keyword_match(t):
    return t("part").where(catalog.any_keyword(F.col("p_name"), ["Red", "BLU"])).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '2K' WHEN p_size % 3 = 1 THEN '4K' ELSE '1K' END AS pick FROM part")
def preferred_resolution(t):
    """The first preferred label that is there, else the first there is."""
    there = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("4K"), F.lit("2K"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("8K"), F.lit("4K"))).otherwise(F.array(F.lit("1K"), F.lit("8K")))
    return t("part").select("p_partkey", catalog.first_available(there, ["2K", "4K"]).alias("pick"))


_U = [uniform_sql("(l_orderkey * 1009 + l_linenumber)", k) for k in range(3)]


@query(f"SELECT l_orderkey, l_linenumber + 1 AS object_id, round({_U[0]} * 2 - 1, 9) AS px, round({_U[1]} * 2 - 1, 9) AS py, round({_U[2]} * 6.283185307179586, 9) AS turn FROM lineitem")
def placed_objects(t):
    """Seeded places and turns of a scene's objects."""
    df = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("position"))
    p = catalog.placed_objects(df, "l_orderkey", "position")
    return p.select("l_orderkey", "object_id", *(F.round(c, 9).alias(c) for c in ("px", "py", "turn")))


_SUB = uniform_sql("c_nationkey", 9)


@query(f"""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || '|5'), c_custkey) AS k, 3 + CAST(floor({_SUB} * 5) AS BIGINT) AS n FROM customer)
SELECT c_nationkey, c_custkey FROM r WHERE k <= n""")
def sampled_members(t):
    """Three to seven members of each group, seeded, none twice."""
    return catalog.sampled(t("customer"), "c_nationkey", "c_custkey", 3, 7, 5, 9).select("c_nationkey", "c_custkey")


@query("""WITH x AS (SELECT user_id, least(value, 100) / 100.0 AS l, 1 - least(value, 100) / 200.0 AS r, (event_id % 70) / 10.0 AS v FROM events)
SELECT user_id, round(avg(-((floor(v) + 1 - v) * ln(l + 0.01) + (v - floor(v)) * ln(r + 0.01))), 6) AS loss FROM x GROUP BY user_id""")
def distribution_loss(t):
    """Cross entropy of the two bins around each value."""
    value, low = (F.col("event_id") % 70) / 10.0, F.least("value", F.lit(100.0))
    loss = detect.distribution_focal_loss(low / 100.0 + 0.01, 1 - low / 200.0 + 0.01, value)
    return t("events").groupBy("user_id").agg(F.round(loss, 6).alias("loss"))


@query(
    """WITH e AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS p, embedding[4]::DOUBLE AS q FROM embeddings), m AS (SELECT label, x, y, 0.6 * x - 0.8 * y + 3 + p / 10 AS u, 0.8 * x + 0.6 * y - 2 + q / 10 AS v FROM e),
c AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM m GROUP BY label HAVING count(*) > 1),
d AS (SELECT label, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, atan2(sum((x - mx) * (v - mv) - (y - my) * (u - mu)), sum((x - mx) * (u - mu) + (y - my) * (v - mv))) AS a FROM m JOIN c USING (label) GROUP BY label)
SELECT label, round(cos(a), 6) AS c, round(sin(a), 6) AS s, round(mu - (cos(a) * mx - sin(a) * my), 6) AS tx, round(mv - (sin(a) * mx + cos(a) * my), 6) AS ty FROM d"""
)
def rigid_motion(t):
    """The turn and shift that come nearest to taking one set of points to another, from their sums."""
    e = t("embeddings").select("label", *(F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate("xypq")))
    e = e.withColumns({"u": 0.6 * F.col("x") - 0.8 * F.col("y") + 3 + F.col("p") / 10, "v": 0.8 * F.col("x") + 0.6 * F.col("y") - 2 + F.col("q") / 10})
    g = e.groupBy("label").agg(*geometry.rigid_sums(*(F.col(c) for c in "xyuv")), F.count("*").alias("n")).where("n > 1")
    return g.select("label", *(F.round(c, 6).alias(k) for k, c in geometry.rigid_of_sums().items()))


@query("SELECT vec_id, round((embedding[1]::DOUBLE * 2 + 1) / (abs(embedding[3]::DOUBLE) + 1), 6) + 0.0 AS x, round((embedding[2]::DOUBLE * 2 - 1) / (abs(embedding[3]::DOUBLE) + 1), 6) + 0.0 AS y FROM embeddings")
def homogeneous_points(t):
    """Points through a projective matrix and back from homogeneous coordinates."""
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    w = F.abs(at(2)) + 1
    x, y = geometry.through([[F.lit(2.0), F.lit(0.0), F.lit(1.0)], [F.lit(0.0), F.lit(2.0), F.lit(-1.0)], [F.lit(0.0), F.lit(0.0), w]], at(0), at(1))
    return t("embeddings").select("vec_id", (F.round(x, 6) + 0.0).alias("x"), (F.round(y, 6) + 0.0).alias("y"))


@query("SELECT l_orderkey AS video, l_linenumber AS frame, l_partkey AS obj_id, p_size > 25 AS is_class FROM lineitem JOIN part ON l_partkey = p_partkey")
def class_lookup(t):
    """Each observation with what is known of its object; objects that are unknown drop out."""
    known = t("part").select(F.col("p_partkey").alias("obj_id"), (F.col("p_size") > 25).alias("is_class"))
    seen = t("lineitem").select(F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("frame"), F.col("l_partkey").alias("obj_id"))
    return tracks.with_class(seen, known)


@query("SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END) AS BIGINT) AS late, CAST(floor(max(epoch(ts))) - floor(min(epoch(ts))) AS BIGINT) AS seconds FROM events GROUP BY user_id")
def stage_times(t):
    """Elapsed seconds between the first and the last mark of each run."""
    e = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions.elapsed(e, "user_id", "ts").join(e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.hour("ts") >= 12).alias("late")), "user_id")


@query("SELECT name, CAST(seq AS BIGINT) AS seq FROM (SELECT o_orderpriority AS name, o_orderkey AS seq FROM orders) ORDER BY name, seq")
def sorted_by_name(t):
    """By name, ties in order of appearance."""
    return catalog.by_name(t("orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("long").alias("seq")), "name", "seq")
