"""Track queries: votes, numbering, presence, edits, merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tracks
from .registry import query


@query("WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS votes FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(*) >= 30")
def pair_votes(t):
    """Pairs of suppliers that stand in at least thirty orders together."""
    return tracks.pair_votes(t("lineitem"), "l_orderkey", "l_suppkey", 30)


_BOX = "x AS (SELECT event_id // 10 AS frame, event_id % 10 AS obj, user_id % 20 AS top, CAST(floor(value) AS BIGINT) % 20 AS \"left\", 20 + event_id % 7 AS height, 20 + user_id % 5 AS width FROM events)"


def _boxes(t):
    e = F.col("event_id")
    box = F.struct((F.col("user_id") % 20).alias("top"), (F.floor("value") % 20).alias("left"), (20 + e % 7).alias("height"), (20 + F.col("user_id") % 5).alias("width"))
    return t("events").select(F.floor(e / 10).alias("frame"), (e % 10).alias("obj"), box.alias("box"))


@query(f"""WITH {_BOX}, p AS (SELECT a.obj AS a, b.obj AS b, greatest(0, least(a.top + a.height, b.top + b.height) - greatest(a.top, b.top)) * greatest(0, least(a."left" + a.width, b."left" + b.width) - greatest(a."left", b."left")) AS common, a.height * a.width + b.height * b.width AS areas FROM x a JOIN x b ON a.frame = b.frame AND a.obj < b.obj)
SELECT a, b, count(*) AS votes FROM p WHERE common > 0 AND common >= 0.5 * (areas - common) GROUP BY a, b HAVING count(*) >= 5""")
def overlap_votes(t):
    """Frames in which two objects' boxes overlap by half; disjoint boxes go first."""
    return tracks.overlap_votes(_boxes(t), "frame", "obj", "box", 0.5, 5)


@query("SELECT event_id, user_id, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) - 1 AS new_id FROM events")
def dense_renumber(t):
    return tracks.dense_renumber(t("events"), "event_type", "user_id").select("event_id", "user_id", F.col("new_id").cast("long").alias("new_id"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 98")
def visible_minus_deleted(t):
    e = t("events")
    return e.where("event_type = 'view'").select("user_id").subtract(e.where((F.col("event_type") == "error") & (F.col("value") > 98)).select("user_id"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click') UNION SELECT o_custkey FROM orders")
def union_frames(t):
    """Distinct union of two frame lists, the second with every order's customer."""
    a = t("events").where(F.col("event_type").isin("view", "click")).select("user_id")
    return a.union(t("orders").select("o_custkey")).distinct()


@query("SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09")
def common_names(t):
    l = t("lineitem")
    return l.where("l_quantity > 49").select("l_suppkey").intersect(l.where("l_discount > 0.09").select("l_suppkey"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id % 17 AS x, CASE event_type WHEN 'purchase' THEN 'undo' WHEN 'signup' THEN 'toggle' ELSE 'delete' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(user_id, n, gone, undo) AS (SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM e UNION ALL
  SELECT e.user_id, e.n,
    CASE WHEN kind = 'delete' THEN list_append(list_filter(gone, lambda g: g <> x), x) WHEN kind = 'undo' THEN list_filter(gone, lambda g: len(undo) = 0 OR g <> undo[-1]) WHEN list_contains(gone, x) THEN list_filter(gone, lambda g: g <> x) ELSE list_append(gone, x) END,
    CASE WHEN kind = 'delete' THEN list_append(undo, x)[-50:] WHEN kind = 'undo' THEN undo[:-2] ELSE undo END
  FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.n = r.n + 1)
SELECT user_id, array_to_string(list_sort(arg_max(gone, n)), ',') AS deleted FROM r GROUP BY user_id"""
)
def edit_log_fold(t):
    """Deleted items after delete, undo and toggle events."""
    kind = F.when(F.col("event_type") == "purchase", "undo").when(F.col("event_type") == "signup", "toggle").otherwise("delete")
    e = t("events").select("user_id", "ts", "event_id", kind.alias("kind"), (F.col("event_id") % 17).alias("item"))
    got = tracks.fold_edits(e, "user_id", ["ts", "event_id"], "kind", "item")
    return got.select("user_id", F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted"))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type <> 'error') AS n FROM events GROUP BY ALL)
SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN n IS NULL THEN 'absent' WHEN n = 0 THEN 'occluded' ELSE 'visible' END AS status FROM u CROSS JOIN d LEFT JOIN s USING (user_id, day)""")
def presence_matrix(t):
    """Every user on every day of the month: visible, occluded (errors only) or absent. The days are a fixed short side."""
    e = t("events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    seen = e.groupBy("user_id", "day").agg(F.count_if(F.col("event_type") != "error").alias("n"))
    m = tracks.presence_matrix(e.select("user_id").distinct(), e.select("day").distinct(), seen, "user_id", "day", "n")
    return m.select("user_id", F.col("day").cast("string").alias("day"), "status")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_track(t):
    """The later track's value of the same object and frame."""
    return tracks.latest_track(t("events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query("""WITH RECURSIVE v AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(*) >= 48),
e AS (SELECT a, b FROM v UNION ALL SELECT b, a FROM v), r AS (SELECT s_suppkey AS id, s_suppkey AS m FROM supplier UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id)
SELECT id, min(m) AS merged FROM r GROUP BY id""")
def merged_tracks(t):
    """Ids joined by enough votes get the smallest id of their group."""
    return tracks.merged_ids(t("supplier").select("s_suppkey"), tracks.pair_votes(t("lineitem"), "l_orderkey", "l_suppkey", 48))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_class, count(*) FILTER (WHERE event_type <> 'click') AS n_other FROM events GROUP BY user_id")
def class_counts(t):
    """Instances of the class and others in each frame."""
    return t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n_class"), F.count_if(F.col("event_type") != "click").alias("n_other"))


@query("WITH f AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS frames, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS days FROM f GROUP BY user_id")
def frames_by_video(t):
    f = t("events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return f.groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("frames"), F.array_join(F.array_sort(F.collect_list("day")), ",").alias("days"))


@query("SELECT event_type, arg_max(user_id, n * 100000 - user_id) AS user_id FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def longest_list(t):
    """The frame with most masks, the first of equals."""
    n = t("events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.max_by("user_id", F.struct("n", -F.col("user_id"))).alias("user_id"))


@query("SELECT event_type || '_' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '_' || lpad(CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS VARCHAR), 4, '0') AS name, event_id FROM events")
def crop_names(t):
    """File names numbered within video and frame, zero-padded."""
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")) - 1
    return t("events").select(F.format_string("%s_%06d_%04d", "event_type", "user_id", n).alias("name"), "event_id")
