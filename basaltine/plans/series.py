"""Time series queries on events, per user in order of time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series
from .registry import query


def _cents(t):
    """Values in whole cents, numbered from 0 within each user."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t("events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"), pos.cast("long").alias("i"))


_E = "e AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"


@query(f"WITH {_E} SELECT event_id, v - lag(v) OVER (PARTITION BY user_id ORDER BY i) AS diff FROM e")
def lag_difference(t):
    return series.lag_difference(_cents(t), "user_id", ["i"], "v").select("event_id", "diff")


@query(f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, i, v AS kept, TRUE AS keep FROM e WHERE i = 0
UNION ALL SELECT e.user_id, e.i, CASE WHEN abs(e.v - r.kept) > 2000 THEN e.v ELSE r.kept END, abs(e.v - r.kept) > 2000 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, i FROM r WHERE keep""")
def delta_sampler(t):
    """Rows that differ from the last kept one by more than 20.00."""
    return series.delta_sample(_cents(t), "user_id", ["i"], "v", 2000).select("user_id", "i")


@query(f"""WITH {_E}, n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id),
o AS (SELECT user_id, n, unnest(generate_series(0, n + 1)) AS idx FROM n), k AS (SELECT *, unnest(generate_series(idx - 8, idx + 6)) AS j FROM o)
SELECT k.user_id, k.idx, round(sum(v) / 15.0, 6) AS mean FROM k JOIN e ON e.user_id = k.user_id AND e.i = least(greatest(j, 0), n - 1) GROUP BY k.user_id, k.idx""")
def edge_moving_average(t):
    """Moving average with repeated edges; two outputs more than inputs."""
    return series.edge_mean(_cents(t), "user_id", "i", "v").select("user_id", "idx", F.round("mean", 6).alias("mean"))


@query(f"WITH {_E} SELECT event_id, min(v) OVER (PARTITION BY user_id ORDER BY i) AS prefix_min FROM e")
def prefix_min(t):
    return series.prefix_min(_cents(t), "user_id", ["i"], "v").select("event_id", "prefix_min")


@query(f"""WITH {_E}, c AS (SELECT *, CAST(round_even(0.08 * count(*) OVER (PARTITION BY user_id), 0) AS INT) AS c FROM e),
k AS (SELECT user_id, i, c, unnest(generate_series(0, c - 1)) AS k FROM c)
SELECT k.user_id, k.i, CAST(k AS INT) AS k, CASE WHEN k > k.i THEN 0 ELSE (min(e.v)) END AS low FROM k JOIN e ON e.user_id = k.user_id AND e.i BETWEEN k.i - k AND k.i GROUP BY k.user_id, k.i, k""")
def range_min(t):
    """Trailing range minima; cells that reach before the start stay 0."""
    return series.range_min(_cents(t), "user_id", "i", "v").select("user_id", "i", "k", "low")


@query(f"WITH {_E} SELECT event_id, coalesce(v < min(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improved FROM e")
def best_so_far(t):
    return series.best_so_far(_cents(t), "user_id", ["i"], "v").select("event_id", "improved")


@query(f"WITH {_E}, s AS (SELECT *, coalesce(bool_or(v > 9000) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS past FROM e) SELECT event_id FROM s WHERE NOT past")
def running_cutoff(t):
    """Rows until a value passes 90.00, that row with them."""
    return series.running_cutoff(_cents(t), "user_id", ["i"], F.col("v") > 9000).select("event_id")


@query(f"WITH {_E} SELECT event_id, lag(i, 1, 0) OVER w AS prev, coalesce(lead(i) OVER w, 9999) AS next FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)")
def frame_neighbours(t):
    return series.neighbours(_cents(t), "user_id", "i", F.lit(9999).cast("long")).select("event_id", "prev", "next")


@query(f"WITH {_E} SELECT event_id, max(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS range_max FROM e")
def range_max(t):
    return series.range_max(_cents(t), "user_id", "i", "v", 7).select("event_id", "range_max")


@query(f"""WITH {_E}, k AS (SELECT *, CASE WHEN i % 3 = 0 THEN v END AS kv FROM e),
g AS (SELECT *, last_value(CASE WHEN kv IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ai, last_value(kv IGNORE NULLS) OVER a AS av, first_value(CASE WHEN kv IS NOT NULL THEN i END IGNORE NULLS) OVER b AS bi, first_value(kv IGNORE NULLS) OVER b AS bv FROM k
WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN bi IS NULL THEN av WHEN bi = ai THEN av ELSE av + (i - ai) / (bi - ai) * (bv - av) END, 4) AS filled FROM g""")
def keyframe_interpolation(t):
    df = _cents(t).withColumn("kv", F.when(F.col("i") % 3 == 0, F.col("v")))
    return series.interpolated(df, "user_id", "i", "kv").select("event_id", F.round(F.col("filled").cast("double"), 4).alias("filled"))


@query()
def optimal_partition(t):
    """Track frames of each user's series by dynamic programming; tests hold it against trying all cuts."""
    return series.track_frames(_cents(t), "user_id", "i", "v")


@query("SELECT CAST(CASE WHEN l_quantity = 50 THEN 9 ELSE floor(l_quantity / 5) END AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def histogram(t):
    """Ten bins over [0, 50]; the last is closed."""
    return series.histogram(t("lineitem"), "l_quantity", 10, 0.0, 50.0)


@query("WITH h AS (SELECT CAST(l_quantity AS INT) AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(floor(q / 4) AS BIGINT) AS level, CAST(sum(n) - max(n) AS BIGINT) AS collisions FROM h GROUP BY 1")
def lut_collisions(t):
    h = t("lineitem").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n"))
    return series.collisions(h.withColumn("level", F.floor(F.col("q") / 4)), "level", "n")


@query("WITH h AS (SELECT CAST(l_quantity AS INT) AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT q, n, CAST(sum(n) OVER (ORDER BY q) AS BIGINT) AS running FROM h")
def running_histogram(t):
    h = t("lineitem").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n"))
    return h.withColumn("running", F.sum("n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, 0)))
