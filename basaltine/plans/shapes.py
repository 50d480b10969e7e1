"""Chains of windows, forests, polygons and lookup tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset, graph, series, sessions, tracks
from .registry import query


@query(
    """WITH RECURSIVE s(t) AS (SELECT min(ts) FROM events UNION ALL SELECT min(e.ts) FROM s JOIN events e ON e.ts > s.t + INTERVAL 6 HOUR GROUP BY s.t),
w AS (SELECT e.event_id, e.event_type, s.t AS window_start, row_number() OVER (PARTITION BY s.t, e.event_type ORDER BY e.ts, e.event_id) AS hit FROM events e ASOF JOIN s ON e.ts >= s.t)
SELECT event_id, event_type, CAST(epoch_us(window_start) AS BIGINT) AS window_us, CAST(hit AS INT) AS hit, hit <= 8 AS allowed FROM w"""
)
def exact_rate_limit(t):
    """Hits against a limit whose window is reset for all keys at once by the first hit more than six hours after its beginning."""
    e = t("events").select("event_id", "event_type", "ts")
    got = sessions.reset_limited(e, "event_type", "ts", ["ts", "event_id"], 8, 6 * 3600)
    return got.select("event_id", "event_type", F.unix_micros("window_start").alias("window_us"), "hit", "allowed")


@query(
    """WITH RECURSIVE x AS (SELECT DISTINCT s_nationkey AS part, l_suppkey AS node, l_shipdate AS day FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
e AS (SELECT a.part, a.node AS src, b.node AS dst, count(*) AS weight FROM x a JOIN x b ON a.part = b.part AND a.day = b.day AND a.node < b.node GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY weight DESC, src, dst) AS n FROM e),
h AS (SELECT part, n, src AS u, dst AS v FROM o UNION ALL SELECT part, n, dst, src FROM o),
r(part, n, place) AS (SELECT part, n, src FROM o UNION SELECT r.part, r.n, h.v FROM r JOIN h ON h.part = r.part AND h.u = r.place AND h.n < r.n)
SELECT part, src, dst, weight FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.part = o.part AND r.n = o.n AND r.place = o.dst)"""
)
def forest_edges(t):
    """The maximum spanning forest of each nation's suppliers, joined by the days on which both ship: an edge is in it if no better ones join its ends."""
    days = t("lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_shipdate").alias("day")).dropna().groupBy("node").agg(F.collect_set("day").alias("days"))
    x = days.join(t("supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("part")).dropna().distinct(), "node")
    return graph.shared_forest(x, "part", "node", "days")


_L = "[{x0: {x}, y0: {y}, x1: {x} + {w}, y1: {y} + {h} / 2}, {x0: {x}, y0: {y} + {h} / 2, x1: {x} + {w} / 2, y1: {y} + {h}}]"


def _boxes(x: str, y: str, w: str, h: str) -> str:
    out = _L
    for k, v in (("{x}", x), ("{y}", y), ("{w}", w), ("{h}", h)):
        out = out.replace(k, v)
    return out.replace("{x0", "{'x0'").replace(", y0", ", 'y0'").replace(", x1", ", 'x1'").replace(", y1", ", 'y1'")


_SIZE = ("(p_size + 1.0::DOUBLE)", "(p_partkey % 17 + 2.0::DOUBLE)")
_OTHER = ("(p_partkey % 5 * 0.5::DOUBLE)", "(p_partkey % 7 * 0.25::DOUBLE)", "(p_partkey % 23 + 1.0::DOUBLE)", "(p_size % 11 + 3.0::DOUBLE)")


@query(
    f"""WITH b AS (SELECT p_partkey, {_SIZE[0]} * {_SIZE[1]} * 0.75 AS area_a, {_OTHER[2]} * {_OTHER[3]} * 0.75 AS area_b, {_boxes("0.0::DOUBLE", "0.0::DOUBLE", *_SIZE)} AS a, {_boxes(*_OTHER)} AS b FROM part),
u AS (SELECT p_partkey, area_a, area_b, unnest(a) AS p, b FROM b), v AS (SELECT p_partkey, area_a, area_b, p, unnest(b) AS q FROM u),
c AS (SELECT p_partkey, any_value(area_a) AS area_a, any_value(area_b) AS area_b, sum(greatest(least(p.x1, q.x1) - greatest(p.x0, q.x0), 0) * greatest(least(p.y1, q.y1) - greatest(p.y0, q.y0), 0)) AS c FROM v GROUP BY p_partkey)
SELECT p_partkey, round(c / (area_a + area_b - c), 6) + 0.0 AS iou, round(c / area_a, 6) + 0.0 AS covered FROM c"""
)
def polygon_overlap(t):
    """Overlap of two concave shapes for each part; the SQL adds up the rectangles that they are made of."""

    def shape(x, y, w, h):
        return F.array(*(F.array(x + i * w, y + j * h) for i, j in ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))))

    key, size = F.col("p_partkey"), F.col("p_size")
    a = shape(F.lit(0.0), F.lit(0.0), size + 1.0, key % 17 + 2.0)
    b = shape(key % 5 * 0.5, key % 7 * 0.25, key % 23 + 1.0, size % 11 + 3.0)
    parts = dataset.dealt(t("part").select("p_partkey", "p_size"), 20_000)
    got = tracks.polygon_overlaps(parts.select("p_partkey", a.alias("a"), b.alias("b")), "a", "b")
    # Rounded as a number, as SQL does, not as its decimal digits: the two differ at ties.
    return got.select("p_partkey", *((F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in ("iou", "covered")))


@query()
def lookup_tables(t):
    """The best table from 10 to 8 bits for each channel of prices; tests hold it against brute force."""
    price = F.floor(F.col("l_extendedprice") / 110).cast("int")
    df = t("lineitem").select("l_returnflag", (F.col("l_linenumber") % 3).alias("channel"), price.alias("value"))
    return series.lookup_tables(df, ["l_returnflag", "channel"], "value")
