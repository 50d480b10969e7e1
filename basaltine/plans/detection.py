"""Detection queries: boxes from vectors, suppression, precision, anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect
from .registry import query

SCALE = 1000


def _boxes(t, first: int, shift: int = 0):
    """A box of each vector: whole numbers from four of its elements; 25 boxes to an image."""
    e = lambda k: F.floor(F.abs(F.get("embedding", F.lit(first + k)).cast("double")) * SCALE).cast("long")
    x, y = e(0) % 60, e(1) % 60
    d = t("embeddings").select(((F.col("vec_id") + shift) / 25).cast("long").alias("image"), F.col("vec_id").alias("box_id"), x.alias("x1"), y.alias("y1"), (x + 10 + e(2) % 40).alias("x2"), (y + 10 + e(3) % 40).alias("y2"), F.round(F.abs(F.get("embedding", F.lit(first + 4)).cast("double")), 4).alias("score"))
    return d.select("image", "box_id", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), "score")


def _boxes_sql(first: int) -> str:
    e = lambda k: f"CAST(floor(abs(embedding[{first + k + 1}]::DOUBLE) * {SCALE}) AS BIGINT)"
    return f"SELECT vec_id // 25 AS image, vec_id AS box_id, {e(0)} % 60 AS x1, {e(1)} % 60 AS y1, {e(0)} % 60 + 10 + {e(2)} % 40 AS x2, {e(1)} % 60 + 10 + {e(3)} % 40 AS y2 FROM embeddings"


_COMMON = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_AREAS = "((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1))"


@query(f"WITH a AS ({_boxes_sql(0)}), b AS ({_boxes_sql(8)}) SELECT a.box_id, round({_COMMON} / ({_AREAS} - {_COMMON})::DOUBLE, 9) AS iou FROM a JOIN b USING (box_id)")
def box_iou(t):
    a, b = _boxes(t, 0), _boxes(t, 8).select("box_id", *(F.col(c).alias(f"{c}_") for c in ("x1", "y1", "x2", "y2")))
    value = detect.corner_iou([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(f"{c}_") for c in ("x1", "y1", "x2", "y2")])
    return a.join(b, "box_id").select("box_id", F.round(value, 9).alias("iou"))


@query(
    f"""WITH RECURSIVE b AS ({_boxes_sql(0)}), s AS (SELECT b.*, round(abs(embedding[5]::DOUBLE), 4) AS score FROM b JOIN embeddings ON vec_id = box_id),
o AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS n, {{'box_id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}} AS b FROM s),
r(image, n, kept) AS (SELECT image, n, [b] FROM o WHERE n = 1 UNION ALL SELECT o.image, o.n, CASE WHEN len(list_filter(kept, lambda a: {_COMMON} / ({_AREAS} - {_COMMON})::DOUBLE >= 0.4)) = 0 THEN list_append(kept, b) ELSE kept END FROM r JOIN o ON o.image = r.image AND o.n = r.n + 1),
k AS (SELECT image, unnest(arg_max(kept, n)) AS b FROM r GROUP BY image)
SELECT image, b.box_id, b.x1::DOUBLE AS x1, b.y1::DOUBLE AS y1, b.x2::DOUBLE AS x2, b.y2::DOUBLE AS y2, b.score FROM k"""
)
def nms(t):
    """Greedy suppression in each image."""
    return detect.nms(_boxes(t, 0), "image", 0.4)


_BINS = "list_sum(list_transform(generate_series({0}, {1}), lambda i: abs(embedding[i]::DOUBLE)))"
_SIDE = "(4.0::DOUBLE + " + _BINS + " / 8 * 56)"


@query(
    f"""WITH RECURSIVE c AS (SELECT vec_id // 25 AS image, vec_id AS box_id, CAST(vec_id % 25 % 5 * 16 AS DOUBLE) AS cx, CAST(vec_id % 25 // 5 * 16 AS DOUBLE) AS cy, round(abs(embedding[33]::DOUBLE) * 4, 4) AS score,
  {_SIDE.format(1, 8)} AS l, {_SIDE.format(9, 16)} AS r, {_SIDE.format(17, 24)} AS u, {_SIDE.format(25, 32)} AS d FROM embeddings),
b AS (SELECT image, box_id, cx - l AS x1, cy - u AS y1, cx + r AS x2, cy + d AS y2, score FROM c WHERE score >= 0.2),
o AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS n, {{'box_id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}} AS b FROM b),
r(image, n, kept) AS (SELECT image, n, [b] FROM o WHERE n = 1 UNION ALL SELECT o.image, o.n, CASE WHEN len(list_filter(kept, lambda a: {_COMMON} / ({_AREAS} - {_COMMON}) >= 0.3)) = 0 THEN list_append(kept, b) ELSE kept END FROM r JOIN o ON o.image = r.image AND o.n = r.n + 1),
k AS (SELECT image, unnest(arg_max(kept, n)) AS b FROM r GROUP BY image)
SELECT image, b.box_id, round(b.x1, 4) AS x1, round(b.y1, 4) AS y1, round(b.x2, 4) AS x2, round(b.y2, 4) AS y2, b.score FROM k"""
)
def decoded_detections(t):
    """A candidate of each vector: four lengths from distributions of eight bins, about a cell of a grid of five by five; low scores go, then overlaps."""
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    cell = F.col("vec_id") % 25
    c = t("embeddings").select(
        F.floor(F.col("vec_id") / 25).alias("image"), F.col("vec_id").alias("box_id"), (cell % 5 * 16).cast("double").alias("cx"), (F.floor(cell / 5) * 16).cast("double").alias("cy"), F.round(F.get(e, F.lit(32)) * 4, 4).alias("score"),
        F.array(*(F.slice(e, 8 * k + 1, 8) for k in range(4))).alias("sides"),
    )
    got = detect.decoded(c, "image", 0.2, (4.0, 60.0), (4.0, 60.0), 0.3)
    return got.select("image", "box_id", *(F.round(x, 4).alias(x) for x in ("x1", "y1", "x2", "y2")), "score")


@query()
def average_precision(t):
    """Mean over thresholds 0.50 to 0.95 of the area under each image's precision curve."""
    pred, truth = _boxes(t, 0), _boxes(t, 0).where("box_id % 3 <> 0").withColumns({"x1": F.col("x1") + F.col("box_id") % 4, "y2": F.col("y2") - F.col("box_id") % 3})
    n = truth.groupBy("image").agg(F.count("*").alias("n_truth"))
    hits = detect.matches(pred, truth, "image", [0.5 + 0.05 * k for k in range(10)]).join(n, "image", "left").fillna(0, ["n_truth"])
    return detect.average_precision(hits, ["image", "k"], F.col("n_truth")).groupBy("image").agg(F.round(F.avg("ap"), 6).alias("ap"))


_ANCHORS = detect.anchors(100, 100)
_ANCHORS_SQL = ", ".join(f"({k}, {x1}, {y1}, {x2}, {y2})" for k, (x1, y1, x2, y2) in enumerate(_ANCHORS))


@query(f"""WITH a(anchor_id, x1, y1, x2, y2) AS (VALUES {_ANCHORS_SQL}), b AS ({_boxes_sql(0)}), i AS (SELECT DISTINCT image FROM b),
m AS (SELECT i.image, a.anchor_id, max({_COMMON} / ({_AREAS} - {_COMMON})::DOUBLE) AS iou FROM i CROSS JOIN a JOIN b ON b.image = i.image GROUP BY ALL)
SELECT image, anchor_id FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY md5(image || '|' || anchor_id), anchor_id) AS rank FROM m WHERE iou < 0.2) WHERE rank <= 5""")
def anchor_negatives(t):
    """Five grid candidates of each image, in seeded order, that no box overlaps by a fifth. The grid is a constant."""
    truth = _boxes(t, 0)
    grid = F.array(*(F.struct(F.lit(k).cast("long").alias("anchor_id"), *(F.lit(float(v)).alias(c) for v, c in zip(a, ("x1", "y1", "x2", "y2"), strict=True))) for k, a in enumerate(_ANCHORS)))
    cand = truth.select("image").distinct().select("image", F.inline(grid))
    order = [F.md5(F.concat_ws("|", "image", "anchor_id")), F.col("anchor_id")]
    return detect.negatives(cand, truth, "image", 0.2, 5, order).select("image", "anchor_id")


@query("""WITH x AS (SELECT vec_id, i, abs(embedding[i + 1]::DOUBLE) * 4 AS v FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i))
SELECT vec_id, i, CAST(least(floor(least(greatest(v, 0), 1) * 15), 14) AS INT) AS bin, round(least(greatest(v, 0), 1) * 15 - least(floor(least(greatest(v, 0), 1) * 15), 14), 6) AS fraction FROM x""")
def target_bins(t):
    from ..functions.columns import target_bins as bins

    x = t("embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda v: F.abs(v.cast("double")) * 4)).alias("i", "v"))
    b = bins(F.col("v"), 16)
    return x.select("vec_id", F.col("i").cast("long").alias("i"), b["bin"].alias("bin"), F.round(b["fraction"], 6).alias("fraction"))


@query("SELECT l_suppkey, min(l_partkey) AS x1, min(l_linenumber) AS y1, max(l_partkey) AS x2, max(l_linenumber) AS y2 FROM lineitem GROUP BY l_suppkey")
def bbox_union(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("x1"), F.min("l_linenumber").alias("y1"), F.max("l_partkey").alias("x2"), F.max("l_linenumber").alias("y2"))


@query("WITH p AS (SELECT DISTINCT user_id % 50 AS px, event_id % 40 AS py FROM events), c AS (SELECT user_id % 50 AS px, event_id % 40 AS py, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_type <> 'error') SELECT px, py, CAST(coalesce(sum(v) // count(v), 0) AS INT) AS pixel FROM p LEFT JOIN c USING (px, py) GROUP BY px, py")
def pixel_average(t):
    """Sum over count of each pixel, 0 where nothing covers it."""
    e = t("events").select((F.col("user_id") % 50).alias("px"), (F.col("event_id") % 40).alias("py"), F.when(F.col("event_type") != "error", F.floor("value")).alias("v"))
    return e.groupBy("px", "py").agg(F.coalesce(F.floor(F.sum("v") / F.count("v")), F.lit(0)).cast("int").alias("pixel"))
