"""Queries of generated material, crops, scores and ordered delivery."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog, dataset, detect, generate
from ..sources.files import shared_folder
from ..streaming import ordered
from .registry import query

_SPOT = "greatest(0, 1 - sqrt((x - (s * 7 + {k} * 13) % 40)::DOUBLE ** 2 + (y - (s * 11 + {k} * 5) % 30)::DOUBLE ** 2) / 15.0) * ((s * 31 + {k} * 97 + {c} * 57) % 1024)"
_TOTAL = "CAST(floor(least({0} + {1} + {2}, 1023)) AS INT) AS v{c}"
_CHANNELS = ", ".join(_TOTAL.format(*(_SPOT.format(k=k, c=c) for k in range(3)), c=c) for c in range(3))
_TURNED = ", ".join(f"CASE WHEN v{c} = 0 OR 1023 - v{c} <= 200 THEN 0 ELSE 1023 - v{c} END AS c{c}" for c in range(3))


@query(f"""WITH p AS (SELECT s_suppkey AS s, y, x FROM supplier, (SELECT unnest(range(30)) AS y), (SELECT unnest(range(40)) AS x)),
v AS (SELECT s, y, x, {_CHANNELS} FROM p) SELECT s AS image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {_TURNED} FROM v""")
def radial_fades(t):
    """An image of three spots for each supplier."""
    s = F.col("s_suppkey")
    spot = lambda k: F.struct(((s * 7 + k * 13) % 40).alias("cx"), ((s * 11 + k * 5) % 30).alias("cy"), F.array(*((s * 31 + k * 97 + c * 57) % 1024 for c in range(3))).alias("color"))
    images = t("supplier").select(s.alias("image"), F.array(*(spot(k) for k in range(3))).alias("points"))
    pixels = generate.radial_fades(images, "image", "points", 30, 40, 15.0, 200)
    return pixels.select("image", "y", "x", *(F.get("channels", F.lit(c)).alias(f"c{c}") for c in range(3)))


_MM = "CAST(trunc(({}) * (300 / 25.4)) AS BIGINT)"
_CORNER = "round(cos(a) * ({x} - w / 2) - sin(a) * ({y} - w / 2) + w / 2, 4) + 0.0 AS x{k}, round(sin(a) * ({x} - w / 2) + cos(a) * ({y} - w / 2) + w / 2, 4) + 0.0 AS y{k}"
_CORNERS = ", ".join(_CORNER.format(x=f"(l + {dx} * m)", y=f"(u + {dy} * m)", k=k) for k, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)]))


@query(f"""WITH s AS (SELECT p_partkey AS sheet, {_MM.format('p_size + 30')} AS m, {_MM.format('20')} AS g, 0.5::DOUBLE * pi() * (p_partkey % 4) / 4 AS a FROM part),
b AS (SELECT *, CAST(trunc(ceil(sqrt(2 * (2 * m + g)::DOUBLE ** 2) - (2 * m + g) - 2 * g) / 2) AS BIGINT) AS border FROM s),
d AS (SELECT *, (2 * (m + g) + g + 2 * border)::DOUBLE AS w, place, border + g + (place % 2) * (m + g) AS l, border + g + (place // 2) * (m + g) AS u FROM b, (SELECT unnest(range(4)) AS place))
SELECT sheet, 4 * sheet + 1 + place AS marker_id, CAST(w AS BIGINT) AS sheet_w, CAST(round(w * sqrt(2)) AS BIGINT) AS sheet_h, {_CORNERS} FROM d""")
def marker_sheets(t):
    """Four markers on a sheet for each part, turned by eighths of a half turn."""
    key = F.col("sheet")
    sheets = t("part").select(F.col("p_partkey").alias("sheet"), (F.col("p_size") + 30).alias("size"))
    placed = generate.marker_sheet(sheets, F.col("size"), F.lit(20), F.lit(0.5) * F.pi() * (key % 4) / 4, F.array(*(4 * key + 1 + k for k in range(4))))
    return placed.select("sheet", "marker_id", "sheet_w", "sheet_h", *((F.round(f"{n}{k}", 4) + F.lit(0.0)).alias(f"{n}{k}") for k in range(4) for n in "xy"))


_OBJECTS = "SELECT l_suppkey AS video, l_orderkey AS frame, l_linenumber AS obj, l_partkey % 120 - 10 AS x, l_orderkey % 100 - 10 AS y, CAST(l_quantity AS BIGINT) AS w, CAST(l_quantity AS BIGINT) // 2 AS h, l_returnflag = 'R' AS occluded FROM lineitem"


def _objects(t):
    n = F.col("l_quantity").cast("long")
    return t("lineitem").select(
        F.col("l_suppkey").alias("video"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("obj"), (F.col("l_partkey") % 120 - 10).alias("x"), (F.col("l_orderkey") % 100 - 10).alias("y"), n.alias("w"), F.floor(n / 2).alias("h"), (F.col("l_returnflag") == "R").alias("occluded")
    )


@query(f"""WITH o AS ({_OBJECTS}), b AS (SELECT video, frame, obj, greatest(x, 0) AS x1, greatest(y, 0) AS y1, least(x + w, 100) AS x2, least(y + h, 80) AS y2 FROM o WHERE NOT occluded)
SELECT printf('%s_%06d_%04d', video::VARCHAR, frame, obj) AS name, x1, y1, x2, y2, 1.0::DOUBLE AS label FROM b WHERE x2 > x1 AND y2 > y1 ORDER BY video, frame, obj LIMIT 4096""")
def positive_crops(t):
    """Named crops of objects in view; a data set of 4,096 positives is what is asked for."""
    crops = detect.positives(_objects(t), 80, 100, 4096)
    return crops.select(F.format_string("%s_%06d_%04d", F.col("video").cast("string"), "frame", "obj").alias("name"), "x1", "y1", "x2", "y2", F.lit(1.0).alias("label"))


@query("SELECT event_id, least(greatest(value / 100, 0), 1) AS given, 1.0::DOUBLE AS probability FROM events")
def scored_crops(t):
    """A classifier given as a function of batches, and the one that stands in for none."""
    e = t("events").select("event_id", "value", "event_type")
    given = detect.scored(e, "value", "event_type", lambda crops, labels: (crops / 100).clip(0, 1)).withColumnRenamed("probability", "given")
    return detect.scored(given, "value", "event_type").select("event_id", "given", "probability")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error' ORDER BY ts, event_id LIMIT 1000")
def other_classes(t):
    """The first 1,000 rows of other classes: a sample of that size is what is asked for."""
    return catalog.others(t("events"), "event_type", "error", 1000, ["ts", "event_id"]).select("event_id", "event_type")


@query("""WITH e AS (SELECT user_id, event_id, event_id + (event_id * 7919) % 501 AS ready FROM events),
d AS (SELECT *, max(ready) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS delivered FROM e),
a AS (SELECT *, lag(delivered, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS admitted FROM d)
SELECT user_id, event_id, ready, delivered, admitted, coalesce(ready < admitted, false) AS waited FROM a""")
def ordered_delivery(t):
    """Batches made out of order, each user's delivered in order, three ahead at most."""
    e = t("events").select("user_id", "event_id", (F.col("event_id") + F.col("event_id") * 7919 % 501).alias("ready"))
    return dataset.ordered_delivery(e, ["user_id"], "event_id", "ready", 3)


@query("""WITH e AS (SELECT event_id % 4 AS stream, event_id // 4 * 8 AS start, epoch_us(ts) + (event_id * 7919) % 501 * 100000000 AS ready FROM events),
d AS (SELECT *, max(ready) OVER (PARTITION BY stream ORDER BY start ROWS UNBOUNDED PRECEDING) AS delivered FROM e),
a AS (SELECT *, lag(delivered, 3) OVER (PARTITION BY stream ORDER BY start) AS admitted FROM d)
SELECT stream, start, ready, delivered, admitted, coalesce(ready < admitted, false) AS waited FROM a""")
def delivery_stream(t):
    """The streaming form of ordered_delivery over the table's files, read as a stream to its end."""
    kinds = t("events").schema
    e = t.spark.readStream.schema(kinds).parquet(f"{t.sf_dir}/events.parque[t]")
    ready = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") * 7919 % 501 * 100000000)
    e = e.select((F.col("event_id") % 4).alias("stream"), (F.floor(F.col("event_id") / 4) * 8).alias("start"), ready.alias("ready"))
    folder = f"{shared_folder(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    got = ordered.delivered_in_order(e, ["stream"], "start", "ready", 8, 3)
    q = got.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    us = [F.unix_micros(c).alias(c) for c in ("ready", "delivered", "admitted")]
    return t.spark.read.schema(got.schema).parquet(f"{folder}/out").select("stream", "start", *us, "waited")
