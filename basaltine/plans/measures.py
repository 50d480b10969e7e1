"""Training measures, schedules, quotas and model functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns
from ..operators import detect, geometry
from .registry import query


def _scored(t):
    """Labels with a probability that depends on the document."""
    d = t("documents").select("doc_id", ((F.col("n_chars") % 97) / 97.0 * 0.98 + 0.01).alias("p"))
    return t("labels").join(d, "doc_id").select("doc_id", "quality", "toxic", "p")


_P = "s AS (SELECT doc_id, quality, toxic, (n_chars % 97) / 97.0::DOUBLE * 0.98 + 0.01 AS p FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {_P}, r AS (SELECT *, round_even(p, 0) AS said FROM s), c AS (SELECT count(*) FILTER (WHERE said = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE said = 0 AND quality = 1) AS fn, count(*) FILTER (WHERE said = 1 AND quality = 0) AS fp, avg(CASE WHEN said = quality THEN 1.0 ELSE 0.0 END) AS accuracy FROM r)
SELECT round(accuracy, 6) AS accuracy, round(tp / (tp + fn + 1e-8), 6) AS recall, round(tp / (tp + fp + 1e-8), 6) AS "precision" FROM c""")
def binary_metrics(t):
    return _scored(t).agg(*(F.round(c, 6).alias(k) for k, c in detect.binary_metrics(F.col("p"), F.col("quality")).items()))


@query(f"WITH {_P}, a AS (SELECT toxic, CASE WHEN quality = 1 THEN p ELSE 1 - p END AS pt, CASE WHEN quality = 1 THEN 0.25 ELSE 0.75 END AS w FROM s) SELECT toxic, round(avg(-w * ln(pt + 1e-8) * pow(abs(1 - pt), 2)), 6) AS loss FROM a GROUP BY toxic")
def focal_loss(t):
    return _scored(t).groupBy("toxic").agg(F.round(detect.focal_loss(F.col("p"), F.col("quality")), 6).alias("loss"))


@query(f"WITH {_P} SELECT toxic, round(avg(-pow(abs(quality - p), 2) * ((1 - quality) * ln(1 - p) + quality * ln(p))), 6) AS loss FROM s GROUP BY toxic")
def quality_focal_loss(t):
    return _scored(t).groupBy("toxic").agg(F.round(detect.quality_focal_loss(F.col("p"), F.col("quality")), 6).alias("loss"))


@query(f"WITH {_P}, b AS (SELECT doc_id // 64 AS batch, avg(p) AS m FROM s GROUP BY 1) SELECT round(avg(m), 6) AS metric, count(*) AS batches FROM b")
def batch_mean_of_means(t):
    b = _scored(t).groupBy(F.floor(F.col("doc_id") / 64).alias("batch")).agg(F.avg("p").alias("m"))
    return b.agg(F.round(F.avg("m"), 6).alias("metric"), F.count("*").alias("batches"))


@query("""WITH i AS (SELECT event_id AS s, CAST(event_id % 1000 AS DOUBLE) AS i FROM events)
SELECT s AS step, round(CASE WHEN i <= 100 THEN 0.01 * i / 100 WHEN i <= 400 THEN 0.002 + 0.5 * (0.01 - 0.002) * (1 + cos(pi() * (i - 100) / 300)) WHEN i <= 700 THEN 0.002 ELSE 0.002 * pow(0.0001 / 0.002, (i - 700) / 1000) END, 12) AS lr FROM i""")
def lr_schedule(t):
    """Each event's number as a step."""
    lr = detect.learning_rate(F.col("event_id"), 0.01, 0.002, 0.0001, 100, 300, 300, 300)
    return t("events").select(F.col("event_id").alias("step"), F.round(lr, 12).alias("lr"))


@query("""WITH c AS (SELECT source, count(*) AS n, sum(count(*)) OVER () * 2 // 3 AS target FROM documents GROUP BY source),
l AS (SELECT max(l) AS l FROM (SELECT unnest(generate_series(0, (SELECT max(n) FROM c))) AS l) WHERE (SELECT sum(least(n, l)) FROM c) <= (SELECT any_value(target) FROM c)),
r AS (SELECT source, n, target, l, row_number() OVER (PARTITION BY n > l ORDER BY source DESC) AS last, target - sum(least(n, l)) OVER () AS rest FROM c, l)
SELECT source, n, CASE WHEN n <= l THEN n ELSE l + CASE WHEN last <= rest THEN 1 ELSE 0 END END AS kept FROM r""")
def quota_waterfill(t):
    """Counts by source cut down to two thirds of all documents."""
    c = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    total = c.agg((F.floor(F.sum("n") * 2 / 3)).alias("target"))
    return detect.water_fill(c.join(F.broadcast(total), F.lit(True)), [], "source", "n", F.col("target")).select("source", "n", "kept")


@query("SELECT lang, count(*) AS n, CAST(floor(0.3::DOUBLE * floor(count(*) / (1 - 0.5::DOUBLE))) AS BIGINT) AS quota FROM documents GROUP BY lang")
def sample_quota(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("quota", detect.quota(F.lit(0.3), F.col("n"), F.lit(0.5)))


def _triples(t):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return t("embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"), (F.abs(at(2)) + 1).alias("z"), at(3).alias("u"), at(4).alias("v"))


@query("""WITH e AS (SELECT label, embedding[1]::DOUBLE / (abs(embedding[3]::DOUBLE) + 1) AS a, embedding[2]::DOUBLE / (abs(embedding[3]::DOUBLE) + 1) AS b, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v FROM embeddings),
d AS (SELECT label, a, b, u, v, 1 + 0.1 * (a * a + b * b) - 0.02 * (a * a + b * b) * (a * a + b * b) AS f FROM e),
r AS (SELECT label, sqrt((2 * a * f + 0.5 - u) * (2 * a * f + 0.5 - u) + (3 * b * f + 0.25 - v) * (3 * b * f + 0.25 - v)) AS err FROM d)
SELECT label, round(avg(err), 6) AS mean_error, round(sqrt(avg(err * err)), 6) AS rms_error FROM r GROUP BY label""")
def reprojection_error(t):
    """Pin-hole projection with two radial terms against observed points."""
    e = _triples(t)
    px, py = geometry.projected(F.col("x"), F.col("y"), F.col("z"), 2.0, 3.0, 0.5, 0.25, 0.1, -0.02)
    e = e.select("label", (px - F.col("u")).alias("dx"), (py - F.col("v")).alias("dy"))
    return e.groupBy("label").agg(*(F.round(c, 6).alias(k) for k, c in geometry.reprojection_error(F.col("dx"), F.col("dy")).items()))


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS mean, round(var_pop(embedding[1]::DOUBLE), 6) AS variance FROM embeddings GROUP BY label")
def channel_norm(t):
    x = F.get("embedding", F.lit(0)).cast("double")
    return t("embeddings").groupBy("label").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.var_pop(x), 6).alias("variance"))


@query("""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x FROM embeddings) SELECT vec_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(x / (1 + exp(-x)), 6) AS silu,
round(0.5 * x * (1 + (1 - 2 / (exp(2 * sqrt(2 / pi()) * (x + 0.044715 * x * x * x)) + 1))), 6) AS gelu, round(sin(pi() * 4 * x), 6) AS s2, round(cos(pi() * 8 * x), 6) AS c3 FROM e""")
def activations(t):
    x = F.get("embedding", F.lit(0)).cast("double") * 10
    wave = columns.fourier(F.col("x"))
    e = t("embeddings").select("vec_id", x.alias("x"))
    return e.select("vec_id", F.round(columns.sigmoid(F.col("x")), 6).alias("sigmoid"), F.round(columns.silu(F.col("x")), 6).alias("silu"), F.round(columns.gelu(F.col("x")), 6).alias("gelu"), F.round(F.get(wave, F.lit(2)), 6).alias("s2"), F.round(F.get(wave, F.lit(10)), 6).alias("c3"))
