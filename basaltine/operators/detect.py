"""Detection and training measures: boxes, suppression, precision, losses, quotas, schedules."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corner_iou(a: list[Column], b: list[Column]) -> Column:
    """IoU of boxes (x1, y1, x2, y2); 0 if the union is empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    common = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    common = np.prod(np.maximum(hi - lo, 0), axis=2)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def suppressed(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """Positions kept by greedy suppression, best first; ties by position."""
    order, kept = np.argsort(-scores, kind="stable"), []
    while len(order):
        best, order = order[0], order[1:]
        kept.append(int(best))
        order = order[iou_matrix(boxes[best : best + 1], boxes[order])[0] < threshold]
    return kept


def nms(df: DataFrame, image: str, threshold: float) -> DataFrame:
    """Rows (image, box_id, x1, y1, x2, y2, score) that survive, per image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("box_id")
        return pdf.iloc[suppressed(pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["score"].to_numpy(float), threshold)]

    return df.groupBy(image).applyInPandas(run, df.schema)


def above(candidates: Column, least: float) -> Column:
    """Candidates (structs with a score) that reach the least score, in their order."""
    return F.filter(candidates, lambda c: c["score"] >= least)


def side_lengths(sides: Column, horizontal: tuple[float, float], vertical: tuple[float, float]) -> list[Column]:
    """Left, right, up and down of a candidate from its four distributions (arrays of bins): the mean of the bins, from 0 to 1, between the least and the greatest length of its direction."""
    mean = lambda bins: F.aggregate(bins, F.lit(0.0), lambda a, x: a + x) / F.size(bins)
    return [lo + mean(F.get(sides, F.lit(k))) * (hi - lo) for k, (lo, hi) in enumerate((horizontal, horizontal, vertical, vertical))]


def decoded(df: DataFrame, image: str, least: float, horizontal: tuple[float, float], vertical: tuple[float, float], threshold: float) -> DataFrame:
    """(image, box_id, x1, y1, x2, y2, score): candidates (image, box_id, cx, cy, score, sides) that reach the least score, as boxes about their cells, after suppression in each image.

    The scores are tested first, in the scan where it can; lengths are made of what passes, and only boxes are shuffled.
    """
    left, right, up, down = side_lengths(F.col("sides"), horizontal, vertical)
    boxes = df.where(F.col("score") >= least).select(image, "box_id", (F.col("cx") - left).alias("x1"), (F.col("cy") - up).alias("y1"), (F.col("cx") + right).alias("x2"), (F.col("cy") + down).alias("y2"), "score")
    return nms(boxes, image, threshold)


def matched(pred: np.ndarray, scores: np.ndarray, truth: np.ndarray, threshold: float) -> np.ndarray:
    """For predictions in order of score: whether each takes a ground-truth box that none before it took."""
    overlap = iou_matrix(pred, truth) if len(truth) else np.zeros((len(pred), 0))
    free, hit = np.ones(len(truth), bool), np.zeros(len(pred), bool)
    for k in np.argsort(-scores, kind="stable"):
        if len(truth):
            value = np.where(free, overlap[k], -1)
            j = int(value.argmax())
            if value[j] >= threshold:
                hit[k], free[j] = True, False
    return hit


def matches(pred: DataFrame, truth: DataFrame, image: str, thresholds: list[float]) -> DataFrame:
    """(image, k, box_id, score, hit) of every prediction at every threshold; an image is one group."""
    box = ["x1", "y1", "x2", "y2"]

    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("box_id")
        sides = p[box].to_numpy(float), p["score"].to_numpy(float), t[box].to_numpy(float)
        return pd.concat([p.assign(k=k, hit=matched(*sides, threshold))[[image, "k", "box_id", "score", "hit"]] for k, threshold in enumerate(thresholds)])

    kind = dict(pred.dtypes)[image]
    return pred.groupBy(image).cogroup(truth.groupBy(image)).applyInPandas(run, f"{image} {kind}, k int, box_id long, score double, hit boolean")


def average_precision(hits: DataFrame, group: list[str], n_truth: Column) -> DataFrame:
    """(group, ap) of rows (group, box_id, score, hit): area under the falling envelope of precision over recall, from (0, 1) to (1, 0)."""
    by_score = Window.partitionBy(*group).orderBy(F.col("score").desc(), "box_id").rowsBetween(Window.unboundedPreceding, 0)
    p = hits.withColumns({"tp": F.sum(F.col("hit").cast("int")).over(by_score), "n": F.count("*").over(by_score), "total": n_truth})
    point = lambda n, recall, precision: F.struct(n.cast("long").alias("n"), recall.alias("recall"), precision.alias("precision"))
    own = point(F.col("n"), F.col("tp") / F.greatest(F.col("total"), F.lit(1)), F.col("tp") / F.col("n"))
    # The first row of a group also brings the two ends.
    ends = F.when(F.col("n") == 1, F.array(point(F.lit(0), F.lit(0.0), F.lit(1.0)), point(F.lit(1 << 60), F.lit(1.0), F.lit(0.0)))).otherwise(F.slice(F.array(own), 1, 0))
    p = p.select(*group, F.inline(F.concat(F.array(own), ends)))
    line = Window.partitionBy(*group).orderBy("n")
    # The greatest precision at this recall or more.
    above = Window.partitionBy(*group).orderBy("recall").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    p = p.withColumn("envelope", F.max("precision").over(above))
    p = p.withColumn("area", (F.col("recall") - F.lag("recall").over(line)) * (F.col("envelope") + F.lag("envelope").over(line)) / 2)
    return p.groupBy(*group).agg(F.sum("area").alias("ap"))


def anchors(height: int, width: int, least: float = 0.1, most: float = 0.5, scales: int = 5) -> list[tuple[int, int, int, int]]:
    """Square candidates (x1, y1, x2, y2) inside an image: corners on a grid of a tenth of the shorter side, sides in equal steps of shares of it."""
    short = min(height, width)
    step = max(1, short // 10)
    sides = [int(s) for s in np.linspace(least * short, most * short, scales)]
    return [(x, y, x + s, y + s) for y in range(0, height - step, step) for x in range(0, width - step, step) for s in sides if x + s <= width and y + s <= height]


def negatives(candidates: DataFrame, truth: DataFrame, image: str, threshold: float, n: int, order: list[Column]) -> DataFrame:
    """Up to n candidates of each image, in the given order, whose greatest IoU with the image's boxes is below the threshold."""
    c, t = candidates.alias("c"), truth.alias("t")
    value = corner_iou([F.col(f"c.{k}") for k in ("x1", "y1", "x2", "y2")], [F.col(f"t.{k}") for k in ("x1", "y1", "x2", "y2")])
    near = c.join(t, image).where(value >= threshold).select(image, F.col("c.anchor_id").alias("anchor_id")).distinct()
    free = candidates.join(near, [image, "anchor_id"], "left_anti")
    return free.withColumn("rank", F.row_number().over(Window.partitionBy(image).orderBy(*order))).where(F.col("rank") <= n)


def positives(objects: DataFrame, height: int, width: int, most: int) -> DataFrame:
    """The crops of objects (video, frame, obj, x, y, w, h, occluded) in view: at most the first ``most`` by video, frame and object.

    Boxes are cut at the frame's border and empty ones left out. ``most`` is the size of the data set asked for; the
    first rows are taken part by part and merged, without a sort of all rows.
    """
    seen = objects.where(~F.col("occluded"))
    box = seen.select(
        "video", "frame", "obj", F.greatest("x", F.lit(0)).alias("x1"), F.greatest("y", F.lit(0)).alias("y1"), F.least(F.col("x") + F.col("w"), F.lit(width)).alias("x2"), F.least(F.col("y") + F.col("h"), F.lit(height)).alias("y2")
    )
    return box.where("x2 > x1 and y2 > y1").orderBy("video", "frame", "obj").limit(most)


def scored(df: DataFrame, crop: str, label: str, classify: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """df with ``probability``: that each crop shows its label, by a function of batches; without one, 1."""
    if classify is None:
        return df.withColumn("probability", F.lit(1.0))

    @F.pandas_udf("double")
    def run(crops: pd.Series, labels: pd.Series) -> pd.Series:
        return classify(crops, labels).astype("float64")

    return df.withColumn("probability", run(crop, label))


def binary_metrics(p: Column, t: Column) -> dict[str, Column]:
    """Aggregates of a probability and a 0/1 target: accuracy (ties to even), recall, precision."""
    said = F.bround(p, 0)
    tp, fn, fp = F.count_if((said == 1) & (t == 1)), F.count_if((said == 0) & (t == 1)), F.count_if((said == 1) & (t == 0))
    return {"accuracy": F.avg((said == t).cast("double")), "recall": tp / (tp + fn + 1e-8), "precision": tp / (tp + fp + 1e-8)}


def focal_loss(p: Column, t: Column, exponent: float = 2.0, positive_weight: float = 0.25) -> Column:
    """Mean focal loss; targets of one class weigh ``positive_weight``, of the other the rest."""
    at = F.when(t == 1, p).otherwise(1.0 - p)
    weight = F.when(t == 1, F.lit(positive_weight)).otherwise(1.0 - positive_weight)
    return F.avg(-weight * F.log(at + 1e-8) * F.pow(F.abs(1 - at), F.lit(exponent)))


def quality_focal_loss(p: Column, t: Column, beta: float = 2.0) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    return F.avg(-F.pow(F.abs(t - p), F.lit(beta)) * ((1 - t) * F.log(1 - p) + t * F.log(p)))


def distribution_focal_loss(left: Column, right: Column, value: Column) -> Column:
    """Cross entropy of the two bins around a value, by nearness."""
    lo = F.floor(value)
    return F.avg(-((lo + 1 - value) * F.log(left) + (value - lo) * F.log(right)))


def learning_rate(step: Column, top: float, steady: float, bottom: float, warmup: int, cooldown: int, decay: int, annealing: int) -> Column:
    """Warm-up to top, cosine fall to steady, constant, exponential fall towards bottom; steps repeat after the whole. The last part's exponent is the step within it over all steps of the whole."""
    cool, flat = warmup + cooldown, warmup + cooldown + decay
    i = F.pmod(step, F.lit(flat + annealing)).cast("double")
    cosine = steady + 0.5 * (top - steady) * (1 + F.cos(math.pi * (i - warmup) / float(cooldown)))
    falling = steady * F.pow(F.lit(bottom / steady), (i - flat) / float(flat + annealing))
    return F.when(i <= warmup, top * i / float(warmup)).when(i <= cool, cosine).when(i <= flat, F.lit(steady)).otherwise(falling)


def quota(part: Column, n: Column, total: Column) -> Column:
    """floor(part * floor(n / (1 - total)))."""
    return F.floor(part * F.floor(n / (1 - total))).cast("long")


def water_fill(df: DataFrame, group: list[str], item: str, amount: str, target: Column) -> DataFrame:
    """Amounts cut down to a group's target: the largest are lowered first, the earliest of equal ones before the others.

    Closed form of lowering the first maximum by one until the sum fits: with level L the greatest for which the sum of
    min(x, L) fits, items above L get L, and the last of them the one that is left over each.
    """
    by_size = Window.partitionBy(*group).orderBy(F.col(amount).asc(), item) if group else Window.orderBy(F.col(amount).asc(), item)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    df = df.withColumns({"__t": target, "__sum": F.sum(amount).over(whole), "__n": F.count("*").over(whole), "__rank": F.row_number().over(by_size), "__before": F.coalesce(F.sum(amount).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    # If all from this rank on were lowered alike, they would stand at this level.
    level = F.floor((F.col("__t") - F.col("__before")) / (F.col("__n") - F.col("__rank") + 1))
    df = df.withColumn("__level", F.min(F.when(level < F.col(amount), F.struct("__rank", level.alias("l")))).over(whole))
    low = F.col("__level.l")
    above = F.col(amount) > low
    df = df.withColumn("__rest", F.col("__t") - F.sum(F.least(F.col(amount), low)).over(whole))
    last = Window.partitionBy(*group, above).orderBy(F.col(item).desc())
    df = df.withColumn("__last", F.row_number().over(last))
    cut = F.when(F.col("__sum") <= F.col("__t"), F.col(amount)).when(above, low + (F.col("__last") <= F.col("__rest")).cast("int")).otherwise(F.col(amount))
    return df.select(*group, item, amount, cut.cast("long").alias("kept"))
