"""Object tracks: votes, merges, presence, edits and numbering."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_intersection(a: Column, b: Column) -> Column:
    """Area common to two boxes with fields top, left, height, width."""
    h = F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"])
    w = F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(a["left"], b["left"])
    return F.greatest(h, F.lit(0)) * F.greatest(w, F.lit(0))


def pair_votes(df: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """(a, b, votes): groups in which both items occur, a < b, with at least ``least``."""
    x = df.select(group, item).distinct()
    pairs = x.select(group, F.col(item).alias("a")).join(x.select(group, F.col(item).alias("b")), group).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("votes")).where(F.col("votes") >= least)


def overlap_votes(df: DataFrame, frame: str, obj: str, box: str, threshold: float, least: int) -> DataFrame:
    """(a, b, votes): frames in which two objects' boxes overlap by IoU at least the threshold; disjoint boxes are dropped by the join itself."""
    a = df.select(frame, F.col(obj).alias("a"), F.col(box).alias("p"))
    b = df.select(frame, F.col(obj).alias("b"), F.col(box).alias("q"))
    apart = (F.col("p.top") + F.col("p.height") > F.col("q.top")) & (F.col("q.top") + F.col("q.height") > F.col("p.top")) & (F.col("p.left") + F.col("p.width") > F.col("q.left")) & (F.col("q.left") + F.col("q.width") > F.col("p.left"))
    pairs = a.join(b, frame).where((F.col("a") < F.col("b")) & apart)
    common = box_intersection(F.col("p"), F.col("q"))
    union = F.col("p.height") * F.col("p.width") + F.col("q.height") * F.col("q.width") - common
    return pairs.where(common >= threshold * union).groupBy("a", "b").agg(F.count("*").alias("votes")).where(F.col("votes") >= least)


def _hung(both: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each (u, v) of pairs with v under the least of u and both's neighbours of u; and each u under that least one."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), least.select("u", F.col("m").alias("v"))


def merged_ids(nodes: DataFrame, votes: DataFrame) -> DataFrame:
    """(id, merged): ids joined by votes get the smallest of their group. Large-star and small-star steps alternate until each id hangs under its smallest."""
    ids = nodes.select(F.col(nodes.columns[0]).alias("id")).distinct()
    spark = nodes.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        from ..sources.files import shared_folder

        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    now = votes.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    while True:
        # An id is at fault if it has two edges down, or both one down and one up.
        down = now.groupBy("u").agg(F.count("*").alias("n"))
        up = now.select(F.col("v").alias("u")).distinct()
        if down.where("n > 1").select("u").unionByName(down.select("u").join(up, "u", "left_semi")).isEmpty():
            return ids.join(now.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("merged"))
        turned = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = _hung(turned, turned.where("v > u"))
        small, own = _hung(large, large)
        now = small.unionByName(own).where("u <> v").distinct().checkpoint()


def latest_track(df: DataFrame, keys: list[str], track: str) -> DataFrame:
    """Of several tracks that hold the same object in the same frame, the later one's row."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), track).alias("x")).select(*keys, "x.*")


def dense_renumber(df: DataFrame, key: str, item: str) -> DataFrame:
    """Ids from 0 in sorted order within each key."""
    return df.withColumn("new_id", F.dense_rank().over(Window.partitionBy(key).orderBy(item)) - 1)


def with_class(seen: DataFrame, known: DataFrame, key: str = "obj_id") -> DataFrame:
    """Observations with their object's flag; those of objects that aren't known drop out."""
    return seen.join(known, key)


def presence_matrix(objects: DataFrame, frames: DataFrame, seen: DataFrame, obj: str, frame: str, size: str) -> DataFrame:
    """(object, frame, status) for every pair: visible, occluded (seen with size 0) or absent. Frames are the short side and are broadcast only if Spark finds them small."""
    grid = objects.crossJoin(frames)
    status = F.when(F.col(size).isNull(), "absent").when(F.col(size) == 0, "occluded").otherwise("visible")
    return grid.join(seen, [obj, frame], "left").select(obj, frame, status.alias("status"))


def fold_edits(df: DataFrame, key: str, order: list[str], kind: str, item: str, keep: int = 50) -> DataFrame:
    """Items deleted after a log of delete, undo and toggle events, with at most ``keep`` undo steps.

    Events of a key are folded in order: delete adds an item and remembers it, undo takes the last remembered deletion
    back, toggle adds or removes an item without memory; other kinds change nothing. Logs are sorted within partitions and streamed
    through, so of a long log only what is deleted just now, and the undo steps, are held. A null item is an item like others.
    """
    kinds = dict(df.dtypes)
    rows = df.select(key, F.col(kind).alias("kind"), F.col(item).alias("item"), F.struct(*order).alias("at"))
    rows = rows.repartition(F.col(key)).sortWithinPartitions(key, "at", "kind", "item").select(key, "kind", "item")
    out = pa.schema([(key, rows_type(rows, key)), ("deleted", pa.list_(rows_type(rows, "item")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gone, undo, begun = None, set(), deque(maxlen=keep), False

        def row() -> pa.RecordBatch:
            there = sorted(x for x in gone if x is not None) + [None] * (None in gone)
            return pa.RecordBatch.from_pylist([{key: now, "deleted": there}], out)

        for b in batches:
            for k, what, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or k != now:
                    if begun:
                        yield row()
                    now, gone, undo, begun = k, set(), deque(maxlen=keep), True
                if what == "delete":
                    gone.add(x)
                    undo.append(x)
                elif what == "undo" and undo:
                    gone.discard(undo.pop())
                elif what == "toggle":
                    gone.symmetric_difference_update({x})
        if begun:
            yield row()

    return rows.mapInArrow(run, f"{key} {kinds[key]}, deleted array<{kinds[item]}>")


def rows_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def spliced(backward: Column, forward: Column) -> Column:
    """A backward pass reversed without its first element, then the forward pass."""
    return F.concat(F.reverse(F.slice(backward, 2, F.greatest(F.size(backward) - 1, F.lit(0)))), forward)


def polygon_area(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex one, by cutting at each edge."""
    if np.dot(clip[:, 0], np.roll(clip[:, 1], -1)) < np.dot(clip[:, 1], np.roll(clip[:, 0], -1)):
        clip = clip[::-1]
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        got = []
        for k in range(len(out)):
            p, q, s, t = out[k - 1], out[k], side[k - 1], side[k]
            if (s < 0) != (t < 0):
                got.append(p + (q - p) * (s / (s - t)))
            if t >= 0:
                got.append(q)
        out = np.array(got) if got else np.empty((0, 2))
    return out


#: Numbers in the largest array of a step over polygons.
POLYGON_CELLS = 1 << 19


def _areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(area inside both, of a, of b) of each pair of polygons (pairs, points, 2), of any shape; what a boundary goes around twice is outside (even-odd).

    The plane is cut into strips at every vertex and every crossing of two edges. In a strip edges do not cross: sorted by
    their middle, they bound trapezoids, and those that lie in one or both polygons are added up. Pairs and their strips are taken by blocks.
    """
    n, k = len(a), a.shape[1] + b.shape[1]
    if a.shape[1] < 3 or b.shape[1] < 3:
        # Nothing is in both; an area is that of the polygon with itself.
        own = [_areas(x, x)[:, 1] if x.shape[1] >= 3 else np.zeros(n) for x in (a, b)]
        return np.stack([np.zeros(n), *own], axis=1)
    step = max(1, POLYGON_CELLS // (k * k))
    if n > step:
        return np.concatenate([_areas(a[i : i + step], b[i : i + step]) for i in range(0, n, step)])
    x1, y1 = (np.concatenate([a[:, :, c], b[:, :, c]], axis=1) for c in (0, 1))
    x2, y2 = (np.concatenate([np.roll(a[:, :, c], -1, axis=1), np.roll(b[:, :, c], -1, axis=1)], axis=1) for c in (0, 1))
    dx, dy, mine = x2 - x1, y2 - y1, np.arange(k) < a.shape[1]
    cuts = [y1]
    # Each edge against later ones: a pair of edges is looked at once.
    wide = max(1, POLYGON_CELLS // (n * k))
    for lo in range(0, k - 1, wide):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(lo, min(lo + wide, k - 1)), np.arange(lo + 1, k), indexing="ij"))
        i, j = i[i < j], j[i < j]
        det = dx[:, i] * dy[:, j] - dy[:, i] * dx[:, j]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x1[:, j] - x1[:, i]) * dy[:, j] - (y1[:, j] - y1[:, i]) * dx[:, j]) / det
            u = ((x1[:, j] - x1[:, i]) * dy[:, i] - (y1[:, j] - y1[:, i]) * dx[:, i]) / det
            # The height is taken along the flatter edge, and so is exact where that is level.
            at = np.where(np.abs(dy[:, i]) < np.abs(dy[:, j]), y1[:, i] + t * dy[:, i], y1[:, j] + u * dy[:, j])
        at = np.sort(np.where((det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1), at, np.nan), axis=1)
        cuts.append(at[:, : int((~np.isnan(at)).sum(axis=1).max(initial=0))])
    # Those without a value stand last, and bound no strip.
    ys = np.sort(np.concatenate(cuts, axis=1), axis=1)
    total = np.zeros((n, 3))
    wide = max(1, POLYGON_CELLS // (n * k))
    for s in range(0, ys.shape[1] - 1, wide):
        part = ys[:, s : s + wide + 1]
        row, col = np.nonzero(part[:, 1:] > part[:, :-1])
        lo, hi = part[row, col], part[row, col + 1]
        low, high = np.minimum(y1, y2)[row], np.maximum(y1, y2)[row]
        over = (low <= lo[:, None]) & (high >= hi[:, None]) & (dy[row] != 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(over, x1[row] + ((lo + hi)[:, None] / 2 - y1[row]) / dy[row] * dx[row], np.inf)
        order = np.argsort(x, axis=1, kind="stable")
        x, over, of_a = np.take_along_axis(x, order, 1), np.take_along_axis(over, order, 1), mine[order]
        in_a, in_b = np.cumsum(over & of_a, axis=1)[:, :-1] % 2 == 1, np.cumsum(over & ~of_a, axis=1)[:, :-1] % 2 == 1
        with np.errstate(invalid="ignore"):
            width = x[:, 1:] - x[:, :-1]
        for c, inside in enumerate((in_a & in_b, in_a, in_b)):
            total[:, c] += np.bincount(row, np.where(inside, width, 0.0).sum(axis=1) * (hi - lo), n)
    return total


def common_area(a: np.ndarray, b: np.ndarray) -> float:
    """The area inside both polygons, of any shape; what a boundary goes around twice is outside (even-odd)."""
    return float(_areas(*(np.asarray(x, float).reshape(1, -1, 2) for x in (a, b)))[0, 0])


def polygon_ious(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(IoU, share of a inside b) of pairs of polygons (pairs, points, 2) of any shape."""
    inside, of_a, of_b = _areas(a, b).T
    union = of_a + of_b - inside
    share = lambda of: np.divide(inside, of, out=np.zeros(len(of)), where=of > 0)
    return share(union), share(of_a)


def polygon_iou(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(IoU, share of a inside b) of two polygons of any shape."""
    iou, covered = polygon_ious(*(np.asarray(x, float).reshape(1, -1, 2) for x in (a, b)))
    return float(iou[0]), float(covered[0])


def _points(polygons: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First point and number of points of each polygon, -1 for a null, and all points (x, y)."""
    n = pc.fill_null(pc.list_value_length(polygons), -1).to_numpy(zero_copy_only=False)
    points = polygons.flatten()
    if points.null_count or pc.any(pc.not_equal(pc.list_value_length(points), 2)).as_py():
        raise ValueError("a point is an array [x, y]")
    at = np.concatenate([[0], np.cumsum(np.maximum(n, 0))[:-1]]) if len(n) else n
    return at, n, points.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, 2)


def polygon_overlaps(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with iou and covered (the share of a inside b) of two columns of polygons, arrays of [x, y]; null for a null, 0 for fewer than three points."""

    @F.arrow_udf("struct<iou: double, covered: double>")
    def both(left: pa.Array, right: pa.Array) -> pa.Array:
        (p, n, ps), (q, m, qs) = _points(left), _points(right)
        iou, covered, there = np.zeros(len(n)), np.zeros(len(n)), (n >= 0) & (m >= 0)
        # Pairs with as many points are taken together.
        for i, j in np.unique(np.stack([n, m], axis=1)[there], axis=0):
            at = np.flatnonzero((n == i) & (m == j))
            iou[at], covered[at] = polygon_ious(ps[p[at, None] + np.arange(i)], qs[q[at, None] + np.arange(j)])
        return pa.StructArray.from_arrays([pa.array(iou), pa.array(covered)], ["iou", "covered"], mask=pa.array(~there))

    return df.withColumn("__o", both(F.col(a), F.col(b))).withColumns({"iou": F.col("__o.iou"), "covered": F.col("__o.covered")}).drop("__o")
