"""Cameras calibrated from views of a plane, all at once: sums of products per view and camera instead of a group per camera.

Observations are rows (camera, view, x, y, u, v): a point of the plane and the pixel that shows
it. Every step is an aggregate of products (normal equations) over points, views or
cameras, and a small solution for each row of it:

1. a view's homography from 24 moment sums of its points (direct linear transform);
2. a camera's matrix from the sums of its views' conditions on the image of the absolute conic;
3. a view's pose from both;
4. two radial terms by linear least squares over the camera's points;
5. refinement of all parameters by Levenberg-Marquardt: a round sums JᵀJ and Jᵀr per view, takes the
   views out of the camera's system (Schur complement), solves seven unknowns per camera and joins the
   step back to the views. Each camera has its own damping and stops by itself.

The radial terms act on the distance from the principal point in units of the focal
length, after skew. No group of rows is held anywhere: points of a view, and views of a camera,
may lie in any number of tasks. A round's parameters are a table in the checkpoint folder.

A view needs four points in general position and a camera three views; cameras for which a
step has no solution keep ``ok`` false and the parameters that they had. Rows with a null are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written

#: Camera parameters, in order; a view has a rotation (nine numbers) and a shift.
CAMERA = ("fx", "fy", "skew", "px", "py", "k1", "k2")
NC, NV = len(CAMERA), 6
SIZE = NC + NV
UPPER = np.triu_indices(SIZE)
ROUNDS, STILL = 60, 1e-14
#: Pixels of error, root mean square, below which nothing is left to gain.
EXACT = 1e-9


def _matrix(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), *shape)


def _arrays(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x.reshape(len(x), -1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _mapped(df: DataFrame, run: Callable[..., list], columns: list[str], schema: str) -> DataFrame:
    """df's rows through a function of whole batches that takes the named columns and returns new ones, behind the first two."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = run(*(b.column(c) for c in columns))
                yield pa.RecordBatch.from_arrays(got, [f"c{i}" for i in range(len(got))])

    return df.mapInArrow(each, schema)


def _array_sum(column: str):
    """Sums of arrays, entry by entry, partial in each task."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column)))).alias(column)


def project(x: np.ndarray, y: np.ndarray, camera: np.ndarray, turn: np.ndarray, shift: np.ndarray, derived: bool = False):
    """(u, v) of plane points, each with its own camera (n, 7), rotation (n, 3, 3) and shift; with ``derived`` also the derivatives (n, 2, 13) by camera, small turn and shift."""
    fx, fy, skew, px, py, k1, k2 = camera.T
    q = turn[:, :, 0] * x[:, None] + turn[:, :, 1] * y[:, None]
    p = q + shift
    a, b = p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]
    c = a + skew * b / fx
    s = c * c + b * b
    f, g = 1 + k1 * s + k2 * s * s, k1 + 2 * k2 * s
    out = np.stack([px + fx * c * f, py + fy * b * f], axis=1)
    if not derived:
        return out
    u_c, u_b, v_c, v_b = fx * (f + 2 * c * c * g), 2 * fx * c * b * g, 2 * fy * b * c * g, fy * (f + 2 * b * b * g)
    zero, one = np.zeros_like(a), np.ones_like(a)
    by_fx = -skew * b / fx**2
    j = np.empty((len(x), 2, SIZE))
    j[:, 0, :NC] = np.stack([c * f + u_c * by_fx, zero, u_c * b / fx, one, zero, fx * c * s, fx * c * s * s], axis=1)
    j[:, 1, :NC] = np.stack([v_c * by_fx, b * f, v_c * b / fx, zero, one, fy * b * s, fy * b * s * s], axis=1)
    by_a, by_b = np.stack([u_c, v_c], axis=1), np.stack([u_c * skew / fx + u_b, v_c * skew / fx + v_b], axis=1)
    by_p = (by_a[:, :, None] * np.stack([one, zero, -a], axis=1)[:, None] + by_b[:, :, None] * np.stack([zero, one, -b], axis=1)[:, None]) / p[:, 2, None, None]
    j[:, :, NC + 3 :] = by_p
    j[:, :, NC : NC + 3] = np.cross(q[:, None, :], by_p)
    return out, j


def turned(w: np.ndarray) -> np.ndarray:
    """Rotation matrices of small turns (n, 3)."""
    size = np.linalg.norm(w, axis=1)[:, None, None]
    k = np.zeros((len(w), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -w[:, 2], w[:, 1], -w[:, 0]
    k -= k.transpose(0, 2, 1)
    safe = np.maximum(size, 1e-12)
    return np.eye(3) + np.where(size < 1e-6, 1.0, np.sin(safe) / safe) * k + np.where(size < 1e-6, 0.5, (1 - np.cos(safe)) / safe**2) * (k @ k)


# The homography's normal matrix is made of moments of (x, y, 1) with 1, u, v and u^2 + v^2.
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def _homographies(sums: pa.Array, frame: pa.Array) -> np.ndarray:
    m = _matrix(sums, 4, len(_PAIRS))
    full = np.zeros((len(m), 4, 3, 3))
    for k, (i, j) in enumerate(_PAIRS):
        full[:, :, i, j] = full[:, :, j, i] = m[:, :, k]
    a = np.zeros((len(m), 9, 9))
    a[:, :3, :3] = a[:, 3:6, 3:6] = full[:, 0]
    a[:, :3, 6:] = -full[:, 1]
    a[:, 3:6, 6:] = -full[:, 2]
    a[:, 6:, :3], a[:, 6:, 3:6] = a[:, :3, 6:].transpose(0, 2, 1), a[:, 3:6, 6:].transpose(0, 2, 1)
    a[:, 6:, 6:] = full[:, 3]
    h = np.linalg.eigh(a)[1][:, :, 0].reshape(-1, 3, 3)
    mx, my, s, mu, mv, t = _matrix(frame, 6).T
    src, dst = np.zeros_like(h), np.zeros_like(h)
    src[:, 0, 0] = src[:, 1, 1] = s
    src[:, 0, 2], src[:, 1, 2], src[:, 2, 2] = -s * mx, -s * my, 1
    dst[:, 0, 0] = dst[:, 1, 1] = 1 / t
    dst[:, 0, 2], dst[:, 1, 2], dst[:, 2, 2] = mu, mv, 1
    h = dst @ h @ src
    return h / h[:, 2:, 2:]


def _unit(a: str, b: str):
    """The scale that brings points to a distance of about the root of two; null where they are one point."""
    return F.sqrt(2.0 / F.nullif(F.var_pop(a) + F.var_pop(b), F.lit(0.0)))


def homographies(points: DataFrame) -> DataFrame:
    """(camera, view, n, h): each view's map from the plane to pixels as nine numbers, its last 1."""
    frame = points.groupBy("camera", "view").agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in "xyuv"), _unit("x", "y").alias("s"), _unit("u", "v").alias("t")
    )
    frame = frame.where("n >= 4 and s is not null and t is not null")
    near = points.join(frame, ["camera", "view"])
    x, y, u, v = ((F.col(c) - F.col(f"m{c}")) * F.col(k) for c, k in (("x", "s"), ("y", "s"), ("u", "t"), ("v", "t")))
    p, by = (x, y, F.lit(1.0)), (F.lit(1.0), u, v, u * u + v * v)
    sums = near.groupBy("camera", "view").agg(F.array(*(F.sum(w * p[i] * p[j]) for w in by for i, j in _PAIRS)).alias("sums"))
    both = sums.join(frame.select("camera", "view", "n", F.array("mx", "my", "s", "mu", "mv", "t").alias("frame")), ["camera", "view"])
    kinds = dict(points.dtypes)
    return _mapped(both, lambda c, w, n, s, f: [c, w, n, _arrays(_homographies(s, f))], ["camera", "view", "n", "sums", "frame"], f"camera {kinds['camera']}, view {kinds['view']}, n long, h array<double>")


def _conditions(h: pa.Array, frame: pa.Array) -> np.ndarray:
    """Each view's two conditions as the sum of their outer products, in the camera's own pixel frame."""
    mu, mv, t = _matrix(frame, 3).T
    norm = np.zeros((len(h), 3, 3))
    norm[:, 0, 0] = norm[:, 1, 1] = t
    norm[:, 0, 2], norm[:, 1, 2], norm[:, 2, 2] = -t * mu, -t * mv, 1
    m = norm @ _matrix(h, 3, 3)
    m /= np.linalg.norm(m[:, :, :2], axis=(1, 2))[:, None, None]

    def v(i: int, j: int) -> np.ndarray:
        a, b = m[:, :, i], m[:, :, j]
        return np.stack([a[:, 0] * b[:, 0], a[:, 0] * b[:, 1] + a[:, 1] * b[:, 0], a[:, 1] * b[:, 1], a[:, 2] * b[:, 0] + a[:, 0] * b[:, 2], a[:, 2] * b[:, 1] + a[:, 1] * b[:, 2], a[:, 2] * b[:, 2]], axis=1)

    rows = np.stack([v(0, 1), v(0, 0) - v(1, 1)], axis=1)
    return rows.transpose(0, 2, 1) @ rows


def _matrices(sums: pa.Array, frame: pa.Array) -> np.ndarray:
    """(n, 7) camera parameters, without radial terms; NaN where the views do not determine them."""
    b11, b12, b22, b13, b23, b33 = np.linalg.eigh(_matrix(sums, 6, 6))[1][:, :, 0].T
    mu, mv, t = _matrix(frame, 3).T
    with np.errstate(invalid="ignore", divide="ignore"):
        det = b11 * b22 - b12 * b12
        cy = (b12 * b13 - b11 * b23) / det
        scale = b33 - (b13 * b13 + cy * (b12 * b13 - b11 * b23)) / b11
        fx, fy = np.sqrt(scale / b11), np.sqrt(scale * b11 / det)
        skew = -b12 * fx * fx * fy / scale
        cx = skew * cy / fy - b13 * fx * fx / scale
        zero = np.zeros_like(fx)
        return np.stack([fx / t, fy / t, skew / t, cx / t + mu, cy / t + mv, zero, zero], axis=1)


def _poses(camera: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(n, 12): rotation and shift of views, the plane in front of the camera."""
    fx, fy, skew, px, py = camera.T[:5]
    k = np.zeros((len(h), 3, 3))
    k[:, 0, 0], k[:, 0, 1], k[:, 0, 2], k[:, 1, 1], k[:, 1, 2], k[:, 2, 2] = fx, skew, px, fy, py, 1
    m = np.linalg.solve(k, h)
    m *= (2 / np.linalg.norm(m[:, :, :2], axis=1).sum(axis=1) * np.where(m[:, 2, 2] < 0, -1, 1))[:, None, None]
    u, _, vt = np.linalg.svd(np.stack([m[:, :, 0], m[:, :, 1], np.cross(m[:, :, 0], m[:, :, 1])], axis=2))
    return np.concatenate([(u @ vt).reshape(-1, 9), m[:, :, 2]], axis=1)


def _radial(x, y, u, v, camera, pose) -> np.ndarray:
    """Each point's part of the normal equations of k1 and k2."""
    cam, at = _matrix(camera, NC), _matrix(pose, 12)
    ideal = project(x, y, cam, at[:, :9].reshape(-1, 3, 3), at[:, 9:])
    off = ideal - cam[:, 3:5]
    s = ((off / cam[:, :2]) ** 2).sum(axis=1, keepdims=True)
    a1, a2, r = off * s, off * s * s, np.stack([u, v], axis=1) - ideal
    return np.stack([(a1 * a1).sum(axis=1), (a1 * a2).sum(axis=1), (a2 * a2).sum(axis=1), (a1 * r).sum(axis=1), (a2 * r).sum(axis=1)], axis=1)


def _normal(x, y, u, v, camera, pose) -> np.ndarray:
    """Each point's part of JᵀJ (upper triangle), Jᵀr and rᵀr."""
    cam, at = _matrix(camera, NC), _matrix(pose, 12)
    got, j = project(x, y, cam, at[:, :9].reshape(-1, 3, 3), at[:, 9:], derived=True)
    r = np.stack([u, v], axis=1) - got
    full = j.transpose(0, 2, 1) @ j
    return np.concatenate([full[:, UPPER[0], UPPER[1]], (j * r[:, :, None]).sum(axis=1), (r * r).sum(axis=1, keepdims=True)], axis=1)


def _per_view(points: DataFrame, params: DataFrame, part: Callable) -> DataFrame:
    """(camera, view, sums): the parts of a view's points, summed in each batch first and then across."""
    kinds = dict(points.dtypes)
    schema = f"camera {kinds['camera']}, view {kinds['view']}, sums array<double>"
    joined = points.join(params, ["camera", "view"]).select("camera", "view", "x", "y", "u", "v", "params", "pose")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = part(*(b.column(i).to_numpy() for i in range(2, 6)), b.column(6), b.column(7))
            key = b.select(["camera", "view"]).to_pandas()
            group = key.groupby(["camera", "view"], sort=False).ngroup().to_numpy()
            first = np.unique(group, return_index=True)[1]
            sums = np.zeros((len(first), parts.shape[1]))
            np.add.at(sums, group, parts)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first)), b.column(1).take(pa.array(first)), _arrays(sums)], ["camera", "view", "sums"])

    return joined.mapInArrow(each, schema).groupBy("camera", "view").agg(_array_sum("sums"))


def _system(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(UPPER[0])
    a = np.zeros((len(sums), SIZE, SIZE))
    a[:, UPPER[0], UPPER[1]] = a[:, UPPER[1], UPPER[0]] = sums[:, :n]
    return a, sums[:, n : n + SIZE]


def _damped(a: np.ndarray, damping: np.ndarray) -> np.ndarray:
    i = np.arange(SIZE)
    a = a.copy()
    a[:, i, i] += damping[:, None] * np.maximum(a[:, i, i], 1e-12)
    return a


def _reduced(sums: pa.Array, damping: pa.Array) -> np.ndarray:
    """A view's part of its camera's system, the view taken out: 28 + 7 + 1 numbers."""
    raw = _matrix(sums, -1)
    a, g = _system(raw)
    a = _damped(a, damping.to_numpy())
    w = np.linalg.solve(a[:, NC:, NC:], np.concatenate([a[:, NC:, :NC], g[:, NC:, None]], axis=2))
    s = a[:, :NC, :NC] - a[:, :NC, NC:] @ w[:, :, :NC]
    r = g[:, :NC] - (a[:, :NC, NC:] @ w[:, :, NC:])[:, :, 0]
    up = np.triu_indices(NC)
    return np.concatenate([s[:, up[0], up[1]], r, raw[:, -1:]], axis=1)


def _camera_steps(sums: pa.Array) -> np.ndarray:
    raw, up = _matrix(sums, -1), np.triu_indices(NC)
    s = np.zeros((len(raw), NC, NC))
    s[:, up[0], up[1]] = s[:, up[1], up[0]] = raw[:, : len(up[0])]
    scale = 1 / np.sqrt(np.maximum(np.diagonal(s, axis1=1, axis2=2), 1e-300))
    s = s * scale[:, :, None] * scale[:, None, :]
    r = raw[:, len(up[0]) : len(up[0]) + NC] * scale
    return (np.linalg.pinv(s, rcond=1e-14, hermitian=True) @ r[:, :, None])[:, :, 0] * scale


def _view_steps(sums: pa.Array, damping: pa.Array, step: pa.Array, pose: pa.Array) -> np.ndarray:
    """The views' poses after the step that goes with their camera's."""
    a, g = _system(_matrix(sums, -1))
    a = _damped(a, damping.to_numpy())
    d = _matrix(step, NC)
    v = np.linalg.solve(a[:, NC:, NC:], g[:, NC:, None] - a[:, NC:, :NC] @ d[:, :, None])[:, :, 0]
    at = _matrix(pose, 12)
    turn = turned(v[:, :3]) @ at[:, :9].reshape(-1, 3, 3)
    return np.concatenate([turn.reshape(-1, 9), at[:, 9:] + v[:, 3:]], axis=1)


def initial(points: DataFrame) -> DataFrame:
    """(camera, view, params, pose): steps 1 to 4. Cameras whose views do not determine them are left out."""
    kinds = dict(points.dtypes)
    keys = f"camera {kinds['camera']}, view {kinds['view']}"
    own = points.groupBy("camera").agg(F.array(F.avg("u"), F.avg("v"), _unit("u", "v")).alias("frame"))
    views = written(homographies(points))
    framed = views.join(own, "camera")
    parts = _mapped(framed, lambda c, h, f: [c, _arrays(_conditions(h, f))], ["camera", "h", "frame"], f"camera {kinds['camera']}, sums array<double>")
    sums = parts.groupBy("camera").agg(_array_sum("sums"), F.count("*").alias("views")).where("views >= 3").join(own, "camera")
    cameras = _mapped(sums, lambda c, s, f: [c, _arrays(_matrices(s, f))], ["camera", "sums", "frame"], f"camera {kinds['camera']}, params array<double>")
    cameras = cameras.where(F.forall("params", lambda p: ~F.isnan(p)))
    posed = written(_mapped(views.join(cameras, "camera"), lambda c, w, h, p: [c, w, p, _arrays(_poses(_matrix(p, NC), _matrix(h, 3, 3)))], ["camera", "view", "h", "params"], f"{keys}, params array<double>, pose array<double>"))
    k = _per_view(points, posed, _radial).groupBy("camera").agg(_array_sum("sums")).select("camera", *(F.get("sums", F.lit(i)).alias(f"s{i}") for i in range(5)))
    # Without any distance from the middle there is nothing to tell the terms by: they are 0.
    det = F.nullif(F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1"), F.lit(0.0))
    k = k.select("camera", F.array(*(F.coalesce(top / det, F.lit(0.0)) for top in (F.col("s3") * F.col("s2") - F.col("s4") * F.col("s1"), F.col("s4") * F.col("s0") - F.col("s3") * F.col("s1")))).alias("k"))
    return posed.join(k, "camera").select("camera", "view", F.concat(F.slice("params", 1, 5), "k").alias("params"), "pose")


def calibrated(observations: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(camera, fx, fy, skew, px, py, k1, k2, n, rms, ok) and (camera, view, pose) of observations (camera, view, x, y, u, v).

    ``pose`` is the rotation by rows and the shift. ``ok``: the refinement came to rest within ``rounds`` rounds.
    """
    points = written(observations.select("camera", "view", *(F.col(c).cast("double").alias(c) for c in "xyuv")).dropna())
    kinds = dict(points.dtypes)
    keys = f"camera {kinds['camera']}, view {kinds['view']}"
    size = len(UPPER[0]) + SIZE + 1
    start = initial(points).withColumns({"damping": F.lit(1e-3), "done": F.lit(False), "tries": F.lit(0)})
    cost = F.get("sums", F.lit(size - 1))

    def measured(df: DataFrame) -> DataFrame:
        """df with each view's sums at its parameters and its camera's whole cost."""
        got = df.join(_per_view(points, df.select("camera", "view", "params", "pose"), _normal), ["camera", "view"])
        return got.join(got.groupBy("camera").agg(F.sum(cost).alias("cost")), "camera")

    now = written(measured(start))
    for _ in range(rounds):
        live = now.where("not done")
        if live.isEmpty():
            break
        reduced = _mapped(live, lambda c, s, d: [c, _arrays(_reduced(s, d))], ["camera", "sums", "damping"], f"camera {kinds['camera']}, sums array<double>")
        steps = _mapped(reduced.groupBy("camera").agg(_array_sum("sums")), lambda c, s: [c, _arrays(_camera_steps(s))], ["camera", "sums"], f"camera {kinds['camera']}, step array<double>")
        tried = _mapped(live.join(steps, "camera"), lambda c, w, s, d, t, p, q: [c, w, _arrays(_matrix(p, NC) + _matrix(t, NC)), _arrays(_view_steps(s, d, t, q))], ["camera", "view", "sums", "damping", "step", "params", "pose"], f"{keys}, params array<double>, pose array<double>")
        new = measured(tried).select("camera", "view", *(F.col(c).alias(f"new_{c}") for c in ("params", "pose", "sums", "cost")))
        both = live.join(new, ["camera", "view"])
        better = F.coalesce(~F.isnan("new_cost") & (F.col("new_cost") < F.col("cost")), F.lit(False))
        little = better & ((F.col("cost") - F.col("new_cost") <= STILL * F.col("cost")) | (F.col("new_cost") <= EXACT**2))
        # A camera is at rest when steps gain nothing, or when no step, however small, is better.
        moved = both.select(
            "camera", "view", *(F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("params", "pose", "sums", "cost")),
            F.when(better, F.col("damping") / 10).otherwise(F.col("damping") * 10).alias("damping"), (little | (~better & (F.col("tries") >= 4))).alias("done"), F.when(better, F.lit(0)).otherwise(F.col("tries") + 1).alias("tries"),
        )
        now = written(now.where("done").unionByName(moved))
    n = points.groupBy("camera").agg(F.count("*").alias("n"))
    cameras = now.groupBy("camera").agg(F.min("params").alias("params"), F.min("cost").alias("cost"), F.bool_and("done").alias("ok")).join(n, "camera")
    named = [F.get("params", F.lit(i)).alias(c) for i, c in enumerate(CAMERA)]
    return cameras.select("camera", *named, "n", F.sqrt(F.col("cost") / F.col("n")).alias("rms"), "ok"), now.select("camera", "view", "pose")
