"""Geometry on arrays: rigid and similar transforms, homographies, cameras."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def embed(points: np.ndarray) -> np.ndarray:
    return np.concatenate([points, np.ones((len(points), 1))], axis=1)


def unembed(points: np.ndarray) -> np.ndarray:
    return points[:, :-1] / points[:, -1:]


def rigid(a: np.ndarray, b: np.ndarray, scaled: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(R, t, s) with b = s R a + t in the least-squares sense; s is 1 unless scaled. The inputs stay as they are."""
    ca, cb = a.mean(axis=0), b.mean(axis=0)
    x, y = a - ca, b - cb
    u, d, vt = np.linalg.svd(y.T @ x / len(a))
    sign = np.ones(len(d))
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        sign[-1] = -1
    r = u @ np.diag(sign) @ vt
    s = float((d * sign).sum() / (x**2).sum(axis=1).mean()) if scaled else 1.0
    return r, cb - s * r @ ca, s


def rigid_inverse(r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return r.T, -r.T @ t


def rigid_2d(xs: Column, ys: Column, us: Column, vs: Column, n: Column) -> dict[str, Column]:
    """Angle of the best rigid transform of planar points (x, y) to (u, v), as aggregates, from centred sums."""
    dot = F.sum(xs * us + ys * vs) - (F.sum(xs) * F.sum(us) + F.sum(ys) * F.sum(vs)) / n
    cross = F.sum(xs * vs - ys * us) - (F.sum(xs) * F.sum(vs) - F.sum(ys) * F.sum(us)) / n
    return {"angle": F.atan2(cross, dot)}


def rigid_sums(x: Column, y: Column, u: Column, v: Column) -> list[Column]:
    """Aggregates that rigid_of_sums needs: means and mean products of points (x, y) and (u, v)."""
    return [F.avg(c).alias(n) for n, c in (("mx", x), ("my", y), ("mu", u), ("mv", v), ("dot", x * u + y * v), ("cross", x * v - y * u))]


def rigid_of_sums() -> dict[str, Column]:
    """Cosine, sine and shift of the turn that takes points (x, y) to (u, v) with the least squares, of rows of rigid_sums. Null where the points have no extent."""
    mx, my, mu, mv = (F.col(n) for n in ("mx", "my", "mu", "mv"))
    along, across = F.col("dot") - (mx * mu + my * mv), F.col("cross") - (mx * mv - my * mu)
    size = F.nullif(F.sqrt(along * along + across * across), F.lit(0.0))
    c, s = along / size, across / size
    return {"c": c, "s": s, "tx": mu - (c * mx - s * my), "ty": mv - (s * mx + c * my)}


def through(m: list[list[Column]], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3x3 projective matrix: lifted to (x, y, 1) and divided by the last coordinate."""
    u, v, w = (row[0] * x + row[1] * y + row[2] for row in m)
    return u / w, v / w


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3x3 map of four or more point pairs by the direct linear transform, on normalised points."""
    def normal(p: np.ndarray) -> np.ndarray:
        c = p.mean(axis=0)
        s = np.sqrt(2) / max(np.linalg.norm(p - c, axis=1).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    ta, tb = normal(src), normal(dst)
    p, q = (embed(src) @ ta.T), (embed(dst) @ tb.T)
    rows = []
    for (x, y, w), (u, v, z) in zip(p, q, strict=True):
        rows += [[0, 0, 0, -z * x, -z * y, -z * w, v * x, v * y, v * w], [z * x, z * y, z * w, 0, 0, 0, -u * x, -u * y, -u * w]]
    h = np.linalg.inv(tb) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2]


def intrinsics(homographies: list[np.ndarray]) -> np.ndarray:
    """The camera matrix that three or more views of a plane agree on."""
    def v(h: np.ndarray, i: int, j: int) -> list[float]:
        a, b = h[:, i], h[:, j]
        return [a[0] * b[0], a[0] * b[1] + a[1] * b[0], a[1] * b[1], a[2] * b[0] + a[0] * b[2], a[2] * b[1] + a[1] * b[2], a[2] * b[2]]

    m = np.array([row for h in homographies for row in (v(h, 0, 1), np.subtract(v(h, 0, 0), v(h, 1, 1)))])
    b11, b12, b22, b13, b23, b33 = np.linalg.svd(m)[2][-1]
    py = (b12 * b13 - b11 * b23) / (b11 * b22 - b12**2)
    scale = b33 - (b13**2 + py * (b12 * b13 - b11 * b23)) / b11
    fx, fy = np.sqrt(scale / b11), np.sqrt(scale * b11 / (b11 * b22 - b12**2))
    skew = -b12 * fx**2 * fy / scale
    return np.array([[fx, skew, skew * py / fy - b13 * fx**2 / scale], [0, fy, py], [0, 0, 1]])


def pose(k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, t) of a plane's view from the camera matrix and its homography."""
    m = np.linalg.inv(k) @ h
    m /= np.linalg.norm(m[:, 0])
    if m[2, 2] < 0:
        m = -m
    u, _, vt = np.linalg.svd(np.stack([m[:, 0], m[:, 1], np.cross(m[:, 0], m[:, 1])], axis=1))
    return u @ vt, m[:, 2]


def project(points: np.ndarray, k: np.ndarray, r: np.ndarray, t: np.ndarray, k1: float = 0.0, k2: float = 0.0) -> np.ndarray:
    """Pixels of points in space through a camera with two radial terms."""
    p = points @ r.T + t
    x = p[:, :2] / p[:, 2:]
    d = (x**2).sum(axis=1, keepdims=True)
    return unembed(embed(x * (1 + k1 * d + k2 * d**2)) @ k.T)


def distortion(points: list[np.ndarray], pixels: list[np.ndarray], k: np.ndarray, poses: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """k1, k2 by linear least squares on the difference to the undistorted projection."""
    rows, rest = [], []
    for p, q, (r, t) in zip(points, pixels, poses, strict=True):
        ideal = project(p, k, r, t)
        c = p @ r.T + t
        d = ((c[:, :2] / c[:, 2:]) ** 2).sum(axis=1, keepdims=True)
        off = ideal - k[:2, 2]
        rows.append(np.stack([(off * d).ravel(), (off * d**2).ravel()], axis=1))
        rest.append((q - ideal).ravel())
    return tuple(np.linalg.lstsq(np.concatenate(rows), np.concatenate(rest), rcond=None)[0])


def refine(residual, x: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Levenberg-Marquardt with a numerical Jacobian."""
    lam, r = 1e-3, residual(x)
    for _ in range(rounds):
        j = np.stack([(residual(x + e) - r) / s for s, e in ((s, s * np.eye(len(x))[i]) for i, s in enumerate(1e-6 * np.maximum(1, np.abs(x))))], axis=1)
        a, g = j.T @ j, j.T @ r
        step = np.linalg.solve(a + lam * np.diag(np.maximum(np.diag(a), 1e-12)), -g)
        new = residual(x + step)
        if new @ new < r @ r:
            done = abs(r @ r - new @ new) < 1e-12 * (r @ r + 1e-30)
            x, r, lam = x + step, new, lam / 3
            if done:
                break
        else:
            lam *= 4
    return x


def undistorted(points: np.ndarray, k: np.ndarray, k1: float, k2: float, rounds: int = 20) -> np.ndarray:
    """Where pixels would lie without the radial terms, by fixed-point iteration."""
    y = unembed(embed(points) @ np.linalg.inv(k).T)
    x = y.copy()
    for _ in range(rounds):
        d = (x**2).sum(axis=1, keepdims=True)
        x = y / (1 + k1 * d + k2 * d**2)
    return unembed(embed(x) @ k.T)


def projected(x: Column, y: Column, z: Column, fx: float, fy: float, px: float, py: float, k1: float = 0.0, k2: float = 0.0) -> tuple[Column, Column]:
    """Pixel columns of points in the camera's frame."""
    a, b = x / z, y / z
    d = a * a + b * b
    f = 1 + k1 * d + k2 * d * d
    return fx * a * f + px, fy * b * f + py


def reprojection_error(dx: Column, dy: Column) -> dict[str, Column]:
    """Mean and root mean square of distances, as aggregates."""
    e = F.sqrt(dx * dx + dy * dy)
    return {"mean_error": F.avg(e), "rms_error": F.sqrt(F.avg(e * e))}
