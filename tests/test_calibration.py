"""Calibration by aggregates against NumPy on the whole of one camera."""

import numpy as np
import pytest

from basaltine.operators import calibration, geometry

PLANE = np.stack([a.ravel() for a in np.meshgrid(np.arange(6) * 0.2, np.arange(5) * 0.25)], axis=1)


def seen(camera, views, noise, seed):
    g = np.random.default_rng(seed)
    n, out = len(PLANE), []
    for k in range(views):
        turn, shift = calibration.turned(g.uniform(-0.4, 0.4, (1, 3)))[0], np.array([-0.5, -0.4, 3 + 0.3 * k])
        uv = calibration.project(*PLANE.T, np.tile(camera, (n, 1)), np.tile(turn, (n, 1, 1)), np.tile(shift, (n, 1)))
        out.append(uv + noise * g.standard_normal(uv.shape))
    return out


def test_derivatives():
    camera, turn, shift = np.array([[800, 790, 1.0, 320, 240, -0.1, 0.03]]), calibration.turned(np.array([[0.1, 0.2, 0.3]])), np.array([[0.1, 0.2, 3.0]])
    x, y = np.array([0.3]), np.array([0.4])
    _, j = calibration.project(x, y, camera, turn, shift, derived=True)
    for i in range(13):
        d = np.zeros(13)
        d[i] = 1e-5
        up, down = (calibration.project(x, y, camera + s * d[:7], calibration.turned(s * d[None, 7:10]) @ turn, shift + s * d[10:]) for s in (1, -1))
        assert ((up - down)[0] / 2e-5) == pytest.approx(j[0, :, i], rel=1e-6, abs=1e-6)


def brute(pixels, start):
    """All parameters of one camera by the plain least squares of geometry.refine."""
    n = len(PLANE)

    def residual(p):
        got = []
        for k, uv in enumerate(pixels):
            turn, shift = start[1][k][:9].reshape(3, 3), p[7 + 6 * k + 3 : 7 + 6 * k + 6]
            turn = calibration.turned(p[None, 7 + 6 * k : 7 + 6 * k + 3])[0] @ turn
            got.append((calibration.project(*PLANE.T, np.tile(p[:7], (n, 1)), np.tile(turn, (n, 1, 1)), np.tile(shift, (n, 1))) - uv).ravel())
        return np.concatenate(got)

    x = np.concatenate([start[0], *(np.concatenate([np.zeros(3), p[9:]]) for p in start[1])])
    x = geometry.refine(residual, x, 200)
    return x[:7], np.sqrt((residual(x) ** 2).sum() / (len(pixels) * n))


def test_calibration(spark):
    """Exact views are recovered; noisy ones end where the whole camera's least squares end; too few views give no camera."""
    cameras = {1: [800, 780, 0.5, 320, 240, -0.1, 0.03], 2: [600, 640, 0, 300, 250, 0.05, -0.01], 3: [700, 700, 0, 300, 200, 0, 0]}
    pixels = {1: seen(np.array(cameras[1]), 4, 0.0, 1), 2: seen(np.array(cameras[2]), 5, 0.3, 2), 3: seen(np.array(cameras[3]), 2, 0.0, 3)}
    rows = [(c, k, *map(float, (*p, *q))) for c, views in pixels.items() for k, uv in enumerate(views) for p, q in zip(PLANE, uv, strict=True)]
    rows += [(1, 0, None, 0.0, 0.0, 0.0), (1, 9, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "camera long, view int, x double, y double, u double, v double").repartition(5)
    start = {r.view: (r.params, r.pose) for r in calibration.initial(df.where("camera = 2").dropna()).collect()}
    cams, poses = calibration.calibrated(df)
    got = {r.camera: r for r in cams.collect()}
    assert set(got) == {1, 2} and got[1].ok and got[2].ok
    assert np.array(got[1][1:8]) == pytest.approx(np.array(cameras[1]), abs=1e-6) and got[1].rms < 1e-8
    want, rms = brute(pixels[2], (np.array(start[0][0]), [np.array(start[k][1]) for k in range(5)]))
    assert got[2].rms == pytest.approx(rms, rel=1e-8)
    assert np.array(got[2][1:8]) == pytest.approx(want, rel=1e-4, abs=1e-4)
    at = {(r.camera, r.view): np.array(r.pose) for r in poses.collect()}
    assert len(at) == 9 and all(np.allclose(p[:9].reshape(3, 3) @ p[:9].reshape(3, 3).T, np.eye(3)) for p in at.values())


def test_homographies_equal_numpy(spark):
    uv = seen(np.array([800, 780, 0.5, 320, 240, 0, 0]), 2, 0.2, 5)
    rows = [(1, k, *map(float, (*p, *q))) for k in range(2) for p, q in zip(PLANE, uv[k], strict=True)]
    got = calibration.homographies(spark.createDataFrame(rows, "camera long, view int, x double, y double, u double, v double")).collect()
    for r in got:
        assert np.array(r.h).reshape(3, 3) == pytest.approx(geometry.homography(PLANE, uv[r.view]), rel=1e-5, abs=1e-6)
