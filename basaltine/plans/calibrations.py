"""Cameras of known parameters, seen through generated views and recovered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration
from .registry import query


def views(t):
    """(camera, view, x, y, u, v): a camera for each supplier, five views of a plane of 5 x 6 points each."""
    key = F.col("camera")
    cameras = t("supplier").select(F.col("s_suppkey").alias("camera"))
    cameras = cameras.withColumns(
        {
            "fx": 800.0 + key % 50, "fy": 780.0 + key % 37, "skew": (key % 5) * 0.25, "px": 320.0 + key % 7, "py": 240.0 - key % 11, "k1": -0.1 + (key % 4) * 0.02, "k2": 0.03 - (key % 3) * 0.01,
        }
    )
    v = cameras.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(4))))
    a, b, c = (0.4 * F.sin(F.col("view") * k + key % 9 + k) for k in (1.3, 2.1, 0.7))
    v = v.withColumns({"a": a, "b": b, "c": c}).withColumns(
        {
            "r11": F.cos("c") * F.cos("b"), "r21": F.sin("c") * F.cos("b"), "r31": -F.sin("b"),
            "r12": F.cos("c") * F.sin("b") * F.sin("a") - F.sin("c") * F.cos("a"), "r22": F.sin("c") * F.sin("b") * F.sin("a") + F.cos("c") * F.cos("a"), "r32": F.cos("b") * F.sin("a"),
        }
    )
    p = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5))))
    p = p.withColumns({"x": F.col("i") * 0.25, "y": F.col("j") * 0.2})
    space = [F.col(f"r{k}1") * F.col("x") + F.col(f"r{k}2") * F.col("y") + s for k, s in ((1, F.lit(-0.5)), (2, F.lit(-0.4)), (3, 3.0 + F.col("view") * 0.25))]
    p = p.withColumns({"n": space[0] / space[2], "m": space[1] / space[2]}).withColumn("w", F.col("n") + F.col("skew") * F.col("m") / F.col("fx"))
    s = F.col("w") * F.col("w") + F.col("m") * F.col("m")
    f = 1 + F.col("k1") * s + F.col("k2") * s * s
    return p.select("camera", "view", "x", "y", (F.col("px") + F.col("fx") * F.col("w") * f).alias("u"), (F.col("py") + F.col("fy") * F.col("m") * f).alias("v"))


@query(
    """SELECT s_suppkey AS camera, 800.0::DOUBLE + s_suppkey % 50 AS fx, 780.0::DOUBLE + s_suppkey % 37 AS fy, round((s_suppkey % 5) * 0.25::DOUBLE, 6) + 0.0 AS skew, 320.0::DOUBLE + s_suppkey % 7 AS px, 240.0::DOUBLE - s_suppkey % 11 AS py,
    round(-0.1::DOUBLE + (s_suppkey % 4) * 0.02::DOUBLE, 6) + 0.0 AS k1, round(0.03::DOUBLE - (s_suppkey % 3) * 0.01::DOUBLE, 6) + 0.0 AS k2, 150::BIGINT AS n, 0.0::DOUBLE AS rms, true AS ok FROM supplier"""
)
def camera_calibration(t):
    """All cameras at once, from points alone; parameters to six digits."""
    cameras, _ = calibration.calibrated(views(t))
    r = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return cameras.select("camera", *(r(c) for c in calibration.CAMERA), "n", r("rms"), "ok")
