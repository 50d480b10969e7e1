"""Spatial augmentation of rasters and of the points that lie on them.

A stage knows its shape rule, its parameters for a seed, and what it does to
points and to pixels. Parameters and points are column expressions; pixels go
through NumPy in Arrow batches. ``Pipe`` chains stages and checks when it is
built what can be known by then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rng import uniform, uniform_between, uniform_number, uniform_size

DTYPES = {"uint8": np.uint8, "int32": np.int32, "float32": np.float32}


def _point(r: Column, c: Column) -> Column:
    return F.struct(r.alias("r"), c.alias("c"))


@dataclass(frozen=True)
class Flip:
    """Reverse rows with probability ``vertical`` and columns with probability ``horizontal``."""

    vertical: float
    horizontal: float

    def __post_init__(self) -> None:
        if self.vertical <= 0 and self.horizontal <= 0:
            raise ValueError("a flip that never flips")

    static = False
    keeps_static = True

    def params(self, seed: Column, h: Column, w: Column) -> dict[str, Column]:
        return {"flip_v": uniform(seed, 0) <= self.vertical, "flip_h": uniform(seed, 1) <= self.horizontal}

    def shape(self, p: Column, h: Column, w: Column) -> tuple[Column, Column]:
        return h, w

    def point(self, x: Column, p: Column, h: Column, w: Column) -> Column:
        return _point(F.when(p["flip_v"], h - 1 - x["r"]).otherwise(x["r"]), F.when(p["flip_h"], w - 1 - x["c"]).otherwise(x["c"]))

    def raster(self, a: np.ndarray, seed: int) -> np.ndarray:
        if uniform_number(seed, 0) <= self.vertical:
            a = a[::-1]
        return a[:, ::-1] if uniform_number(seed, 1) <= self.horizontal else a


@dataclass(frozen=True)
class RandomCrop:
    """A window of seeded size and place. Height and width share one draw; points may fall outside."""

    min_h: int
    min_w: int
    max_h: int
    max_w: int

    def __post_init__(self) -> None:
        if self.min_h > self.max_h or self.min_w > self.max_w or not self.max_h or not self.max_w:
            raise ValueError("crop sizes must be positive and min <= max")

    @property
    def static(self) -> bool:
        return self.min_h == self.max_h and self.min_w == self.max_w

    keeps_static = property(lambda self: self.static)

    def params(self, seed: Column, h: Column, w: Column) -> dict[str, Column]:
        height, width = uniform_between(seed, 0, self.min_h, self.max_h), uniform_between(seed, 0, self.min_w, self.max_w)
        return {"height": height, "width": width, "top": uniform_size(seed, 2, h - height), "left": uniform_size(seed, 3, w - width)}

    def shape(self, p: Column, h: Column, w: Column) -> tuple[Column, Column]:
        return p["height"], p["width"]

    def point(self, x: Column, p: Column, h: Column, w: Column) -> Column:
        return _point(x["r"] - p["top"], x["c"] - p["left"])

    def raster(self, a: np.ndarray, seed: int) -> np.ndarray:
        u = uniform_number(seed, 0)
        h, w = self.min_h + int(u * (self.max_h - self.min_h) // 1), self.min_w + int(u * (self.max_w - self.min_w) // 1)
        if h > a.shape[0] or w > a.shape[1]:
            raise ValueError(f"crop {h}x{w} of a raster {a.shape}")
        top, left = (int(np.floor(uniform_number(seed, k) * (n - 1))) for k, n in ((2, a.shape[0] - h), (3, a.shape[1] - w)))
        top, left = max(top, 0), max(left, 0)
        return a[top : top + h, left : left + w]


@dataclass(frozen=True)
class Pad:
    """Put the raster into a larger one of zeros; ``corner`` names the side that is padded."""

    height: int
    width: int
    corner: str = "bottom_right"

    def __post_init__(self) -> None:
        if self.corner not in ("top_left", "top_right", "bottom_left", "bottom_right"):
            raise ValueError(self.corner)

    static = True
    keeps_static = True

    def params(self, seed: Column, h: Column, w: Column) -> dict[str, Column]:
        return {"top": (F.lit(self.height) - h if "top" in self.corner else F.lit(0)).cast("long"), "left": (F.lit(self.width) - w if "left" in self.corner else F.lit(0)).cast("long")}

    def shape(self, p: Column, h: Column, w: Column) -> tuple[Column, Column]:
        return F.lit(self.height).cast("long"), F.lit(self.width).cast("long")

    def point(self, x: Column, p: Column, h: Column, w: Column) -> Column:
        return _point(x["r"] + p["top"], x["c"] + p["left"])

    def raster(self, a: np.ndarray, seed: int) -> np.ndarray:
        if a.shape[0] > self.height or a.shape[1] > self.width:
            raise ValueError("the raster is larger than the padding")
        out = np.zeros((self.height, self.width, *a.shape[2:]), a.dtype)
        top, left = (self.height - a.shape[0]) * ("top" in self.corner), (self.width - a.shape[1]) * ("left" in self.corner)
        out[top : top + a.shape[0], left : left + a.shape[1]] = a
        return out


def _axis(n: int, m: int) -> np.ndarray:
    """Weights (m by n) of area averaging when shrinking and of linear interpolation when growing."""
    out = np.zeros((m, n))
    if m <= n:
        edge = np.arange(m + 1) * (n / m)
        for k in range(m):
            lo, hi = edge[k], edge[k + 1]
            cells = np.arange(int(lo), min(n, int(np.ceil(hi - 1e-12))))
            out[k, cells] = np.minimum(cells + 1, hi) - np.maximum(cells, lo)
    else:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(int), max(n - 2, 0))
        out[np.arange(m), lo] = 1 - (at - lo)
        if n > 1:
            out[np.arange(m), lo + 1] += at - lo
    return out / out.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Resize:
    """Resample to a fixed size: bytes in linear light (sRGB), floats as they are; three channels."""

    height: int
    width: int
    static = True
    keeps_static = True

    def params(self, seed: Column, h: Column, w: Column) -> dict[str, Column]:
        return {"height": F.lit(self.height).cast("long"), "width": F.lit(self.width).cast("long")}

    def shape(self, p: Column, h: Column, w: Column) -> tuple[Column, Column]:
        return p["height"], p["width"]

    def point(self, x: Column, p: Column, h: Column, w: Column) -> Column:
        return _point(x["r"] * self.height / h, x["c"] * self.width / w)

    def raster(self, a: np.ndarray, seed: int) -> np.ndarray:
        if a.ndim != 3 or a.shape[2] != 3:
            raise ValueError("resizing needs three channels")
        if a.dtype == np.int32:
            raise ValueError("int32 rasters can't be resized")
        x = a.astype(np.float64)
        if a.dtype == np.uint8:
            x /= 255
            x = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
        x = np.einsum("ij,jkc->ikc", _axis(a.shape[0], self.height), x)
        x = np.einsum("ij,kjc->kic", _axis(a.shape[1], self.width), x)
        if a.dtype == np.uint8:
            x = np.where(x <= 0.0031308, x * 12.92, 1.055 * np.maximum(x, 0) ** (1 / 2.4) - 0.055)
            return np.clip(np.round(x * 255), 0, 255).astype(np.uint8)
        return x.astype(np.float32)


class Pipe:
    """A chain of stages. From the last stage with a fixed output shape on, shapes must stay fixed."""

    def __init__(self, *stages):
        if not stages:
            raise ValueError("an empty pipe")
        fixed = [k for k, s in enumerate(stages) if s.static]
        if not fixed:
            raise ValueError("no stage fixes the output shape")
        if not all(s.static or s.keeps_static for s in stages[fixed[-1] :]):
            raise ValueError("a later stage makes the output shape vary")
        self.stages = stages

    @staticmethod
    def _mover(stage, h: Column, w: Column, whole: bool):
        def move(x: Column) -> Column:
            y = stage.point(x, F.col("__p"), h, w)
            return _point(y["r"].cast("int"), y["c"].cast("int")) if whole else y

        return move

    def points(self, df: DataFrame, points: str, seed: Column, h: Column, w: Column, whole: bool = False) -> DataFrame:
        """``points`` (array<struct<r, c>>) moved through all stages, with out_h and out_w; ``whole`` truncates to integers after each stage."""
        df = df.withColumns({"__seed": seed, "out_h": h.cast("long"), "out_w": w.cast("long")})
        for stage in self.stages:
            df = df.withColumn("__p", F.struct(*(c.alias(k) for k, c in stage.params(F.col("__seed"), F.col("out_h"), F.col("out_w")).items())))
            ch, cw = F.col("out_h"), F.col("out_w")
            moved = F.transform(points, self._mover(stage, ch, cw, whole))
            oh, ow = stage.shape(F.col("__p"), ch, cw)
            df = df.withColumns({points: moved, "out_h": oh, "out_w": ow})
        return df.drop("__p", "__seed")

    def rasters(self, df: DataFrame) -> DataFrame:
        """(id, seed, tensor<shape, dtype, data>) with the tensor moved through all stages."""
        stages = self.stages

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.to_pylist()
                for r in rows:
                    t = r["tensor"]
                    if t["dtype"] not in DTYPES:
                        raise ValueError(f"rasters of {t['dtype']} can't be augmented")
                    a = np.frombuffer(t["data"], DTYPES[t["dtype"]]).reshape(t["shape"])
                    for s in stages:
                        a = s.raster(a, r["seed"])
                    r["tensor"] = {"shape": list(a.shape), "dtype": t["dtype"], "data": np.ascontiguousarray(a).tobytes()}
                yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

        return df.select("id", "seed", "tensor").mapInArrow(run, df.select("id", "seed", "tensor").schema)


def ragged(df: DataFrame, points: str, most: int) -> DataFrame:
    """Points padded with zeros to ``most`` rows, and their true number as <points>_len."""
    size = F.least(F.size(points), F.lit(most)).cast("int")
    flat = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(i < size, F.get(F.col(points), i)))
    return df.withColumns({f"{points}_len": size, points: flat})


def orient(a: np.ndarray, orientation: int) -> np.ndarray:
    """A raster turned upright from its EXIF orientation (1 to 8; others stay)."""
    turned = {2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.swapaxes(0, 1), 6: lambda x: np.rot90(x, -1), 7: lambda x: x[::-1, ::-1].swapaxes(0, 1), 8: lambda x: np.rot90(x, 1)}
    return np.ascontiguousarray(turned[orientation](a)) if orientation in turned else a


def lookup(a: np.ndarray, luts: list[np.ndarray]) -> np.ndarray:
    """Each channel through its own table."""
    return np.stack([lut[a[..., k]] for k, lut in enumerate(luts)], axis=-1)


def padded_roi(a: np.ndarray, row: int, col: int, h: int, w: int, pad: int = 10) -> np.ndarray:
    """The box with a margin, clamped to the raster."""
    return a[max(0, row - pad) : min(a.shape[0], row + h + pad), max(0, col - pad) : min(a.shape[1], col + w + pad)]


def sample_grid(grid: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Bilinear values of a (rows, cols, channels) grid at (x, y) in [0, 1]."""
    h, w = grid.shape[:2]
    x, y = np.clip(points[:, 0] * w - 0.5, 0, w - 1), np.clip(points[:, 1] * h - 0.5, 0, h - 1)
    i, j = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    fy, fx = (y - i)[:, None], (x - j)[:, None]
    i1, j1 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    return (grid[i, j] * (1 - fx) + grid[i, j1] * fx) * (1 - fy) + (grid[i1, j] * (1 - fx) + grid[i1, j1] * fx) * fy


def warp(a: np.ndarray, homography: np.ndarray, h: int, w: int) -> np.ndarray:
    """Nearest-pixel warp: the output at (row, col) comes from H^-1 applied to (col, row)."""
    ys, xs = np.mgrid[0:h, 0:w]
    p = np.linalg.inv(homography) @ np.stack([xs.ravel(), ys.ravel(), np.ones(h * w)])
    x, y = np.rint(p[0] / p[2]).astype(int), np.rint(p[1] / p[2]).astype(int)
    ok = (x >= 0) & (x < a.shape[1]) & (y >= 0) & (y < a.shape[0])
    out = np.zeros((h * w, *a.shape[2:]), a.dtype)
    out[ok] = a[y[ok], x[ok]]
    return out.reshape(h, w, *a.shape[2:])
