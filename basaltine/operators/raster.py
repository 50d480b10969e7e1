"""Rasters resampled through a map from output to input: undistortion, homographies, area averages.

Rasters are tensors (shape, dtype, data) of rows x columns (x channels). Each is a row of its own,
resampled by NumPy in Arrow batches; a null stays null. Whole numbers are rounded to the nearest (halves to even).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TENSOR = pa.struct([("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("data", pa.binary())])


def sampled(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples of a at columns x and rows y; what lies outside is 0."""
    h, w = a.shape[:2]
    j, i = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    tail = (1,) * (a.ndim - 2)
    fx, fy = (x - j).reshape(*x.shape, *tail), (y - i).reshape(*y.shape, *tail)

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        ok = (r >= 0) & (r < h) & (c >= 0) & (c < w)
        return np.where(ok.reshape(*ok.shape, *tail), a[np.clip(r, 0, h - 1), np.clip(c, 0, w - 1)], 0).astype(np.float64)

    return (at(i, j) * (1 - fx) + at(i, j + 1) * fx) * (1 - fy) + (at(i + 1, j) * (1 - fx) + at(i + 1, j + 1) * fx) * fy


def like(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    if np.issubdtype(kind, np.integer):
        info = np.iinfo(kind)
        return np.clip(np.rint(values), info.min, info.max).astype(kind)
    return values.astype(kind)


def undistorted(a: np.ndarray, camera: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """a as a camera without radial terms would show it: (fx, fy, skew, px, py, k1, k2) hold for rasters of ``size`` (width, height) and are scaled to a's.

    Each output pixel is a direction by the whole camera matrix; the radial terms move it, and focal lengths and principal
    point alone give the input pixel. A raster of another aspect than ``size`` is an error.
    """
    h, w = a.shape[:2]
    s = w / size[0]
    if s != h / size[1]:
        raise ValueError(f"a camera for {size[0]} x {size[1]} does not fit a raster of {w} x {h}")
    fx, fy, skew, px, py = np.asarray(camera[:5], float) * s
    k1, k2 = camera[5:7]
    v, u = np.mgrid[0:h, 0:w].astype(float)
    y = (v - py) / fy
    x = (u - px - skew * y) / fx
    r = x * x + y * y
    f = 1 + k1 * r + k2 * r * r
    return like(sampled(a, fx * x * f + px, fy * y * f + py), a.dtype)


def projected(a: np.ndarray, homography: np.ndarray, height: int, width: int) -> np.ndarray:
    """a through a 3 x 3 map from input to output pixels, (column, row, 1), bilinear, on a raster of the given size."""
    v, u = np.mgrid[0:height, 0:width].astype(float)
    back = np.linalg.inv(homography)
    x, y, z = (back[k, 0] * u + back[k, 1] * v + back[k, 2] for k in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = np.where(z != 0, x / z, -2.0), np.where(z != 0, y / z, -2.0)
    # Far outside is outside: positions stay whole numbers that fit.
    return like(sampled(a, np.clip(x, -2, a.shape[1] + 1), np.clip(y, -2, a.shape[0] + 1)), a.dtype)


def area_resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Averages over the areas that the output's pixels cover, from summed-area tables: borders within a pixel count in part."""
    out = a.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        size = out.shape[axis]
        sums = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis=axis)], axis=axis)
        at = np.arange(n + 1) * (size / n)
        lo = np.minimum(np.floor(at).astype(int), size - 1)
        part = (at - lo).reshape(-1, *(1,) * (out.ndim - 1 - axis))
        edge = sums.take(lo, axis) * (1 - part) + sums.take(lo + 1, axis) * part
        out = np.diff(edge, axis=axis) * (n / size)
    return like(out, a.dtype)


def birds_eye(a: np.ndarray, homography: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """a through a map whose output is (row, column): resampled to a's own extent, turned, and averaged to ``size`` (height, width)."""
    h, w = a.shape[:2]
    return area_resized(np.swapaxes(projected(a, homography, w, h), 0, 1), *size)


def mapped(df: DataFrame, tensor: str, f: Callable[..., np.ndarray], *given: str | Column, into: str | None = None) -> DataFrame:
    """df with f(raster, values of ``given``) in place of the tensor column (or as column ``into``)."""

    @F.arrow_udf("struct<shape:array<int>,dtype:string,data:binary>")
    def run(t: pa.Array, *rest: pa.Array) -> pa.Array:
        rows = []
        for x, *values in zip(t.to_pylist(), *(c.to_pylist() for c in rest), strict=True):
            if x is None or any(v is None for v in values):
                rows.append(None)
                continue
            got = np.ascontiguousarray(f(np.frombuffer(x["data"], x["dtype"]).reshape(x["shape"]), *values))
            rows.append({"shape": list(got.shape), "dtype": str(got.dtype), "data": got.tobytes()})
        return pa.array(rows, TENSOR)

    return df.withColumn(into or tensor, run(F.col(tensor), *(F.col(c) if isinstance(c, str) else c for c in given)))


def undistort(df: DataFrame, tensor: str, camera: str | Column, size: tuple[int, int]) -> DataFrame:
    """df with its rasters undistorted by each row's camera (an array of seven)."""
    return mapped(df, tensor, lambda a, c: undistorted(a, np.array(c), size), camera)


def warp(df: DataFrame, tensor: str, homography: str | Column, size: tuple[int, int]) -> DataFrame:
    """df with its rasters through each row's homography (nine numbers), turned and averaged to ``size``."""
    return mapped(df, tensor, lambda a, h: birds_eye(a, np.array(h).reshape(3, 3), size), homography)


def area_resize(df: DataFrame, tensor: str, height: int, width: int) -> DataFrame:
    return mapped(df, tensor, lambda a: area_resized(a, height, width))


def pixels(df: DataFrame, tensor: str, *keep: str) -> DataFrame:
    """(keep, row, col, value): the entries of rasters of one channel, a row each, made in Arrow batches."""
    kinds = dict(df.dtypes)
    names = [*keep, "row", "col", "value"]

    def run(batches):
        for b in batches:
            for k, t in enumerate(b.column(len(keep)).to_pylist()):
                if t is not None:
                    a = np.frombuffer(t["data"], t["dtype"]).reshape(t["shape"]).astype(np.float64)
                    r, c = np.indices(a.shape)
                    own = [pa.array([b.column(i)[k].as_py()] * a.size, b.column(i).type) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(r.ravel()), pa.array(c.ravel()), pa.array(a.ravel())], names)

    return df.select(*keep, tensor).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "row long, col long, value double"]))


def mosaic(df: DataFrame, tensor: str, homography: str | Column, tile: int = 64) -> DataFrame:
    """(tile_row, tile_col, average, hits): rasters of one channel, each through its own map (nine numbers) onto one plane, averaged by pixel.

    The plane is cut into tiles of ``tile`` x ``tile`` pixels, any number in either direction. Each raster gives sums for the tiles
    that its outline's box touches; those are added up tile by tile, partial in each task, so neither the plane nor a
    tile's rasters are ever gathered. A pixel takes a raster's bilinear value where it falls within the raster; ``hits`` says how many
    did, and ``average`` is NaN where none did. Nulls are left out.
    """

    def parts(a: np.ndarray, h: np.ndarray):
        height, width = a.shape
        corners = h @ np.array([[0, width - 1, width - 1, 0], [0, 0, height - 1, height - 1], [1, 1, 1, 1]], float)
        x, y = corners[0] / corners[2], corners[1] / corners[2]
        back = np.linalg.inv(h)
        for i in range(int(np.floor(y.min())) // tile, int(np.ceil(y.max())) // tile + 1):
            for j in range(int(np.floor(x.min())) // tile, int(np.ceil(x.max())) // tile + 1):
                v, u = np.mgrid[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].astype(float)
                z = back[2, 0] * u + back[2, 1] * v + back[2, 2]
                p, q = (back[0, 0] * u + back[0, 1] * v + back[0, 2]) / z, (back[1, 0] * u + back[1, 1] * v + back[1, 2]) / z
                # A hair's width of rounding is no reason to lose a border.
                ok = (p >= -1e-9) & (p <= width - 1 + 1e-9) & (q >= -1e-9) & (q <= height - 1 + 1e-9)
                if ok.any():
                    p, q = np.clip(p, 0, width - 1), np.clip(q, 0, height - 1)
                    yield i, j, np.concatenate([np.where(ok, sampled(a, p, q), 0.0).ravel(), ok.ravel()])

    def run(batches):
        for b in batches:
            for x, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x is not None and h is not None:
                    a = np.frombuffer(x["data"], x["dtype"]).reshape(x["shape"]).astype(np.float64)
                    for i, j, sums in parts(a, np.array(h, float).reshape(3, 3)):
                        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([sums])], ["tile_row", "tile_col", "sums"])

    def averaged(batches):
        for b in batches:
            rows = [np.array(s).reshape(2, tile, tile) for s in b.column(2).to_pylist()]
            with np.errstate(invalid="ignore"):
                means = [s[0] / s[1] for s in rows]
            made = [[{"shape": [tile, tile], "dtype": str(m.dtype), "data": m.tobytes()} for m in part] for part in (means, [s[1].astype(np.int64) for s in rows])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(m, TENSOR) for m in made)], ["tile_row", "tile_col", "average", "hits"])

    out = "struct<shape:array<int>,dtype:string,data:binary>"
    parts_of = df.select(tensor, (F.col(homography) if isinstance(homography, str) else homography).alias("__h")).mapInArrow(run, "tile_row long, tile_col long, sums array<double>")
    sums = parts_of.groupBy("tile_row", "tile_col").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("sums"))
    return sums.mapInArrow(averaged, f"tile_row long, tile_col long, average {out}, hits {out}")
