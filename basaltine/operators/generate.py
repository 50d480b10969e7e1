"""Generated test material: images of fading spots, and sheets of markers as expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .dataset import dealt

#: Largest value of a ten-bit channel.
TOP = 1023


#: Pixels that a task makes, about, and numbers in the largest array of a step.
TASK_PIXELS, CELLS = 2_000_000, 1 << 19


def _ragged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins in what the lists hold together, and how many items it has; -1 for a null."""
    n = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0), n


def _numbers(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _faded(points: pa.Array, height: int, width: int, radius: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the image, y, channels of the row of pixels one after another) for blocks of rows of pixels."""
    first, n = _ragged(points)
    spots = points.flatten()
    fields = dict(zip((f.name for f in spots.type), spots.flatten(), strict=True))  # a null point has null fields
    colors, (at, many) = _numbers(fields["color"].flatten()), _ragged(fields["color"])
    # A channel that a point lacks is unknown, and so is what it is added to.
    color = np.full((len(spots), 3), np.nan)
    for c in range(3):
        color[many > c, c] = colors[at[many > c] + c]
    (cx, cy), x = (_numbers(fields[k]) for k in ("cx", "cy")), np.arange(width)
    blind = fields["cx"].is_null().to_numpy(zero_copy_only=False) | fields["cy"].is_null().to_numpy(zero_copy_only=False)
    step = max(1, CELLS // (3 * width))
    for lo in range(0, len(points) * height, step):
        image, y = np.divmod(np.arange(lo, min(lo + step, len(points) * height)), height)
        total = np.zeros((len(image), width, 3))
        total[n[image] < 0] = np.nan
        # Points in their order: sums of floats hang on it.
        for k in range(int(n[image].max(initial=0))):
            rows = np.flatnonzero(n[image] > k)
            p = first[image[rows]] + k
            far = np.sqrt((x - cx[p, None]) ** 2 + (y[rows] - cy[p])[:, None] ** 2)
            fade = np.maximum(0.0, 1 - far / radius)
            fade[blind[p]] = 0.0
            total[rows] += fade[:, :, None] * color[p, None, :]
        # What is unknown counts as full, and full is turned to nothing.
        value = np.floor(np.fmin(total, float(TOP))).astype(np.int32)
        turned = np.where(value != 0, TOP - value, 0)
        yield image, y, np.where(turned <= least, 0, turned).reshape(len(image), -1)


def radial_fades(df: DataFrame, image: str, points: str, height: int, width: int, radius: float, least: int) -> DataFrame:
    """(image, y, x, channels) of every pixel of each image.

    A point (cx, cy, color) adds its color, fading to nothing at ``radius``; sums are cut at 1023, all but zeros are
    turned round, and what is then at most ``least`` becomes zero. Images are dealt out by their number of pixels; the
    rows of pixels of some images are arrays, made at once, and are taken apart to pixels by Spark.
    """
    own = dealt(df.select(image, points), max(1, TASK_PIXELS // (height * width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for which, y, values in _faded(b.column(1), height, width, radius, least):
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, 3 * width, dtype=np.int32)), pa.array(values.ravel().astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), pa.array(y.astype(np.int32)), rows], [image, "y", "__row"])

    rows = own.mapInArrow(run, StructType([own.schema[image], StructField("y", IntegerType()), StructField("__row", ArrayType(IntegerType()))]))
    pixels = rows.select(image, "y", "__row", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return pixels.select(image, "y", "x", F.array(*(F.get("__row", F.col("x") * 3 + c) for c in range(3))).alias("channels"))


def marker_sheet(df: DataFrame, size_mm: Column, margin_mm: Column, angle: Column, ids: Column, shape: tuple[int, int] = (2, 2), dpi: int = 300) -> DataFrame:
    """Each marker of each sheet with its place: corners (x, y) clockwise from the upper left, in pixels of a portrait sheet.

    Markers stand in a grid of ``shape`` (rows, columns), which gets so much of a border that it can be turned by
    ``angle`` about its middle, and lies at the upper end of a sheet whose sides are as 1 to the root of 2.
    """
    rows, columns = shape
    pixels = lambda mm: (mm.cast("double") * (dpi / 25.4)).cast("long")
    own = df.withColumns({"side": pixels(size_mm), "margin": pixels(margin_mm), "angle": angle.cast("double"), "ids": ids})
    step, margin = F.col("side") + F.col("margin"), F.col("margin")
    length = lambda n: (step * n - margin).cast("double")
    spare = F.ceil(F.sqrt(length(rows) * length(rows) + length(columns) * length(columns)) - length(max(shape)) - 2 * margin)
    own = own.withColumn("border", (spare / F.lit(2)).cast("long"))
    own = own.withColumns({"grid_h": step * rows + margin + 2 * F.col("border"), "grid_w": step * columns + margin + 2 * F.col("border")})
    own = own.withColumn("sheet_w", F.greatest("grid_h", "grid_w"))
    own = own.withColumn("sheet_h", F.round(F.col("sheet_w") * F.lit(math.sqrt(2))).cast("long"))
    each = own.select("*", F.posexplode("ids").alias("place", "marker_id"))
    left = F.col("border") + margin + (F.col("place") % columns) * step
    top = F.col("border") + margin + F.floor(F.col("place") / columns) * step

    def turned(x: Column, y: Column) -> list[Column]:
        x, y, middle = x - F.col("grid_w") / 2, y - F.col("grid_h") / 2, F.col("sheet_w") / 2
        return [F.cos("angle") * x - F.sin("angle") * y + middle, F.sin("angle") * x + F.cos("angle") * y + middle]

    side = F.col("side")
    corners = [turned(left, top), turned(left + side, top), turned(left + side, top + side), turned(left, top + side)]
    return each.select(*df.columns, "marker_id", "sheet_w", "sheet_h", *(v.alias(f"{n}{k}") for k, xy in enumerate(corners) for n, v in zip("xy", xy, strict=True)))
