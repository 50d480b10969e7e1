"""Rasters made of vectors, undistorted and averaged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster
from .registry import query


def _tensors(t):
    """Each embedding as a raster of 8 x 8."""
    packed = F.transform("embedding", lambda x: x.cast("double"))

    def tensor(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = [{"shape": [8, 8], "dtype": "float64", "data": np.array(x[:64], float).tobytes()} for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, raster.TENSOR)], ["vec_id", "tensor"])

    return t("embeddings").select("vec_id", packed.alias("x")).mapInArrow(tensor, "vec_id long, tensor struct<shape:array<int>,dtype:string,data:binary>")


def _pixels(df):
    return raster.pixels(df, "tensor", "vec_id").select("vec_id", "row", "col", (F.round("value", 5) + 0.0).alias("value"))


@query(
    """WITH p AS (SELECT r, c, ((c - 3.5::DOUBLE - 0.3::DOUBLE * ((r - 3.25::DOUBLE) / 6.0::DOUBLE)) / 7.0::DOUBLE) AS x, ((r - 3.25::DOUBLE) / 6.0::DOUBLE) AS y FROM range(8) a(r), range(8) b(c)),
q AS (SELECT r, c, 7.0::DOUBLE * x * f + 3.5 AS u, 6.0::DOUBLE * y * f + 3.25 AS v FROM (SELECT *, 1 - 0.2::DOUBLE * (x * x + y * y) + 0.05::DOUBLE * (x * x + y * y) * (x * x + y * y) AS f FROM p)),
w AS (SELECT r, c, CAST(floor(v) AS BIGINT) + i AS sr, CAST(floor(u) AS BIGINT) + j AS sc, (1 - abs(u - (floor(u) + j))) * (1 - abs(v - (floor(v) + i))) AS weight FROM q, range(2) a(i), range(2) b(j))
SELECT vec_id, r AS row, c AS col, round(sum(CASE WHEN sr BETWEEN 0 AND 7 AND sc BETWEEN 0 AND 7 THEN weight * embedding[sr * 8 + sc + 1]::DOUBLE ELSE 0 END), 5) + 0.0 AS value FROM embeddings, w GROUP BY vec_id, r, c"""
)
def raster_undistort(t):
    """Rasters as a camera without radial terms would show them."""
    camera = F.array(*(F.lit(x) for x in (7.0, 6.0, 0.3, 3.5, 3.25, -0.2, 0.05)))
    return _pixels(raster.undistort(_tensors(t), "tensor", camera, (8, 8)))


@query(
    """WITH w AS (SELECT i, j, r, c, greatest(least(r + 1, (i + 1) * 8 / 3.0::DOUBLE) - greatest(r, i * 8 / 3.0::DOUBLE), 0) * greatest(least(c + 1, (j + 1) * 8 / 5.0::DOUBLE) - greatest(c, j * 8 / 5.0::DOUBLE), 0) AS weight FROM range(3) a(i), range(5) b(j), range(8) d(r), range(8) e(c))
SELECT vec_id, i AS row, j AS col, round(sum(weight * embedding[r * 8 + c + 1]::DOUBLE) / (8 / 3.0::DOUBLE * (8 / 5.0::DOUBLE)), 5) + 0.0 AS value FROM embeddings, w WHERE weight > 0 GROUP BY vec_id, i, j"""
)
def raster_area_resize(t):
    """Averages over areas, 8 x 8 to 3 x 5."""
    return _pixels(raster.area_resize(_tensors(t), "tensor", 3, 5))


@query(
    """WITH p AS (SELECT vec_id % 37 * 3 - 20 + c AS x, vec_id % 23 * 5 - 11 + r AS y, embedding[r * 8 + c + 1]::DOUBLE AS v FROM embeddings, range(8) a(r), range(8) b(c))
SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(avg(v), 5) + 0.0 AS value, count(*) AS hits FROM p GROUP BY y, x"""
)
def raster_mosaic(t):
    """Rasters laid on one plane, each at its own place, averaged by pixel."""
    key = F.col("vec_id")
    at = F.array(F.lit(1.0), F.lit(0.0), (key % 37 * 3 - 20).cast("double"), F.lit(0.0), F.lit(1.0), (key % 23 * 5 - 11).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    tiles = raster.mosaic(_tensors(t), "tensor", at, 32)
    place = ["tile_row", "tile_col"]
    means = raster.pixels(tiles, "average", *place).withColumnRenamed("value", "mean")
    hits = raster.pixels(tiles, "hits", *place).where("value > 0").withColumnRenamed("value", "hits")
    both = means.join(hits, [*place, "row", "col"])
    return both.select((F.col("tile_row") * 32 + F.col("row")).alias("y"), (F.col("tile_col") * 32 + F.col("col")).alias("x"), (F.round("mean", 5) + 0.0).alias("value"), F.col("hits").cast("long").alias("hits"))
