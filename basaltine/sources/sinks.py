"""Sinks: compressed tensors, tracks, quoted CSV, labels, reports, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.codec import Options, compress

STATUS_ORDER = {"failed": 0, "error": 1, "skipped": 2, "passed": 3}


def write_compressed(tensors: DataFrame, path: str, options: Options = Options()) -> None:
    """(path, tensor<shape, dtype, data>) as a table (name, content) of compressed files: Parquet, so that a lost task leaves nothing half-written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, contents = [], []
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names.append(p.rsplit("/", 1)[-1] + ".compressed")
                contents.append(compress(np.frombuffer(t["data"], t["dtype"]).reshape(t["shape"]), options))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])

    tensors.select("path", "tensor").mapInArrow(run, "name string, content binary").write.mode("overwrite").parquet(path)


def write_tracks(rows: DataFrame, path: str) -> None:
    """(video, frame, obj_id, row, col, height, width, area, is_occluded) as one JSON object for each video."""
    box = F.struct(F.array("row", "col", "height", "width").alias("bbox"), "area", "is_occluded")
    f = rows.groupBy("video", "frame").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("obj_id", box.alias("d"))))).alias("data"))
    v = f.groupBy("video").agg(F.array_sort(F.collect_list(F.struct(F.col("frame").alias("index")))).alias("order"), F.map_from_entries(F.collect_list(F.struct("frame", "data"))).alias("by"))
    out = v.select("video", F.transform("order", lambda x: F.struct(x["index"].alias("index"), F.element_at("by", x["index"]).alias("data"))).alias("important_frames"))
    out.write.mode("overwrite").json(path)


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, with a header."""
    df.write.mode("overwrite").option("quoteAll", True).option("escape", '"').option("header", True).csv(path)


def write_meta(df: DataFrame, path: str) -> None:
    """A JSON line for each row, nulls kept: descriptions of assets and cameras."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def measured(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and the metrics of its rows as they pass: to be read with ``get`` once df is written. No second pass."""
    seen = Observation(name)
    return df.observe(seen, *metrics), seen


def crop_name(video, frame, obj=None, negative=None):
    """Name of a labelled crop; digits are zero-padded."""
    return F.format_string("%s_%06d_%04d", video, frame, obj) if obj is not None else F.format_string("%s_%06d_neg_%04d", video, frame, negative)


def padded_labels(labels, most: int, width: int = 6):
    """An array of label rows cut or filled with zero rows to ``most``."""
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), width), most)
    return F.slice(F.concat(labels, zero), 1, most)


def report_rows(df: DataFrame, group: str, status: str, name: str) -> DataFrame:
    """Rows in the order of a report: by group, status rank (others last), name."""
    rank = F.create_map(*(F.lit(x) for kv in STATUS_ORDER.items() for x in kv))
    return df.withColumn("rank", F.coalesce(F.element_at(rank, F.col(status)), F.lit(9))).orderBy(group, "rank", name)


def report_markdown(df: DataFrame, group: str, status: str, name: str) -> DataFrame:
    """(group, text): a Markdown list for each group."""
    rank = F.create_map(*(F.lit(x) for kv in STATUS_ORDER.items() for x in kv))
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce(F.element_at(rank, F.col(status)), F.lit(9)).alias("r"), F.col(name).alias("n"), F.col(status).alias("s"))))
    line = lambda x: F.concat(F.lit("- "), x["s"], F.lit(": "), x["n"])
    return df.groupBy(group).agg(F.concat(F.lit("## "), F.first(group), F.lit("\n\n"), F.array_join(F.transform(rows, line), "\n")).alias("text"))


def batches(df: DataFrame, order: list[str]):
    """Arrow batches of a dataset in order, for a consumer in this process."""
    yield from (row for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True))
