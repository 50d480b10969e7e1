"""Intermediate tables in the shared folder, safe column handling, and a bounded prefilter for joins that would move texts."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the largest prefilter: 32 MB.
MOST_BITS = 1 << 28
#: Bytes of a batch of rows on its way to Python, about; a longer row is a batch of its own.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset in a local session (tests), one of our own."""
    got = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if got is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basaltine-"))
        got = spark.sparkContext.getCheckpointDir()
    return got.rstrip("/")


class Scratch:
    """Parquet tables that cut lineage. A written table survives lost executors; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded_batches(spark)
        self.base = f"{shared_dir(spark)}/basaltine-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, large: bool = False) -> DataFrame:
        """The table as written. Shuffle files go when the driver forgets their plans, which Python's references and the JVM's hold in turn; after large shuffles both are collected twice."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        for _ in range(1 + large):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            if large:
                time.sleep(0.3)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct named ``row``: names of docs can't clash with a plan's own."""
    return F.struct(*(F.col(_quoted(c)).alias(c) for c in docs.columns)).alias("row")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_hash(docs: DataFrame) -> Column:
    """A hash of a row's columns, maps left out."""
    return F.xxhash64(*(F.col(_quoted(c)) for c, kind in docs.dtypes if "map<" not in kind))


def text_hash(column: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def bitmap_size(n: int) -> int:
    """Bits for n keys: at least 16 for each, a power of two, MOST_BITS at most."""
    return min(MOST_BITS, 1 << max(16, (16 * n - 1).bit_length()))


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """The places (column h) as bits of longs."""
    marks = places.selectExpr("shiftright(h, 6) AS w", "shiftleft(1L, cast(h & 63 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[marks["w"].to_numpy()] = marks["b"].to_numpy()
    return held


def prefilter(keys: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test of a long column that holds for all values of keys' only column, and for few others.

    A bitmap of at least 16 bits for each of the n keys, 32 MB at most: beyond that it lets more pass, never less.
    So rows that surely have no partner need not be shuffled; those that pass are joined exactly.
    """
    bits = bitmap_size(n)
    held = bitmap(keys.select(F.pmod(F.xxhash64(F.col(keys.columns[0]), F.lit(3)), F.lit(bits)).alias("h")), bits)

    @F.arrow_udf("boolean")
    def passes(h: pa.Array) -> pa.Array:
        at = h.to_numpy(zero_copy_only=False)
        return pa.array((held[at >> 6] >> (at & 63)) & 1 != 0)

    return lambda key: passes(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(bits)))


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of batches to Python, not only their rows, unless the session has a lower bound: texts may be long, and both sides hold a whole batch."""
    key, most = BATCH
    if not (held := spark.conf.get(key)).isdigit() or int(held) > most:
        spark.conf.set(key, str(most))


def text_of(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, text) alone, null text as empty: other columns, whatever their names, stay out of the way."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
