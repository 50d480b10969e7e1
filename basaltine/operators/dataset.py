"""Datasets: seeded order, prefix splits, cyclic batches.

The order of entries is a column, never the order of partitions. Global
positions come from a two-level count (rows per hash bucket, then within the
bucket), so no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df with entry_idx from 0 in the order of md5(key | seed), then key.

    The first three hex digits deal 4096 buckets in that order: counts of buckets are summed, rows are numbered within them.
    """
    df = df.withColumn("__h", shuffle_key(F.col(key), seed)).withColumn("__b", F.substring("__h", 1, 3))
    sizes = df.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1
    return df.withColumn("__own", own).join(F.broadcast(before), "__b").withColumn("entry_idx", (F.col("__before") + F.col("__own")).cast("long")).drop("__h", "__b", "__own", "__before")


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df in partitions of about ``rows`` rows, in 10,000 at most, for work that is much for each row of a small table; its rows are counted first."""
    return df.repartition(min(max(1, n_batches(df.count(), rows)), 10_000))


def split_bounds(n: int, train: float, valid: float) -> tuple[int, int]:
    """Ends of the first two parts; errors for shares that aren't positive, exceed one or leave a part empty."""
    if train <= 0 or valid <= 0 or train + valid > 1:
        raise ValueError("shares must be positive and at most one together")
    a, b = int(train * n + 0.5), int(valid * n + 0.5)
    if not a or not b or a + b >= n:
        raise ValueError("a split leaves a part empty")
    return a, a + b


def split(df: DataFrame, n: int, train: float, valid: float) -> DataFrame:
    """df with part: train, valid or test by prefixes of entry_idx."""
    a, b = split_bounds(n, train, valid)
    return df.withColumn("part", F.when(F.col("entry_idx") < a, "train").when(F.col("entry_idx") < b, "valid").otherwise("test"))


def n_batches(n: int, size: int) -> int:
    return -(-n // size)


def ordered_delivery(df: DataFrame, stream: list[str], offset: str, ready: str, prefetch: int) -> DataFrame:
    """df with delivered (when each batch reaches its consumer: once it and all before it are ready) and admitted (when its place opens: once the batch ``prefetch`` before it is delivered; null for the first ones).

    ``waited`` says whether the batch was ready before it was admitted, so that a bounded producer would have held it back. Streams are apart; the order in a stream is that of ``offset``.
    """
    line = Window.partitionBy(*stream).orderBy(offset)
    out = df.withColumn("delivered", F.max(ready).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("admitted", F.lag("delivered", prefetch).over(line))
    return out.withColumn("waited", F.coalesce(F.col(ready) < F.col("admitted"), F.lit(False)))


def cyclic_batches(df: DataFrame, n: int, size: int, first: int, count: int) -> DataFrame:
    """Entries of ``count`` batches from batch ``first`` on: batch_id, start_offset, pos. Element i of the stream is entry i mod n; epochs don't realign it."""
    lo, hi = first * size, (first + count) * size
    start = F.lit(lo) + F.pmod(F.col("entry_idx") - lo, F.lit(n))
    seq = F.when(start < hi, F.sequence(start, F.lit(hi - 1).cast("long"), F.lit(n).cast("long")))
    out = df.withColumn("__i", F.explode(seq))
    b = F.floor(F.col("__i") / size)
    return out.withColumns({"batch_id": b.cast("long"), "start_offset": (b * size).cast("long"), "pos": (F.col("__i") % size).cast("int")}).drop("__i")


class Dataset:
    """Entries with a seeded order; parts and batches of them are new plans over the same rows."""

    def __init__(self, entries: DataFrame, key: str, seed: int = 0, post_process=None):
        self.key, self.seed, self.post_process = key, seed, post_process
        self.entries = entries if "entry_idx" in entries.columns else shuffled(entries, key, seed)
        self._n: int | None = None

    @classmethod
    def from_subdirs(cls, spark, root: str, subdirs: list[str], seed: int = 0, build=None, invalidate: bool = False, post_process=None) -> Dataset:
        """A dataset of files with the same stem in each subdirectory. ``build(spark)`` writes them first if the root is absent or to be rebuilt."""
        from ..sources.files import assembled

        if build is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if invalidate and fs.exists(path):
                fs.delete(path, True)
            if not fs.exists(path):
                build(spark)
        return cls(assembled(spark, root, subdirs), "stem", seed, post_process)

    def __len__(self) -> int:
        if self._n is None:
            self._n = self.entries.count()
        return self._n

    def split_train_validation_test(self, train: float, valid: float) -> tuple[Dataset, Dataset, Dataset]:
        a, b = split_bounds(len(self), train, valid)
        ends = [(0, a), (a, b), (b, len(self))]
        parts = []
        for lo, hi in ends:
            part = self.entries.where(F.col("entry_idx").between(lo, hi - 1)).withColumn("entry_idx", F.col("entry_idx") - lo)
            d = Dataset(part, self.key, self.seed, self.post_process)
            d._n = hi - lo
            parts.append(d)
        return tuple(parts)

    def batches(self, size: int, first: int, count: int) -> DataFrame:
        out = cyclic_batches(self.entries, len(self), size, first, count)
        return out if self.post_process is None else out.transform(self.post_process)


class BatchCursor:
    """An endless batch iterator with a rewind to what was handed out but not delivered."""

    def __init__(self, dataset: Dataset, size: int):
        self.dataset, self.size, self.next_batch, self.open = dataset, size, 0, set()

    def get_next_batch(self) -> DataFrame:
        k = self.next_batch
        self.open.add(k)
        self.next_batch += 1
        return self.dataset.batches(self.size, k, 1)

    def delivered(self, batch: int) -> None:
        self.open.discard(batch)

    def rewind(self) -> int:
        """Back to the first batch in flight."""
        self.next_batch = min(self.open, default=self.next_batch)
        self.open.clear()
        return self.next_batch
