"""Ordered series: differences, sampling, smoothing, prefix and range minima, cut-offs, partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_difference(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """value less the one before it in its series; null at the start."""
    return df.withColumn("diff", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def frame_difference(a: str, b: str, pixels: int) -> Column:
    """Sum of absolute differences over pixels * 255; with three channels at most 3."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / (pixels * 255.0)


def sampled_rows(values: np.ndarray, threshold: float) -> list[int]:
    """Positions that differ from the last kept one by more than the threshold; the first is kept."""
    kept: list[int] = []
    for i, v in enumerate(values):
        if not kept or abs(v - values[kept[-1]]) > threshold:
            kept.append(i)
    return kept


def delta_sample(df: DataFrame, key: str, order: list[str], value: str, threshold: float, chunk: int = 200_000) -> DataFrame:
    """Rows that differ from the last kept row of their series by more than the threshold.

    The reference value is reset by each kept row, which no window expresses. Series are sorted within partitions and
    streamed through: state is one number per series, so a long series needs no memory of its own.
    """
    names = df.columns
    at_key, at_value = names.index(key), names.index(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = object(), 0.0
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (k, v) in enumerate(zip(pdf.iloc[:, at_key], pdf.iloc[:, at_value], strict=True)):
                if k != current or abs(v - last) > threshold:
                    current, last, keep[i] = k, v, True
            yield pdf[keep]

    return df.where(F.col(value).isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, df.schema)


def edge_mean(df: DataFrame, key: str, order: str, value: str, radius: int = 8) -> DataFrame:
    """Moving average with repeated edges: n values give n + 2, output i (from 0) is the mean of values clamp(i - radius .. i + radius - 2).

    order must be the row's position from 0 within its series. One window each gives sums over the part inside the series,
    and the edges add their value as often as the range sticks out.
    """
    w = Window.partitionBy(key).orderBy(order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(Window.partitionBy(key))
    df = df.select(key, order, value, n.alias("__n"), F.first(value).over(every).alias("__a"), F.last(value).over(every).alias("__z"))
    # Output n and n + 1 lie beyond the last row: the last row makes three outputs.
    tail = F.when(F.col(order) == F.col("__n") - 1, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    inside = [F.sum(value).over(w.rowsBetween(-radius + s, radius - 2 + s)) for s in (0, 1, 2)]
    count = [F.count("*").over(w.rowsBetween(-radius + s, radius - 2 + s)) for s in (0, 1, 2)]
    df = df.withColumns({f"__s{s}": F.coalesce(inside[s], F.lit(0)) for s in range(3)} | {f"__c{s}": count[s] for s in range(3)})
    df = df.withColumn("__shift", F.explode(tail))
    pick = lambda p: F.element_at(F.array(*(F.col(f"__{p}{s}") for s in range(3))), F.col("__shift") + 1)
    at = F.col(order) + F.col("__shift")
    low = F.greatest(F.lit(0), radius - at)
    low = F.least(low, F.lit(2 * radius - 1))
    high = F.lit(2 * radius - 1) - low - pick("c")
    return df.select(key, at.cast("long").alias("idx"), ((pick("s") + low * F.col("__a") + high * F.col("__z")) / (2 * radius - 1)).alias("mean"))


def prefix_min(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return df.withColumn("prefix_min", F.min(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def range_min(df: DataFrame, key: str, order: str, value: str, share: float = 0.08) -> DataFrame:
    """(key, i, k, low): least of values i - k .. i, for k below c = round(share * n); 0 where k > i.

    One row makes c outputs; the trailing values come along in one bounded window rather than by a self join.
    """
    w = Window.partitionBy(key).orderBy(order)
    n = F.count("*").over(Window.partitionBy(key))
    df = df.select(key, F.col(order).alias("i"), value, F.bround(share * n, 0).cast("int").alias("__c"))
    most = df.agg(F.max("__c")).first()[0] or 0
    if not most:
        return df.select(key, "i", F.lit(0).alias("k"), F.col(value).alias("low")).where("false")
    df = df.withColumn("__back", F.reverse(F.collect_list(value).over(w.rowsBetween(-(most - 1), 0))))
    cells = F.transform(F.sequence(F.lit(0), F.col("__c") - 1), lambda k: F.struct(k.alias("k"), F.when(k <= F.col("i"), F.array_min(F.slice("__back", 1, k + 1))).otherwise(F.lit(0)).alias("low")))
    return df.where("__c > 0").select(key, "i", F.inline(cells))


def range_max(df: DataFrame, key: str, order: str, value: str, back: int) -> DataFrame:
    return df.withColumn("range_max", F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-back, 0)))


def best_so_far(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """improved: whether value is below all before it."""
    before = F.min(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("improved", before.isNull() | (F.col(value) < before))


def running_cutoff(df: DataFrame, key: str, order: list[str], stop: Column) -> DataFrame:
    """Rows up to and with the first where the running condition holds."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("__stop", stop.cast("int"))
    return df.withColumn("__seen", F.coalesce(F.max("__stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("__seen = 0").drop("__stop", "__seen")


def neighbours(df: DataFrame, key: str, order: str, last: Column) -> DataFrame:
    """The frame before and after each, with 0 and the last frame at the ends."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({"prev": F.lag(order, 1, 0).over(w), "next": F.coalesce(F.lead(order).over(w), last)})


def interpolated(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Null values filled linearly between the known ones, flat beyond them."""
    w = Window.partitionBy(key).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    a, b = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"__a": a, "__b": b})
    part = (F.col(order) - F.col("__a.t")) / F.nullif(F.col("__b.t") - F.col("__a.t"), F.lit(0))
    return df.withColumn("filled", F.coalesce(F.col("__a.v") + part * (F.col("__b.v") - F.col("__a.v")), F.col("__a.v"), F.col("__b.v"))).drop("__a", "__b")


def _cheapest_starts(before: np.ndarray, errors: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each end b the least of before[a] + min(errors[a:b]) over starts a <= b - least, and the first such a.

    Starts with the same minimum so far are one entry of a stack whose minima rise; an error merges the entries above it.
    So each start is pushed and merged once: time and memory grow with the series, not with its square.
    """
    n, inf = len(errors), float("inf")
    cost, start = np.full(n + 1, inf), np.zeros(n + 1, int)
    recent = errors if least == 1 else np.lib.stride_tricks.sliding_window_view(errors, least).min(axis=1)
    stack: list[tuple[float, tuple[float, int], tuple[float, int]]] = []  # minimum, cheapest start, best sum up to here
    for b in range(least, n + 1):
        e, a = float(errors[b - 1]), b - least
        held = None
        while stack and stack[-1][0] >= e:
            held = min(held or stack[-1][1], stack.pop()[1])
        for low, own in ((e, held), (float(recent[a]), (float(before[a]), a))):
            if own is not None:
                total = (own[0] + low, own[1])
                stack.append((low, own, min(total, stack[-1][2]) if stack else total))
        cost[b], start[b] = stack[-1][2]
    return cost, start


def best_partition(errors: np.ndarray, least_share: float = 0.15, most_parts: int = 6, ratio: float = 3.0) -> list[int]:
    """Track positions of a series of frame errors.

    For k parts of at least ``least_share`` of the frames each (rounded, halves to even), the cut that minimises the sum of
    the parts' least errors is found by dynamic programming; the largest k whose worst part is at most ``ratio`` times the
    mean one wins. A part is represented by its frame of least error. An empty series has none.
    """
    n = len(errors)
    if not n:
        return []
    least = max(1, round(least_share * n))
    best: list[int] = [int(np.argmin(errors))]
    cost, backs = np.full(n + 1, float("inf")), []
    cost[0] = 0
    for k in range(1, most_parts + 1):
        cost, back = _cheapest_starts(cost, errors, least)
        backs.append(back)
        if cost[n] == float("inf"):
            break
        picks, b = [], n
        for j in range(k - 1, -1, -1):
            a = int(backs[j][b])
            picks.append(a + int(np.argmin(errors[a:b])))
            b = a
        picks.reverse()
        chosen = errors[picks]
        if chosen.max() <= ratio * max(chosen.mean(), 1e-12):
            best = picks
    return best


def track_frames(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, frame) of the best partition of each series; a series is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        at = best_partition(pdf[value].to_numpy(float))
        return pdf.iloc[at][[key, order]].rename(columns={order: "frame"})

    kinds = dict(df.dtypes)
    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, frame {kinds[order]}")


def histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """(bin from 0, n) of values in [lo, hi]; the last bin holds its right edge."""
    at = F.when(F.col(value) == hi, F.lit(bins - 1)).otherwise(F.floor((F.col(value) - lo) / ((hi - lo) / bins)).cast("int"))
    return df.where(F.col(value).between(lo, hi)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def collisions(df: DataFrame, level: str, n: str) -> DataFrame:
    """For each output level, the values that share it with its most frequent one: sum - max."""
    return df.groupBy(level).agg((F.sum(n) - F.max(n)).alias("collisions"))


def best_lut(hist: np.ndarray, levels: int = 256) -> np.ndarray:
    """A monotone table from values to levels with the fewest collisions.

    Each level takes a run of neighbouring values and loses all of them but the most frequent. Dynamic programming over
    (levels used, values covered), runs no longer than twice the mean.
    """
    n = len(hist)
    band = max(1, -(-n // levels) * 2)
    sums = np.concatenate([[0], np.cumsum(hist)])
    cost = np.full((levels + 1, n + 1), np.inf)
    back = np.zeros((levels + 1, n + 1), np.int32)
    cost[0, 0] = 0
    for k in range(1, levels + 1):
        top = np.zeros(n + 1)
        for width in range(1, min(band, n) + 1):
            top[width:] = np.maximum(top[width:], hist[: n + 1 - width] if width <= n else 0)
            c = cost[k - 1, : n + 1 - width] + (sums[width:] - sums[: n + 1 - width]) - top[width:]
            better = c < cost[k, width:]
            cost[k, width:][better] = c[better]
            back[k, width:][better] = width
    used = int(np.argmin(cost[:, n]))
    out, b = np.zeros(n, np.int64), n
    for k in range(used, 0, -1):
        a = b - int(back[k, b])
        out[a:b] = k - 1
        b = a
    return out


def banded_lut(hist: np.ndarray, levels: int = 256, band: int = 65) -> np.ndarray:
    """The monotone table from values to levels with the fewest collisions that stays near the straight line.

    Values 0 .. n-1 go to levels 0 .. levels-1, the next value to the same level or the next one, and no value x further than
    ``band`` from round(levels * x / n). A level costs all that falls on it but its most frequent value. Exact dynamic
    programming over (level, last value of its run); runs of all lengths that the band allows.
    """
    hist = np.asarray(hist, np.int64)
    n = len(hist)
    if n < levels:
        raise ValueError("fewer values than levels")
    line = np.rint(levels * np.arange(n) / n)
    sums = np.concatenate([[0], np.cumsum(hist)])
    far = np.iinfo(np.int64).max // 4
    before = np.full(n + 1, far)
    before[0] = 0
    starts = np.zeros((levels, n), np.int32)
    for y in range(levels):
        inside = np.flatnonzero(np.abs(y - line) <= band)
        now = np.full(n + 1, far)
        if len(inside):
            lo, hi = int(inside[0]), int(inside[-1]) + 1
            most = np.zeros(hi - lo, np.int64)
            for width in range(1, hi - lo + 1):
                # Runs of this width that begin at lo, lo + 1, ...
                top = most[: hi - lo - width + 1] = np.maximum(most[: hi - lo - width + 1], hist[lo + width - 1 : hi])
                a = np.arange(lo, hi - width + 1)
                cost = before[a] + sums[a + width] - sums[a] - top
                better = cost < now[a + width]
                now[a[better] + width] = cost[better]
                starts[y, a[better] + width - 1] = a[better]
        before = now
    if before[n] >= far:
        raise ValueError("no table within the band")
    out, end = np.zeros(n, np.int64), n
    for y in range(levels - 1, -1, -1):
        a = int(starts[y, end - 1])
        out[a:end] = y
        end = a
    return out


def lookup_tables(df: DataFrame, keys: list[str], value: str, values: int = 1024, levels: int = 256, band: int = 65) -> DataFrame:
    """(keys, collisions, lut): a banded table for each group of values in 0 .. values-1, from histograms summed in Spark; others and nulls are not counted."""
    counted = df.where(F.col(value).between(0, values - 1)).groupBy(*keys, F.col(value).cast("int").alias("__v")).agg(F.count("*").alias("__n"))
    # One entry for each value at most.
    hists = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__v", "__n"))).alias("__h"))

    @F.arrow_udf("struct<collisions: bigint, lut: array<int>>")
    def table(h: pa.Array) -> pa.Array:
        rows = []
        for entries in h.to_pylist():
            hist = np.zeros(values, np.int64)
            for v, n in entries:
                hist[v] = n
            lut = banded_lut(hist, levels, band)
            top = np.zeros(levels, np.int64)
            np.maximum.at(top, lut, hist)
            rows.append({"collisions": int(hist.sum() - top.sum()), "lut": lut.tolist()})
        return pa.array(rows, pa.struct([("collisions", pa.int64()), ("lut", pa.list_(pa.int32()))]))

    return hists.withColumn("__t", table("__h")).select(*keys, "__t.collisions", "__t.lut")
