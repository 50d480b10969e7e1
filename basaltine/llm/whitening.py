"""Embedding whitening by a randomised range finder.

Vectors are put on a grid: x = floor(64 * c) + 1,000,000 for each entry c. Their number
and the sums of x and of its square are exact whole numbers. All products are over
centred rows, (n * x - S) / n, whose numerator is exact.

Components are found in passes over all centred rows, X: each task multiplies its rows
with an orthonormal basis of a few more columns than there are components
(``EXTRA``), X'(X Q) is added up by entry, at most dimension times columns of
them, and the sum's basis goes into the next pass. Rayleigh-Ritz of the last pass
gives eigenvalues, eigenvectors and residuals. If after ``PASSES`` passes a
residual is above ``TOLERANCE`` times the largest eigenvalue, or is falling too slowly to
get there, the basis is extended to the full dimension: one more pass then gives
the whole covariance in it, and its eigenvectors to double precision.

Only sums of bounded size reach the driver: dimension times dimension at most.
Rows are written with all their components, and the covariance of what was
written, less the identity, is measured in a pass of its own.

Rows whose vector is null, or holds null or a non-finite entry, are left out. Rows
that repeat a vec_id, or have none, are rows of their own. A component without
variance (fewer rows than dimensions, or equal rows) has ``whitened`` null and counts
not for the identity; without any variance ``explained`` and the error are null.
Vectors without entries, and an empty table, give no row. Vectors of unlike
lengths, and entries so large that exact sums do not fit a long, are an error. Columns beside
vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches

GRID, SHIFT = 64, 1_000_000
COMPONENTS, EXTRA, PASSES, TOLERANCE, SEED = 32, 16, 6, 1e-13, 12
#: Rows multiplied at once.
BLOCK = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows whose entries are all there and finite."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.where(F.col("embedding").isNotNull() & finite)


def _grid(column: pa.Array, wide: int) -> Iterator[np.ndarray]:
    """x - SHIFT of blocks of rows, as whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * wide:
        raise ValueError(f"vectors of unlike lengths: {len(flat)} entries in {len(column)} rows of {wide}")
    c = np.floor(flat * GRID)
    if len(c) and np.abs(c).max() > 2.0**52:
        raise OverflowError("an entry is too large for exact sums")
    x = c.astype(np.int64).reshape(len(column), wide)
    for i in range(0, len(x), BLOCK):
        yield x[i : i + BLOCK]


@dataclass
class Fit:
    """Number of rows, exact sums of x - SHIFT, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    trace: float

    def residues(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if len(x) and self.n * float(np.abs(x).max()) + float(np.abs(self.sums).max()) > 2.0**62:
            raise OverflowError("exact residues do not fit a long")
        return self.n * x - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.residues(x) / float(self.n)


def _sums(column: str, kind: str = "double") -> Callable:
    """Adds up what tasks yield as flat arrays in batches of (place, value)."""

    def added(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int) -> np.ndarray:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for flat in run(batches):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])

        got = rows.select(column).mapInArrow(each, f"place long, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(size, np.int64 if kind == "long" else np.float64)
        out[got["place"].to_numpy()] = got["value"].to_numpy()
        return out

    return added


def fitted(rows: DataFrame, wide: int) -> Fit:
    """Exact sums over all rows; a sum beyond a long is an error, not a wrong number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        n, s, q, size = 0, np.zeros(wide, np.int64), np.zeros(wide, np.int64), 0.0
        for b in batches:
            for x in _grid(b.column(0), wide):
                size += float((x.astype(np.float64) ** 2).sum(axis=0).max(initial=0.0))
                if size > 2.0**62:
                    raise OverflowError("sums of squares do not fit a long")
                n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        yield np.concatenate([[n], s, q])

    got = _sums("embedding", "long")(rows, run, 1 + 2 * wide).tolist()
    n, s, q = got[0], got[1 : 1 + wide], got[1 + wide :]
    return Fit(n, np.array(s, np.int64), sum(n * b - a * a for a, b in zip(s, q, strict=True)) / float(n) ** 2)


def _product(rows: DataFrame, fit: Fit, basis: np.ndarray) -> np.ndarray:
    """The covariance times the basis: one pass over all centred rows."""
    wide, k = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros((wide, k))
        for b in batches:
            for x in _grid(b.column(0), wide):
                c = fit.centred(x)
                total += c.T @ (c @ basis)
        yield total.ravel()

    return _sums("embedding")(rows, run, wide * k).reshape(wide, k) / fit.n


def components(rows: DataFrame, fit: Fit, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of the covariance, at most ``most``."""
    wide = len(fit.sums)
    most = min(most, wide)

    def ritz(basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        y = _product(rows, fit, basis)
        h = basis.T @ y
        e, w = np.linalg.eigh((h + h.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        left = np.linalg.norm(y @ w[:, :most] - basis @ (w[:, :most] * e[:most]), axis=0)
        return e[:most], (basis @ w)[:, :most], y, float(left.max() / max(e[0], 1e-300))

    random = np.random.default_rng(SEED)
    columns = min(wide, most + EXTRA)
    if columns < wide:
        basis, before = np.linalg.qr(_product(rows, fit, np.linalg.qr(random.standard_normal((wide, columns)))[0]))[0], np.inf
        for k in range(PASSES):
            e, vectors, y, left = ritz(basis)
            if left <= TOLERANCE:
                return e, vectors
            # At this rate the passes that are left do not reach the tolerance.
            if k and left * (left / before) ** (PASSES - 1 - k) > TOLERANCE:
                break
            basis, before = np.linalg.qr(y)[0], left
    else:
        basis = np.zeros((wide, 0))
    more = random.standard_normal((wide, wide - basis.shape[1]))
    e, vectors, _, _ = ritz(np.linalg.qr(np.concatenate([basis, more], axis=1))[0])
    return e, vectors


def _identity_error(written: DataFrame, held: int) -> float | None:
    """The largest entry of the covariance of the first ``held`` components, less the identity. Means first, so that rows are centred before they are multiplied."""
    if not held:
        return None

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            z = b.column(0).flatten().to_numpy(zero_copy_only=False)
            yield z.reshape(b.num_rows, -1)[:, :held]

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        yield sum((np.append(z.sum(axis=0), len(z)) for z in blocks(batches)), np.zeros(held + 1))

    first = _sums("whitened")(written, mean, held + 1)
    n, at = first[held], first[:held] / first[held]

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        yield sum(((z - at).T @ (z - at) for z in blocks(batches)), np.zeros((held, held))).ravel()

    c = _sums("whitened")(written, square, held * held).reshape(held, held) / n
    return float(np.abs(c - np.eye(held)).max())


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation (sum of (n * x - S)^2), whitened, explained and identity_error: a row for each usable vector and component."""
    scratch = Scratch(vectors.sparkSession)
    bounded_batches(vectors.sparkSession)
    rows = usable(vectors)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    one = rows.select(F.size("embedding").alias("wide")).first()
    if one is None or not one.wide:
        # An empty vector beside others is found when they are read.
        if one is None or rows.where(F.size("embedding") > 0).isEmpty():
            return vectors.sparkSession.createDataFrame([], schema)
        raise ValueError("vectors of unlike lengths")
    wide = one.wide
    fit = fitted(rows, wide)
    e, axes = components(rows, fit, most)
    held = int((e > max(float(e[0]), 0.0) * wide * np.finfo(float).eps).sum()) if fit.trace > 0 else 0
    scaled = axes[:, :held] / np.sqrt(e[:held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = b.column(0), 0
            for x in _grid(b.column(1), wide):
                r = fit.residues(x)
                if (r.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0) > 2.0**63 * 0.999:
                    raise OverflowError("a deviation does not fit a long")
                z = (r / float(fit.n)) @ scaled
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * held)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(x)), pa.array((r * r).sum(axis=1)), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], ["vec_id", "deviation", "whitened"])
                at += len(x)

    written = scratch.write(rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>"), "whitened")
    error = _identity_error(written, held)
    shares = [float(x) / fit.trace if fit.trace > 0 else None for x in np.maximum(e, 0.0)]
    each = F.explode(F.sequence(F.lit(1), F.lit(len(e)))).alias("component")
    out = written.select("vec_id", "deviation", "whitened", each)
    share = F.element_at(F.array(*(F.lit(x).cast("double") for x in shares)), F.col("component"))
    return out.select(
        "vec_id", "component", F.lit(fit.n).cast("long").alias("n"), "deviation", F.get("whitened", F.col("component") - 1).alias("whitened"), share.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
