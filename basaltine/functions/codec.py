"""Tensor codec: half precision, axis permutation, bit shuffle, zstd, trailer.

A file is the payload, zeros up to a multiple of 16 and a trailer of 104 bytes
that describes it. Search and choice follow the reference semantics: the
permutation with the least size at level 3 wins, the first on ties; of the
codecs the first within the tolerance of the best wins; without codecs the
payload is stored as it is.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# Fixed values of the format.
MAGIC = 0x6E61746976656461
VERSION = 1
FP16, PERMUTED, SHUFFLED = 1, 2, 4
CODECS = {"none": 0, "zstd3": 1, "zstd7": 2, "zstd22": 3}
LEVELS = {1: 3, 2: 7, 3: 22}
TRAILER = struct.Struct("<QH6xQI8II8II4x")
MOST_AXES = 8
SHUFFLE_BYTES, SHUFFLE_LEAST = 8192, 128


def _blocks(n: int, size: int) -> Iterator[tuple[int, int]]:
    step, at = max(SHUFFLE_LEAST, SHUFFLE_BYTES // size // 8 * 8), 0
    while n - at >= 8:
        take = min(step, (n - at) // 8 * 8)
        yield at, take
        at += take


def bit_shuffle(data: bytes, size: int) -> bytes:
    """Bit k of all elements of a block together, for each k; elements beyond a multiple of eight stay."""
    raw, n, out, done = np.frombuffer(data, np.uint8), len(data) // size, [], 0
    for at, take in _blocks(n, size):
        bits = np.unpackbits(raw[at * size : (at + take) * size].reshape(take, size), axis=1, bitorder="little")
        out.append(np.packbits(bits.T, axis=1, bitorder="little").tobytes())
        done = at + take
    return b"".join(out) + data[done * size :]


def bit_unshuffle(data: bytes, size: int) -> bytes:
    raw, n, out, done = np.frombuffer(data, np.uint8), len(data) // size, [], 0
    for at, take in _blocks(n, size):
        bits = np.unpackbits(raw[at * size : (at + take) * size].reshape(8 * size, take // 8), axis=1, bitorder="little")
        out.append(np.packbits(bits.T, axis=1, bitorder="little").tobytes())
        done = at + take
    return b"".join(out) + data[done * size :]


@dataclass(frozen=True)
class Options:
    """What a compressor may do. ``permutations`` are tried in order; ``codecs`` are names in order of preference."""

    half: bool = True
    shuffle: bool = True
    permutations: tuple[tuple[int, ...], ...] = ()
    codecs: tuple[str, ...] = ("zstd7",)
    tolerance: float = 0.0

    def check(self, shape: Sequence[int]) -> None:
        if not 0 < len(shape) <= MOST_AXES or any(d <= 0 for d in shape):
            raise ValueError(f"shape {shape}")
        for p in self.permutations:
            if sorted(p) != list(range(len(shape))):
                raise ValueError(f"permutation {p} of {len(shape)} axes")
        for c in self.codecs:
            if c not in CODECS:
                raise ValueError(f"codec {c}")


def all_permutations(axes: int) -> tuple[tuple[int, ...], ...]:
    return tuple(itertools.permutations(range(axes)))


def _squeezed(data: bytes, codec: int) -> bytes:
    return zstandard.ZstdCompressor(level=LEVELS[codec]).compress(data) if codec else data


def compress(a: np.ndarray, options: Options = Options()) -> bytes:
    """A float32 tensor as the bytes of a compressed file."""
    a = np.ascontiguousarray(a, np.float32)
    options.check(a.shape)
    x = a.astype("<f2") if options.half else a
    size = x.dtype.itemsize

    def laid(p: tuple[int, ...]) -> bytes:
        data = np.ascontiguousarray(x.transpose(p)).tobytes()
        return bit_shuffle(data, size) if options.shuffle else data

    best = tuple(range(a.ndim))
    if options.permutations:
        best = min(options.permutations, key=lambda p: len(_squeezed(laid(p), CODECS["zstd3"])))
    data = laid(best)
    tried = [(CODECS[c], _squeezed(data, CODECS[c])) for c in options.codecs]
    least = min((len(d) for _, d in tried), default=0)
    codec, payload = next(((c, d) for c, d in tried if len(d) - least <= options.tolerance * least), (0, data))
    flags = FP16 * options.half | PERMUTED * bool(options.permutations) | SHUFFLED * options.shuffle
    fill = lambda v: [*v, *[0] * (MOST_AXES - len(v))]
    trailer = TRAILER.pack(MAGIC, VERSION, flags, codec, *fill(a.shape), a.ndim, *fill(best), len(payload))
    return payload + b"\0" * (-len(payload) % 16) + trailer


def header(data: bytes) -> dict:
    """The trailer's fields; ValueError if there is none of this version."""
    if len(data) < TRAILER.size:
        raise ValueError("too short")
    magic, version, flags, codec, *rest = TRAILER.unpack(data[-TRAILER.size :])
    axes = rest[8]
    if magic != MAGIC or version != VERSION or not 0 < axes <= MOST_AXES:
        raise ValueError("not a compressed tensor of this version")
    return {"version": version, "flags": flags, "codec": codec, "shape": rest[:axes], "permutation": rest[9 : 9 + axes], "compressed_size": rest[17]}


def decompress(data: bytes) -> np.ndarray:
    h = header(data)
    kind = np.dtype("<f2" if h["flags"] & FP16 else "<f4")
    p = h["permutation"] if h["flags"] & PERMUTED else list(range(len(h["shape"])))
    laid = [h["shape"][k] for k in p]
    raw = data[: h["compressed_size"]]
    if h["codec"]:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=int(np.prod(laid)) * kind.itemsize)
    if h["flags"] & SHUFFLED:
        raw = bit_unshuffle(raw, kind.itemsize)
    return np.frombuffer(raw, kind).reshape(laid).transpose(np.argsort(p)).astype(np.float32)


def compress_column(df: DataFrame, options: Options = Options(), key: str = "id", column: str = "values") -> DataFrame:
    """(key long, values array<float>) -> (key, payload binary, raw_bytes, packed_bytes), one tensor a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.array(x, np.float32) for x in b.column(1).to_pylist()]
            packed = [compress(r, options) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array([r.nbytes for r in rows], pa.int64()), pa.array([len(p) for p in packed], pa.int64())], [key, "payload", "raw_bytes", "packed_bytes"])

    return df.select(key, column).mapInArrow(run, f"{key} long, payload binary, raw_bytes long, packed_bytes long")


def decompress_column(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, payload) -> (key, shape array<int>, values array<float>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decompress(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(a.shape) for a in got], pa.list_(pa.int32())), pa.array([a.ravel() for a in got], pa.list_(pa.float32()))], [key, "shape", "values"])

    return df.select(key, "payload").mapInArrow(run, f"{key} long, shape array<int>, values array<float>")
