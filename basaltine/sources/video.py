"""Frames of raw video (YUV4MPEG2) as a source that reads wanted frames alone.

    read_frames(spark, "/videos/a.y4m", [3, 70])

A frame's place follows from the header, so frames that are not wanted are neither read nor decoded. The source
also takes over conditions on ``frame`` (=, in, <, <=, >, >=) where ``spark.sql.python.filterPushdown.enabled``
and the option ``pushdown`` are set; Spark 4.1 then keeps a condition for later uses of the same loaded DataFrame, with or without it, so load
anew for each. Partitions are ranges of ``framesPerPartition`` frames (64), so a video of any length is as
many tasks. Files are opened by Arrow's file systems, so a path is local or the URI of a store that those know.

Rows: path, frame (from 0), height, width, bits, and the tensor (rows x columns x 3 in RGB, uint8 or, above 8 bits,
uint16) by the BT.601 formula for studio range, chroma repeated. Sub-sampling: 420, 422, 444 and mono, 8 to 16 bits.
A file with another header, or that ends within a frame, is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, frame long, height int, width int, bits int, tensor struct<shape:array<int>,dtype:string,data:binary>"
#: Chroma samples for each luma sample, down and across.
_CHROMA = {"420": (2, 2), "422": (1, 2), "444": (1, 1), "mono": (0, 0)}


@dataclass(frozen=True)
class Header:
    """What a stream's first line says, and where its frames lie."""

    width: int
    height: int
    chroma: str
    bits: int
    rate: tuple[int, int]
    first: int

    @property
    def chroma_shape(self) -> tuple[int, int]:
        down, across = _CHROMA[self.chroma]
        return (-(-self.height // down), -(-self.width // across)) if down else (0, 0)

    @property
    def frame_bytes(self) -> int:
        h, w = self.chroma_shape
        return (self.height * self.width + 2 * h * w) * (1 if self.bits == 8 else 2)


def parse_header(head: bytes) -> Header:
    line, end, _ = head.partition(b"\n")
    words = line.decode("ascii", "replace").split(" ")
    if words[0] != "YUV4MPEG2" or not end:
        raise ValueError("not a YUV4MPEG2 stream")
    said = {w[0]: w[1:] for w in words[1:] if w}
    kind = re.fullmatch(r"(420|422|444|mono)(?:jpeg|mpeg2|paldv)?(?:p?(9|1[0-6]))?", said.get("C", "420"))
    if kind is None or not said.get("W", "").isdigit() or not said.get("H", "").isdigit():
        raise ValueError(f"a stream of another kind: {line!r}")
    rate = tuple(int(x) for x in said.get("F", "0:1").split(":"))
    return Header(int(said["W"]), int(said["H"]), kind[1], int(kind[2] or 8), rate, len(line) + 1)


def to_rgb(header: Header, raw: bytes) -> np.ndarray:
    """A frame's planes as rows x columns x 3."""
    kind, (h, w), n = (np.uint8 if header.bits == 8 else np.dtype("<u2")), header.chroma_shape, header.height * header.width
    flat = np.frombuffer(raw, kind).astype(np.float64) / (1 << (header.bits - 8))
    y = (flat[:n].reshape(header.height, header.width) - 16) / 219
    rgb = np.repeat(y[:, :, None], 3, axis=2)
    if h:
        down, across = _CHROMA[header.chroma]
        b, r = ((flat[n + k * h * w : n + (k + 1) * h * w].reshape(h, w).repeat(down, 0).repeat(across, 1)[: header.height, : header.width] - 128) / 224 for k in (0, 1))
        rgb += np.stack([1.402 * r, -0.344136 * b - 0.714136 * r, 1.772 * b], axis=2)
    top = (1 << header.bits) - 1
    return np.clip(np.rint(rgb * top), 0, top).astype(np.uint8 if header.bits == 8 else np.uint16)


def _opened(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


@dataclass
class _Range(InputPartition):
    """Frames of one file: their number and first byte."""

    header: Header
    frames: list[int]
    marker: int

    def __post_init__(self):
        self.value = (self.frames[0], self.frames[-1])


class _Reader(DataSourceReader):
    def __init__(self, path: str, per: int, among: set[int] | None):
        self.path, self.per = path, per
        self.lo, self.hi, self.among = 0, None, among

    def wanted(self, n: int) -> list[int] | range:
        hi = n if self.hi is None else min(n, self.hi)
        return range(self.lo, hi) if self.among is None else sorted(k for k in self.among if k is not None and self.lo <= k < hi)

    def partitions(self) -> list[_Range]:
        with _opened(self.path) as f:
            header = parse_header(f.read_at(4096, 0))
            size = f.size() - header.first
            if not size:
                return []
            # Parameters after FRAME are rare; as a stream's frames are of one size, the first one's line is all lines' length.
            marker = f.read_at(4096, header.first).find(b"\n") + 1
        each = marker + header.frame_bytes
        if not marker or size % each:
            raise ValueError(f"{self.path} ends within a frame, or its frames are not alike")
        frames = self.wanted(size // each)
        by: dict[int, list[int]] = {}
        for k in frames:
            by.setdefault(k // self.per, []).append(k)
        return [_Range(header, x, marker) for x in by.values()]

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # no frame is wanted
            return
        h, each = partition.header, partition.marker + partition.header.frame_bytes
        with _opened(self.path) as f:
            for k in partition.frames:
                raw = f.read_at(each, h.first + k * each)
                if raw[:5] != b"FRAME" or raw[partition.marker - 1 : partition.marker] != b"\n":
                    raise ValueError(f"no frame {k} in {self.path}")
                rgb = to_rgb(h, raw[partition.marker :])
                yield (self.path, k, h.height, h.width, h.bits, (list(rgb.shape), str(rgb.dtype), rgb.tobytes()))


class _Filtered(_Reader):
    """The reader that takes over conditions on ``frame``."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("frame",):
                yield f
            elif isinstance(f, EqualTo):
                self.among = {value} if self.among is None else self.among & {value}
            elif isinstance(f, In):
                self.among = set(value) if self.among is None else self.among & set(value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.lo = max(self.lo, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                top = value + isinstance(f, LessThanOrEqual)
                self.hi = top if self.hi is None else min(self.hi, top)
            else:
                yield f


class Frames(DataSource):
    """``y4m_frames``. Options: path, framesPerPartition, frames (a JSON list of those wanted), pushdown (true: see above)."""

    @classmethod
    def name(cls) -> str:
        return "y4m_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        kind = _Filtered if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("framesPerPartition", 64)), set(json.loads(self.options["frames"])) if "frames" in self.options else None)


def read_frames(spark: SparkSession, path: str, frames: Iterable[int] | None = None, per_partition: int = 64):
    """The wanted frames of one video, or all."""
    spark.dataSource.register(Frames)
    reader = spark.read.format("y4m_frames").option("framesPerPartition", per_partition)
    return (reader if frames is None else reader.option("frames", json.dumps(sorted({int(k) for k in frames})))).load(path)


def write_y4m(frames: Iterable[tuple[np.ndarray, ...]], header: Header) -> bytes:
    """A stream of planes, each a tuple of one or three arrays."""
    depth = "" if header.bits == 8 else f"p{header.bits}" if header.chroma != "mono" else str(header.bits)
    head = f"YUV4MPEG2 W{header.width} H{header.height} F{header.rate[0]}:{header.rate[1]} Ip C{header.chroma}{depth}\n".encode()
    kind = np.uint8 if header.bits == 8 else np.dtype("<u2")
    return head + b"".join(b"FRAME\n" + b"".join(np.ascontiguousarray(p, kind).tobytes() for p in planes) for planes in frames)
