"""Two EXIF fields of JPEG bytes: focal length and orientation."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

# Tags of TIFF/EXIF directories.
ORIENTATION, EXIF_POINTER, FOCAL_LENGTH = 0x0112, 0x8769, 0x920A
SHORT, LONG, RATIONAL = 3, 4, 5


def _tiff(data: bytes) -> bytes | None:
    """The TIFF block of the first EXIF segment."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xDA or size < 2:
            return None
        body = data[at + 4 : at + 2 + size]
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            return body[6:]
        at += 2 + size
    return None


def _entries(tiff: bytes, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    """tag -> (type, count, the four value bytes) of the directory at an offset."""
    if at + 2 > len(tiff):
        return {}
    (n,) = struct.unpack_from(f"{order}H", tiff, at)
    out = {}
    for k in range(n):
        e = at + 2 + 12 * k
        if e + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack_from(f"{order}HHI", tiff, e)
        out[tag] = (kind, count, tiff[e + 8 : e + 12])
    return out


def _opened(data: bytes | None) -> tuple[bytes, str, dict] | None:
    tiff = _tiff(data or b"")
    if not tiff or len(tiff) < 8 or tiff[:2] not in (b"II", b"MM"):
        return None
    order = "<" if tiff[:2] == b"II" else ">"
    magic, first = struct.unpack_from(f"{order}HI", tiff, 2)
    return (tiff, order, _entries(tiff, order, first)) if magic == 42 else None


def orientation(data: bytes | None) -> int | None:
    """1 to 8, or None."""
    got = _opened(data)
    if not got or ORIENTATION not in got[2]:
        return None
    kind, _, raw = got[2][ORIENTATION]
    value = struct.unpack_from(f"{got[1]}H", raw)[0] if kind == SHORT else 0
    return value if 1 <= value <= 8 else None


def focal_length(data: bytes | None) -> float | None:
    """Millimetres, or None."""
    got = _opened(data)
    if not got:
        return None
    tiff, order, first = got
    held = first
    if EXIF_POINTER in first:
        held = first | _entries(tiff, order, struct.unpack(f"{order}I", first[EXIF_POINTER][2])[0])
    if FOCAL_LENGTH not in held or held[FOCAL_LENGTH][0] != RATIONAL:
        return None
    (at,) = struct.unpack(f"{order}I", held[FOCAL_LENGTH][2])
    if at + 8 > len(tiff):
        return None
    a, b = struct.unpack_from(f"{order}II", tiff, at)
    return a / b if b else None


@F.pandas_udf(IntegerType())
def exif_orientation(content: pd.Series) -> pd.Series:
    return content.map(orientation).astype("Int32")


@F.pandas_udf(DoubleType())
def exif_focal_length(content: pd.Series) -> pd.Series:
    return content.map(focal_length).astype("float64")
