"""Column functions: strings, arrays, maps, JSON, maths, times. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)


def splitext(path: Column) -> tuple[Column, Column]:
    """Name without its extension, and the extension with its dot."""
    return F.regexp_replace(path, r"\.[^./]*$", ""), F.regexp_extract(path, r"(\.[^./]*)$", 1)


def random_id(seed: Column) -> Column:
    """32 hex digits that depend on the seed alone."""
    return F.md5(seed.cast("string"))


def fill(template: Column, value: Column, mark: str = "{n}") -> Column:
    return F.replace(template, F.lit(mark), value.cast("string"))


def prefix_rest(path: Column) -> tuple[Column, Column]:
    """The part before the first slash and the part after it; no slash: all and ''."""
    parts = F.split(path, "/", 2)
    return parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_hours(now: Column, ts: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(ts)) / 3600.0


def align_up(x: Column, a: int) -> Column:
    """The next multiple of a power of two."""
    if a <= 0 or a & (a - 1):
        raise ValueError(f"{a} is no power of two")
    return (x + (a - 1)).bitwiseAND(~(a - 1))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(x, F.lit(hi)))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def fourier(x: Column, octaves: int = 7) -> Column:
    """sin and cos of pi * 2**k * x for each octave, sines first."""
    k = F.sequence(F.lit(0), F.lit(octaves - 1))
    angle = lambda i: math.pi * F.pow(F.lit(2.0), i) * x
    return F.concat(F.transform(k, lambda i: F.sin(angle(i))), F.transform(k, lambda i: F.cos(angle(i))))


def pad_truncate(xs: Column, k: int, zero: Column | None = None) -> Column:
    """The first k values, zeros if there are fewer."""
    return F.slice(F.concat(xs, F.array_repeat(F.lit(0.0) if zero is None else zero, k)), 1, k)


def mask_after(xs: Column, count: Column, fill_with: float) -> Column:
    """Values from position count on replaced."""
    return F.transform(xs, lambda x, i: F.when(i < count, x).otherwise(F.lit(fill_with)))


def gather(xs: Column, at: Column) -> Column:
    """xs at positions from 0; null outside."""
    return F.transform(at, lambda i: F.get(xs, i))


def linspace(lo: float, hi: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(lo) + (hi - lo) * i / float(max(n - 1, 1)))


def argsort(xs: Column) -> Column:
    """Positions from 0 in ascending order of value, then position."""
    pairs = F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def argmin(xs: Column) -> Column:
    return F.array_position(xs, F.array_min(xs)) - 1


def argmax_by_length(ids: Column, sizes: Column) -> Column:
    """Aggregate: the id with the greatest size, the smallest of equals."""
    return F.max_by(ids, F.struct(sizes, -ids))


def last_n(xs: Column, n: int) -> Column:
    return F.slice(xs, F.greatest(F.size(xs) - n + 1, F.lit(1)), n)


def integer_keys(m: Column) -> Column:
    """A map's string keys as integers; others are dropped."""
    return F.transform_keys(F.map_filter(m, lambda k, v: k.rlike("^-?[0-9]+$")), lambda k, v: k.cast("int"))


def merged_maps(*maps: Column) -> Column:
    """Maps joined; of equal keys the later map's value."""
    def over(first: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(later, k)), later)

    out = maps[0]
    for m in maps[1:]:
        out = over(out, m)
    return out


def json_field(text: Column, path: str, default: Column) -> Column:
    return F.coalesce(F.get_json_object(text, path), default)


def problem(key: str, **params: Column) -> Column:
    """An error key with its parameters."""
    return F.struct(F.lit(key).alias("error_key"), F.struct(*(c.cast("string").alias(k) for k, c in params.items())).alias("params"))


def uint_at(content: Column, offset: int, size: int, big: bool = True) -> Column:
    """An unsigned integer of two or four bytes of a binary."""
    digits = F.hex(F.substring(content, offset + 1, size))
    if not big:
        digits = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.conv(digits, 16, 10).cast("long")


def label_slices(packed: Column) -> tuple[Column, Column, Column]:
    """(box of four values, presence, class) of a packed label of six."""
    return F.slice(packed, 1, 4), F.get(packed, F.lit(4)), F.get(packed, F.lit(5))


def target_bins(x: Column, bins: int) -> dict[str, Column]:
    """A value in [0, 1] as a bin and the fraction within it."""
    s = clip(x, 0.0, 1.0) * (bins - 1)
    b = F.least(F.floor(s), F.lit(bins - 2)).cast("int")
    return {"bin": b, "fraction": s - b}
