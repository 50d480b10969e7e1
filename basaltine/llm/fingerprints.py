"""Document fingerprints: one-permutation MinHash, densified, b low bits.

Each 5-word shingle is hashed once; the hash's top bits choose one of ``BINS``
bins and each bin keeps its least hash. An empty bin i copies the first
non-empty one in an order of bins that belongs to i (optimal densification: the
choice depends on i alone, never on its neighbours), and ``BITS`` low bits of
each bin are packed. Two fingerprints agree in a bin by chance once in 2**BITS;
``likeness`` takes that out and clamps to 0..1.

A text of fewer words has its whole sequence as one shingle. Empty, blank or
null text has the empty set: its fingerprint is all zero digits with a leading
``-``, like itself (1.0) and unlike all else (0.0). Rows that repeat a doc_id
are rows of their own; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import text_of
from .tokens import U64, Words, chunks, give_back, mix, sha256_hex

BINS, BITS, SHINGLE = 512, 4, 5
ROUNDS = 24
BLOCK_CHARS = 32_000_000
_LEAST_ID = -(1 << 63)
_EMPTY = ~U64(0)
_orders: list[np.ndarray] = []


def _order() -> tuple[np.ndarray, np.ndarray]:
    """For each bin, the other bins in its own order, and each bin's place in it."""
    if not _orders:
        with np.errstate(over="ignore"):
            keys = mix(np.arange(1, BINS * BINS + 1, dtype=U64) * U64(0xD1342543DE82EF95)).reshape(BINS, BINS)
        order = np.argsort(keys, axis=1, kind="stable")
        _orders.extend([order, np.argsort(order, axis=1, kind="stable")])
    return _orders[0], _orders[1]


def sketches(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(texts by BINS of BITS low bits, whether the text has shingles)."""
    rows = len(offs) - 1
    text, h = Words(data, offs).shingles(shingle)
    least = np.full(rows * BINS, _EMPTY)
    np.minimum.at(least, text * BINS + (h >> U64(64 - BINS.bit_length() + 1)).astype(np.int64), h)
    least = least.reshape(rows, BINS)
    full = least != _EMPTY
    some = full.any(axis=1)
    order, place = _order()
    source = least.copy()
    r, i = np.nonzero(~full & some[:, None])
    for a in range(ROUNDS):
        if not len(r):
            break
        j = order[i, a]
        hit = full[r, j]
        least[r[hit], i[hit]] = source[r[hit], j[hit]]
        r, i = r[~hit], i[~hit]
    if len(r):  # few bins are full: look at those alone
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            row, held = r[a], np.flatnonzero(full[r[a]])
            least[row, i[a:b]] = source[row, held[place[i[a:b]][:, held].argmin(axis=1)]]
    # The bits also depend on the bin, so that copies of one value agree by chance bin by bin, not all at once.
    least ^= np.arange(1, BINS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return (mix(least) & U64((1 << BITS) - 1)).astype(np.uint8) * some[:, None], some


def packed(values: np.ndarray, some: np.ndarray) -> list[str]:
    both = (values[:, 0::2] << BITS | values[:, 1::2]).astype(np.uint8)
    return [("" if s else "-") + row.tobytes().hex() for row, s in zip(both, some.tolist(), strict=True)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    chance = 0.5**BITS
    j = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, j, (some_a == some_b).astype(float))


def unpacked(fingerprint: str) -> tuple[np.ndarray, bool]:
    raw = np.frombuffer(bytes.fromhex(fingerprint.lstrip("-")), np.uint8)
    return np.stack([raw >> BITS, raw & ((1 << BITS) - 1)], axis=1).ravel(), not fingerprint.startswith("-")


def _of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [sketches(data, offs) for _, _, data, offs in chunks(pa.array(texts, pa.string()))]
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.empty((0, BINS), np.uint8), np.empty(0, bool))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for i, j, data, offs in chunks(b.column(1)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(packed(*sketches(data, offs)), pa.string())], ["doc_id", "fingerprint"])

    return text_of(docs).mapInArrow(run, "doc_id long, fingerprint string")


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, guest, doc_id, text) in ascending order within a block; each but a guest is held against the one before it."""
    block, text, sketch = None, "", None
    with np.errstate(over="ignore"):
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                blocks, guests, texts = (b.column(k).to_pylist() for k in (0, 1, 3))
                own, some = _of(texts)
                prior_text = [text, *texts[:-1]]
                prior, prior_some = (np.concatenate([x[None] if x.ndim < y.ndim else x, y[:-1]]) for x, y in ((sketch[0], own), (np.array([sketch[1]]), some))) if sketch is not None else (np.concatenate([own[:1], own[:-1]]), np.concatenate([some[:1], some[:-1]]))
                rows = [k for k, g in enumerate(guests) if not g]
                assert all(blocks[k] == (blocks[k - 1] if k else block) for k in rows), "a block without a row before its first"
                edited = []
                for k in rows:
                    t = texts[k]
                    cut = len(t) // 3
                    edited.append(t[: len(t) - cut] + prior_text[k][:cut])
                changed, changed_some = _of(edited)
                at = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(2).take(pa.array(at)),
                        pa.array([len(texts[k]) for k in rows], pa.int64()),
                        pa.array([sha256_hex(t.encode()) for t in edited], pa.string()),
                        pa.array(packed(own[at], some[at]), pa.string()),
                        pa.array(packed(changed, changed_some), pa.string()),
                        pa.array(likeness(own[at], some[at], changed, changed_some), pa.float64()),
                        pa.array(likeness(own[at], some[at], prior[at], prior_some[at]), pa.float64()),
                    ],
                    names=[c.split()[0] for c in REPORT.split(", ")],
                )
                block, text, sketch = blocks[-1], texts[-1], (own[-1], some[-1])
    give_back()


def _block_of(bounds: np.ndarray, hot: dict[int, int]):
    """Adds (block, part) to rows (doc_id, tie, ...): blocks are ranges of doc_id; a hot doc_id is a block of its own, cut into parts by the range of its ties."""
    names, parts = np.array(sorted(hot), np.int64), np.array([hot[k] for k in sorted(hot)], U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tie = (b.column(k).to_numpy() for k in (0, 1))
            part = np.zeros(len(ids), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
                mine = names[at] == ids
                place = (tie[mine].view(U64) ^ U64(1 << 63)) >> U64(32)
                part[mine] = (place * parts[at[mine]] >> U64(32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, ids, side="right"), pa.int64()), pa.array(part), *b.columns], ["block", "part", *b.schema.names])

    return run


def _even_keys(spark, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning deals to it."""
    found = spark.range(24 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    keys = {r.p: r.id for r in found}
    return [keys.get(p, p) for p in range(n)]


def next_document_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row, of its text with the last third replaced by the next document's start, and how alike they are.

    The next document is the one with the next smaller doc_id (null counts as the least long; rows with equal doc_id go by a hash
    of the text, then by text); after the last comes the first. Rows are cut into blocks of about ``BLOCK_CHARS`` by quantiles of
    doc_id, rows of one doc_id that would fill more by the range of the hash. Each block gets its predecessor's last row as a
    guest, so that blocks are independent and only one shuffle moves text. The driver holds two numbers for each block.
    """
    spark = docs.sparkSession
    texts = text_of(docs).withColumns({"own_id": F.col("doc_id"), "doc_id": F.coalesce("doc_id", F.lit(_LEAST_ID)), "tie": F.xxhash64("text")})
    chars = texts.agg(F.sum(F.length("text")), F.count("*")).first()
    if not chars[1]:
        return spark.createDataFrame([], REPORT)
    blocks = max(1, (chars[0] or 0) // BLOCK_CHARS)
    cuts, hot = [], {}
    if blocks > 1:
        cuts = texts.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], max(100_000, 16 * blocks))).first()[0]
        sizes = texts.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).where(F.col("n") > 2 * BLOCK_CHARS)
        hot = {r.doc_id: -(-r.n // BLOCK_CHARS) for r in sizes.collect()}  # fewer than blocks
    bounds = np.unique(np.array([*cuts, *hot, *(k + 1 for k in hot)], np.int64))
    place = "block long, part long, doc_id long, tie long"
    last = texts.select("doc_id", "tie").mapInArrow(_block_of(bounds, hot), place).groupBy("block", "part").agg(F.max(F.struct("doc_id", "tie")).alias("last"))
    ends = sorted((r.block, r.part, r.last.doc_id, r.last.tie) for r in last.collect())
    # ends has a row for each block that holds any; the first of them follows the last.
    keys = _even_keys(spark, len(ends))
    table = [(b, p, keys[k], ends[k - 1][2], ends[k - 1][3]) for k, (b, p, *_) in enumerate(ends)]
    wanted = F.broadcast(spark.createDataFrame(table, "block long, part long, target long, last_id long, last_tie long"))
    rows = texts.select("doc_id", "tie", "own_id", "text").mapInArrow(_block_of(bounds, hot), f"{place}, own_id long, text string")
    own = rows.join(wanted, ["block", "part"]).select("target", F.lit(False).alias("guest"), "doc_id", "tie", "own_id", "text")
    sent = texts.join(wanted, (F.col("doc_id") == F.col("last_id")) & (F.col("tie") == F.col("last_tie"))).groupBy("target").agg(F.max("text").alias("text"))
    sent = sent.select("target", F.lit(True).alias("guest"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast("long").alias("own_id"), "text")
    dealt = own.unionByName(sent).repartition(len(ends), "target").sortWithinPartitions("target", F.col("guest").desc(), "doc_id", "tie", "text")
    return dealt.select("target", "guest", "own_id", "text").mapInArrow(_compared, REPORT)
