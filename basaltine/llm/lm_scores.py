"""Stupid-backoff scores of documents by joins with n-gram count tables.

Counts of one, two and three words are taken over all documents, and each
document is scored without its own occurrences (else every n-gram would have
been seen). With c for a count less the document's own and N for the number of
words of all documents:

    S(w | u v) = c(uvw) / c(uv)            if c(uvw) > 0
               = ALPHA * S(w | v)          otherwise
    S(w | v)   = c(vw) / c(v)              if c(vw) > 0
               = ALPHA * S(w)              otherwise
    S(w)       = max(c(w), 1/2) / N

A document's ``log_sum`` is the sum of the natural logs over its words,
``log_score`` that sum for each word.

The relations are packed, as an n-gram for each row would not fit the disk:

* documents are dealt into blocks of about ``BLOCK_CHARS``; a block's exploded
  n-grams are rows (block, part, sorted distinct 64-bit hashes, counts), parts
  being ``FANOUT`` ranges of the hash. So a frequent n-gram is one entry for each
  block, not one for each occurrence;
* lists of up to ``FANOUT`` blocks meet by part and are added up. Of more blocks
  the sums go on, each cut into ``FANOUT`` finer parts, until one list for each
  part is left: that is the count table, partitioned by hash. The totals go back
  the same way and are joined to each block's entries. Every list has about a
  block's size, whatever the level, and levels grow as the logarithm of the input;
* grouped by block, texts and totals meet, own counts are taken out and each
  document is summed.

A run of three words can stand in another document only if both its pairs do. So
pairs are counted first, and triples only where both pairs occur elsewhere: none
that counts is left out.

Words are runs outside white space, unchanged. Null or empty text has no words
and scores 0. Rows that repeat a doc_id are documents of their own, with or
without a doc_id. A block is chosen by a hash of doc_id and text: a very long text makes
its block as large as itself, and rows equal in both are in one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, text_of
from .tokens import U64, Words, chunks, give_back, gram_hashes, mix

ALPHA = 0.4
BLOCK_CHARS = 8_000_000
FANOUT = 128
#: Bytes of a block's texts whose words are held from one pass to the next; of larger blocks they are found again.
HELD_BYTES = 4 * BLOCK_CHARS
_UNI = U64(0x5851F42D4C957F2D)


def _grams(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram hashes, positions of second words, bigram hashes, from the words' hashes. Orders have hashes of their own."""
    if len(h) < 2:
        return mix(h ^ _UNI), np.empty(0, np.int64), np.empty(0, U64)
    second = np.flatnonzero(words.text[1:] == words.text[:-1]) + 1
    return mix(h ^ _UNI), second, gram_hashes(h, 2)[second - 1]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (keys, counts) by key."""
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counts(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, U64), np.empty(0, np.int64))]
    size = 0
    for _, _, data, offs in chunks(texts):
        words = Words(data, offs)
        uni, _, bi = _grams(words, words.hashes())
        for x in (uni, bi):
            held.append(np.unique(x, return_counts=True))
            size += len(held[-1][0])
        if size > 2_000_000:
            held = [_merged(held)]
            size = len(held[0][0]) // 4
    return _merged(held)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps, six bytes each where they fit."""
    gaps = np.diff(keys, prepend=U64(0))
    if len(gaps) and int(gaps[1:].max(initial=0)) < 1 << 48:
        return b"\6" + keys[:1].astype("<u8").tobytes() + gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\10" + keys.astype("<u8").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"\10":
        return np.frombuffer(data, "<u8", offset=1).astype(U64)
    first = np.frombuffer(data, "<u8", count=1, offset=1)
    six = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    gaps = np.zeros((len(six), 8), np.uint8)
    gaps[:, :6] = six
    return np.cumsum(np.concatenate([first, gaps.view("<u8").ravel()]).astype(U64))


LISTS = "node long, part long, grams binary, counts binary"
TOTALS = "node long, part long, totals binary"


def _listed(node: int, first: int, parts: int, most: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Rows of a list cut into ``parts`` parts from ``first`` on; ``most`` parts make up all hashes."""
    edges = np.searchsorted(keys, np.array([((first + k) << 64) // most for k in range(1, parts)], U64)) if parts > 1 else np.empty(0, np.int64)
    cuts = [0, *edges.tolist(), len(keys)]
    rows = [(first + k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    columns = [[node] * len(rows), [k for k, _, _ in rows], [_pack(keys[a:b]) for _, a, b in rows], [_squeeze(counts[a:b]) for _, a, b in rows]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["node", "part", "grams", "counts"])


def _sum(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(each row's keys, the keys of all, their counts)."""
    keys = [_unpack(x) for x in table["grams"].to_pylist()]
    return keys, *_merged([(np.empty(0, U64), np.empty(0, np.int64)), *zip(keys, map(_unsqueeze, table["counts"].to_pylist()), strict=True)])


def _replies(table: pa.Table, keys: list[np.ndarray], of: np.ndarray, total: np.ndarray) -> pa.Table:
    totals = pa.array([_squeeze(total[np.searchsorted(of, k)]) for k in keys], pa.binary())
    give_back()
    return pa.table([table["node"].combine_chunks(), table["part"].combine_chunks(), totals], names=["node", "part", "totals"])


def _up(parts: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        _, keys, counts = _sum(table)
        return _listed(table["node"][0].as_py() // parts, table["part"][0].as_py() * parts, parts, most, keys, counts)

    return run


def _top(table: pa.Table) -> pa.Table:
    """The count table of one part, joined back to each list."""
    return _replies(table, *_sum(table))


def _down(lists: pa.Table, above: pa.Table) -> pa.Table:
    keys, of, _ = _sum(lists)
    got = [_unsqueeze(x) for x in above.sort_by("part")["totals"].to_pylist()]
    return _replies(lists, keys, of, np.concatenate(got) if got else np.empty(0, np.int64))


def totals_of(lists: DataFrame, blocks: int, scratch: Scratch, name: str) -> DataFrame:
    """(node, part, totals): for each entry of each list its count in all of them."""
    levels, nodes, most = [lists if blocks <= FANOUT else scratch.write(lists, f"{name}-0", large=True)], blocks, FANOUT
    over = F.floor(F.col("node") / FANOUT).cast("long")
    while nodes > FANOUT:
        nodes, most = -(-nodes // FANOUT), most * FANOUT
        up = levels[-1].groupBy(over.alias("over"), "part").applyInArrow(_up(FANOUT, most), LISTS)
        levels.append(scratch.write(up, f"{name}-{len(levels)}", large=True))
    totals = scratch.write(levels[-1].groupBy("part").applyInArrow(_top, TOTALS), f"{name}-totals-{len(levels)}", large=True)
    for k in range(len(levels) - 2, -1, -1):
        mine = levels[k].groupBy(over.alias("over"), "part")
        above = totals.groupBy("node", F.floor(F.col("part") / FANOUT).cast("long").alias("below"))
        totals = scratch.write(mine.cogroup(above).applyInArrow(_down, TOTALS), f"{name}-totals-{k + 1}", large=True)
        scratch.drop(f"{name}-{k + 1}", f"{name}-totals-{k + 2}")
    return totals


def _squeeze(counts: np.ndarray) -> bytes:
    """Counts, most of which are small, as zstd of their bytes by place."""
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").ravel().astype(np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, their counts, the place of each value among them)."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    of = np.empty(len(values), np.int64)
    of[order] = group
    return ranked[new], np.bincount(group), of


def _own(text: np.ndarray, counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often a text has each of its n-grams; of: each one's place in ``counts``, how often all these texts have it."""
    out = np.ones(len(of), np.int64)
    more = np.flatnonzero(counts[of] > 1)
    if len(more):
        _, n, same = _distinct(text[more] * len(counts) + of[more])
        out[more] = n[same]
    return out


def _pairs_counted(parts: int):
    """A block's lists of one and two words."""

    def run(group: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            out = _listed(group["block"][0].as_py(), 0, parts, parts, *_counts(group["text"]))
        give_back()
        return out

    return run


class _Chunk:
    """Words of some documents with what others have of them: ``uni`` of each word, ``bi`` of each pair by its second word, and the triples, by the place of the third word, whose pairs both occur elsewhere."""

    def __init__(self, words: Words):
        self.text, self.counts, self.hashes = words.text, words.counts, words.hashes()
        uni, self.second, bi = _grams(words, self.hashes)
        self.keys, self.sums, self.of = _distinct(np.concatenate([uni, bi]))

    def look(self, total: np.ndarray) -> None:
        """total: how often all documents have each of ``keys``."""
        n, second = len(self.text), self.second
        rest = total[self.of]
        self.uni = rest[:n] - _own(self.text, self.sums, self.of[:n])
        self.bi = np.zeros(n, np.int64)
        self.bi[second] = rest[n:] - _own(self.text[second], self.sums, self.of[n:])
        self.third = np.flatnonzero(self.text[2:] == self.text[:-2]) + 2 if n > 2 else np.empty(0, np.int64)
        self.at = self.third[(self.bi[self.third - 1] > 0) & (self.bi[self.third] > 0)]
        tri = mix(gram_hashes(self.hashes, 3)[self.at - 2]) if len(self.at) else np.empty(0, U64)
        self.tri, self.tri_sums, self.tri_of = _distinct(tri)
        self.keys = self.sums = self.of = self.hashes = None

    def scores(self, rest: np.ndarray, n_all: int) -> np.ndarray:
        """log_sum of each document; rest: how often others have the triple at each place of ``at``."""
        score = np.log(np.maximum(self.uni, 0.5) / n_all)
        seen = self.bi[self.second] > 0
        score[self.second[~seen]] += np.log(ALPHA)
        hit = self.second[seen]
        score[hit] = np.log(self.bi[hit] / self.uni[hit - 1])
        score[self.third] += np.log(ALPHA)
        hit = self.at[rest > 0]
        score[hit] = np.log(rest[rest > 0] / self.bi[hit - 1])
        return np.bincount(self.text, weights=score, minlength=len(self.counts)).astype(np.float64)


def _looked_up(docs: pa.Table, replies: pa.Table) -> Iterator[tuple[int, _Chunk]]:
    """(first row, chunk) of a block's documents; replies: totals of its lists of one and two words."""
    texts, total = docs["text"], _joined(replies)
    found = lambda: ((i, _Chunk(Words(data, offs))) for i, _, data, offs in chunks(texts))
    held = list(found()) if texts.nbytes <= HELD_BYTES else None
    keys, _ = _merged([(c.keys, c.sums) for _, c in held] or [(np.empty(0, U64), np.empty(0, np.int64))]) if held is not None else _counts(texts)
    for i, c in held if held is not None else found():
        # Sorted keys in a sorted table: each search begins where the last one ended.
        c.look(total[np.searchsorted(keys, c.keys)])
        yield i, c


def _joined(replies: pa.Table) -> np.ndarray:
    got = [_unsqueeze(b) for b in replies.sort_by("part")["totals"].to_pylist()]
    return np.concatenate(got) if got else np.empty(0, np.int64)


def _triples_counted(parts: int):
    """A block's list of those triples whose pairs both occur in other documents."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            held = [(np.empty(0, U64), np.empty(0, np.int64))]
            for _, c in _looked_up(docs, replies):
                held.append((c.tri, c.tri_sums))
            keys, counts = _merged(held)
        give_back()
        return _listed(docs["block"][0].as_py(), 0, parts, parts, keys, counts)

    return run


SCORES = "doc_id long, n_words long, log_score double, log_sum double"


def _scored(n_all: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        pairs, triples = (replies.filter(pa.compute.equal(replies["words"], k)) for k in (2, 3))
        ids, out = docs["doc_id"].combine_chunks(), []
        with np.errstate(over="ignore"):
            held = list(_looked_up(docs, pairs))
            keys, _ = _merged([(c.tri, c.tri_sums) for _, c in held] or [(np.empty(0, U64), np.empty(0, np.int64))])
            total = _joined(triples)
            for i, c in held:
                rest = total[np.searchsorted(keys, c.tri)][c.tri_of] - _own(c.text[c.at], c.tri_sums, c.tri_of)
                sums, n = c.scores(rest, n_all), c.counts
                out.append(pa.table([ids.slice(i, len(n)), pa.array(n, pa.int64()), pa.array(sums / np.maximum(n, 1)), pa.array(sums)], names=["doc_id", "n_words", "log_score", "log_sum"]))
        give_back()
        return pa.concat_tables(out)

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_score and log_sum of every row."""
    scratch = Scratch(docs.sparkSession)
    texts = text_of(docs)
    size = texts.agg(F.sum(F.length("text")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()
    blocks, n_all = max(1, -(-(size[0] or 0) // BLOCK_CHARS)), size[1] or 0
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(blocks)))
    pairs = totals_of(dealt.groupBy("block").applyInArrow(_pairs_counted(FANOUT), LISTS), blocks, scratch, "pairs")
    listed = dealt.groupBy("block").cogroup(pairs.groupBy("node")).applyInArrow(_triples_counted(FANOUT), LISTS)
    triples = totals_of(listed, blocks, scratch, "triples")
    replies = pairs.withColumn("words", F.lit(2)).unionByName(triples.withColumn("words", F.lit(3)))
    return dealt.groupBy("block").cogroup(replies.groupBy("node")).applyInArrow(_scored(n_all), SCORES)
