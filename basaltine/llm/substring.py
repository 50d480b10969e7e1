"""Substring dedup by suffix automata of the segments that share a minimiser.

A passage of ``width`` words is removed from a document when the same words
stand in a document with a smaller doc_id. Plan:

1. Every window has a minimiser (the least hash of the ``GRAM``-word runs within
   it); equal windows have equal minimisers. Those that two documents share are
   marked in a bitmap (more may pass it, never fewer), so no text is shuffled for it.
2. Each document is cut into segments: runs of windows with the same marked
   minimiser. So each window is in one segment, and the segments hold a few times
   the words of the shared passages, whatever the number of copies or families.
3. Equal segments are one. The first document that has a segment keeps what no
   other segment holds before it; all others lose the whole of it.
4. Different segments of one minimiser meet in one task, dealt into shards of about
   ``SHARD_WORDS`` words. An automaton over words (not hashes) is built of them in the
   order of their first documents, and each is streamed through it: the matching
   statistics say for each position whether the last ``width`` words occur in it and
   which document has them first.
5. A minimiser whose different segments have more than ``MINIMISER_WORDS`` words (a
   frequent line in many surroundings) fits no automaton. Its different segments give
   their windows, each once, as hashes; the first owner of each is joined back, so that
   no task holds all that stands around a frequent line.

Equal segments, and the windows of step 5, are told by two hashes of 64 bits each; all
else by the words.

Results for odd rows: null doc_id is never a smaller document and loses
nothing; null text is empty; a text shorter than the window stays whole; rows
with the same doc_id never remove each other's words; empty tables give empty
tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bitmap, bitmap_size, prefilter, text_of
from .tokens import U64, Words, chunks, gram_hashes, sha256_hex, window_min

GRAM = 16
#: Words of a shard, on average; windows of a segment, at most.
SHARD_WORDS, PIECE_WINDOWS = 100_000, 10_000
#: Words of all different segments of one minimiser that make up one automaton, at most.
MINIMISER_WORDS = 250_000
#: Words of all copies of a segment, from which on the segment is broadcast to its copies.
STREAM_WORDS = 1_000_000


class SuffixAutomaton:
    """Automaton of texts added in order; each state knows the first text in which its words occur."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [-1]

    def add(self, words: list, owner: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(owner)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        self.first.append(self.first[q])
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def spans(self, words: list, width: int, owner: int) -> list[tuple[int, int]]:
        """Maximal runs of words covered by windows that an earlier text has."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        v = n = 0
        out: list[tuple[int, int]] = []
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(c)
            if to is None:
                n = 0
                continue
            v, n = to, n + 1
            if n >= width:
                up = link[v]
                while length[up] >= width:
                    v, n = up, length[up]
                    up = link[v]
                if first[v] < owner:
                    if out and out[-1][1] >= i + 1 - width:
                        out[-1] = (out[-1][0], i + 1)
                    else:
                        out.append((i + 1 - width, i + 1))
        return out


def _minimisers(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, minimiser) of every window."""
    hashes = words.hashes()
    gram = min(GRAM, width)
    if len(hashes) < width:
        return np.empty(0, np.int64), np.empty(0, U64)
    at = np.flatnonzero(words.text[: len(hashes) - width + 1] == words.text[width - 1 :])
    return at, window_min(gram_hashes(hashes, gram), width - gram + 1)[at]


def _runs(keep: np.ndarray, at: np.ndarray, text: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window and minimiser of each maximal run of kept windows of one text with one minimiser."""
    at, text, least = at[keep], text[keep], least[keep]
    if not len(at):
        return at, at, least
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(text) != 0) | (least[1:] != least[:-1]))
    return at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], least[np.r_[0, cut + 1]]


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for i, _, data, offs in chunks(b.column(1)):
                    words = Words(data, offs)
                    at, least = _minimisers(words, width)
                    if not len(at):
                        continue
                    text = words.text[at]
                    new = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]
                    text, least = text[new], least[new]
                    order = np.lexsort((least, text))
                    text, least = text[order], least[order]
                    new = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[text[new] + i]), pa.array(least[new].view(np.int64))], ["doc_id", "anchor"])

    return run


SEGMENTS = "doc_id long, fp long, start long, n long, anchor long, span binary"


def _segments(width: int, most: int, marks: np.ndarray):
    """Runs of at most ``most`` windows with the same marked minimiser: their first word, number of windows, minimiser, and words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = U64(len(marks) * 64 - 1)
        with np.errstate(over="ignore"):
            for b in batches:
                ids, fps = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for i, _, data, offs in chunks(b.column(2)):
                    words = Words(data, offs)
                    at, least = _minimisers(words, width)
                    place = (least & mask).astype(np.int64)
                    lo, hi, anchor = _runs((marks[place >> 6] >> (place & 63)) & 1 != 0, at, words.text[at], least)
                    if not len(lo):
                        continue
                    lo, hi, of = _pieces(lo, hi, most)
                    text, raw = words.text[lo], words.data.tobytes()
                    spans = [b" ".join(raw[x:y].split()) for x, y in zip(words.starts[lo].tolist(), words.ends[hi + width - 1].tolist(), strict=True)]
                    columns = [ids[text + i], fps[text + i], lo - words.first[text], hi - lo + 1, anchor[of].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(spans, pa.binary())], ["doc_id", "fp", "start", "n", "anchor", "span"])

    return run


def _pieces(lo: np.ndarray, hi: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows cut into runs of ``most`` at most, and which run each is of."""
    n = (hi - lo) // most + 1
    of = np.repeat(np.arange(len(lo)), n)
    first = lo[of] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * most
    return first, np.minimum(first + most - 1, hi[of]), of


def _windows(width: int):
    """The different windows of each segment, named by two hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for i, _, data, offs in chunks(b.column(3)):
                    words = Words(data, offs)
                    at, one = words.grams(words.hashes(), width)
                    _, two = words.grams(words.hashes(1), width)
                    order = np.lexsort((one, words.text[at]))
                    row, one, two = words.text[at][order], one[order], two[order]
                    new = np.r_[True, (one[1:] != one[:-1]) | (row[1:] != row[:-1])]
                    keys = [b.column(k).take(pa.array(row[new] + i)) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64))], ["anchor", "key", "owner", "one", "two"])

    return run


def _covered(width: int):
    """The words of each segment, as ranges, that the listed windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                lists = b.column(4)
                values, sizes = lists.flatten().to_numpy(zero_copy_only=False).view(U64), np.diff(lists.offsets.to_numpy())
                ends = np.cumsum(sizes)
                for i, j, data, offs in chunks(b.column(3)):
                    words = Words(data, offs)
                    at, one = words.grams(words.hashes(), width)
                    row = words.text[at]
                    mine = slice(ends[i] - sizes[i], ends[j - 1])
                    salt = U64(0x9E3779B97F4A7C15)
                    listed = np.isin(one ^ row.astype(U64) * salt, values[mine] ^ np.repeat(np.arange(j - i), sizes[i:j]).astype(U64) * salt)
                    lo, hi, _ = _runs(listed, at, row, np.zeros(len(at), U64))
                    of = words.text[lo]
                    keys = [b.column(k).take(pa.array(of + i)) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(lo - words.first[of]), pa.array(hi - words.first[of] + width)], ["anchor", "key", "owner", "lo", "hi"])

    return run


def _joined(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their entry of the table, where it has one. Entries of ``many`` rows are broadcast: those rows stay where they are."""
    many = F.broadcast(table.where("many").drop("many"))
    few = rows.join(many.select(on), on, "left_anti").join(table.where("not many").drop("many"), on)
    return rows.join(many, on).unionByName(few)


PARTS = "anchor long, key long, owner long, lo long, hi long"


def _match(width: int):
    """The words of each segment, as ranges, that windows of a segment with a smaller owner have."""

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("anchor", "ascending"), ("owner", "ascending"), ("key", "ascending")])
        anchors, keys, owners = (shard[c].to_numpy() for c in ("anchor", "key", "owner"))
        cuts = [0, *(np.flatnonzero(np.diff(anchors)) + 1).tolist(), len(anchors)]
        got: list[tuple[int, int, int, int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if owners[a] == owners[b - 1]:
                continue
            automaton, codes = SuffixAutomaton(), {}
            texts = [[codes.setdefault(w, len(codes)) for w in span.split()] for span in shard["span"].slice(a, b - a).to_pylist()]
            rows = list(zip(keys[a:b].tolist(), owners[a:b].tolist(), texts, strict=True))
            for _, owner, text in rows:
                automaton.add(text, owner)
            anchor = int(anchors[a])
            for key, owner, text in rows:
                got += [(anchor, key, owner, lo, hi) for lo, hi in automaton.spans(text, width, owner)]
        columns = list(zip(*got, strict=True)) if got else [[], [], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "key", "owner", "lo", "hi"])

    return run


def repeated_spans(docs: DataFrame, width: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fp, lo, hi): word ranges, which may overlap, that a document with a smaller doc_id has too; fp is xxhash64 of the text."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    texts = text_of(docs).where("doc_id is not null and length(text) > 0")
    anchors = texts.mapInArrow(_anchors(width), "doc_id long, anchor long")
    shared = scratch.write(anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "shared")
    bits = bitmap_size(shared.count())
    marks = bitmap(shared.select(F.col("anchor").bitwiseAND(bits - 1).alias("h")), bits)
    segments = texts.select("doc_id", F.xxhash64("text").alias("fp"), "text").mapInArrow(_segments(width, PIECE_WINDOWS, marks), SEGMENTS)
    segments = scratch.write(segments.withColumn("key", F.xxhash64("span")), "segments", large=True)

    keys = segments.groupBy("anchor", "key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("copies"), F.max("n").alias("n"))
    keys = scratch.write(keys, "keys")
    kinds = keys.groupBy("anchor").agg(F.sum(F.col("n") + (width - 1)).alias("words"), F.min("owner").alias("a"), F.max("owner").alias("b"))
    kinds = scratch.write(kinds.where("a < b").select("anchor", "words", (F.col("words") > MINIMISER_WORDS).alias("hot")), "kinds")
    n, words = kinds.where("not hot").agg(F.count("*"), F.sum("words")).first()
    hot = F.broadcast(kinds.where("hot").select("anchor"))  # one for MINIMISER_WORDS words, at most

    # Equal texts are one segment, with the smallest document that has it, before they move.
    different = lambda df: df.groupBy("anchor", "key", "span").agg(F.min("doc_id").alias("owner")).select("anchor", "key", "owner", "span")
    mixed = segments.where(prefilter(kinds.where("not hot").select("anchor"), n)(F.col("anchor"))).join(hot, "anchor", "left_anti")
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-(words or 0) // SHARD_WORDS))))
    parts = scratch.write(different(mixed).groupBy(shard.alias("shard")).applyInArrow(_match(width), PARTS), "parts", large=True)

    wide = scratch.write(different(segments.join(hot, "anchor", "left_semi")), "wide")
    windows = scratch.write(wide.mapInArrow(_windows(width), "anchor long, key long, owner long, one long, two long"), "windows")
    first = windows.groupBy("one", "two").agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.count("*").alias("n"))
    first = scratch.write(first.where("a < b").select("one", "two", "a", (F.col("n") > STREAM_WORDS // width).alias("many")), "first")
    late = _joined(windows, first, ["one", "two"]).where("owner > a").groupBy("anchor", "key").agg(F.collect_list("one").alias("late"))
    parts = parts.unionByName(wide.join(late, ["anchor", "key"]).select("anchor", "key", "owner", "span", "late").mapInArrow(_covered(width), PARTS))

    many = F.col("copies") * (F.col("n") + (width - 1)) > STREAM_WORDS
    owners = scratch.write(keys.where("owner < last").select("anchor", "key", "owner", many.alias("many")), "owners")
    places = segments.select("doc_id", "fp", "start", "n", "anchor", "key")
    whole = _joined(places, owners, ["anchor", "key"]).where("doc_id > owner")
    whole = whole.select("doc_id", "fp", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (width - 1)).alias("hi"))
    part = places.join(parts.withColumnRenamed("owner", "doc_id"), ["anchor", "key", "doc_id"])
    return whole.unionByName(part.select("doc_id", "fp", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, removed, kept = [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = text.encode().split()
            total.append(len(words))
            at, left = 0, []
            for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
                left += words[at : s[0]] if s[0] > at else []
                at = max(at, s[1])
            left += words[at:]
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every row."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(repeated_spans(docs, width, scratch), "found")
    scratch.drop("shared", "segments", "keys", "kinds", "parts", "wide", "windows", "first", "owners")
    found = found.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    keyed = text_of(docs).withColumn("fp", F.xxhash64("text"))
    joined = keyed.join(found, ["doc_id", "fp"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_text string")


__all__ = ["SuffixAutomaton", "repeated_spans", "sha256_hex", "substring_dedup"]
