"""Near-duplicates by min-max hashing.

A permutation of 32-bit values is evaluated once for each shingle and both its
least and its greatest value are kept: two nearly independent unbiased samples
for one evaluation. ``PERMUTATIONS`` of them give twice as many signature values,
cut into bands of ``ROWS`` (half minima, half maxima). At similarity 0.85 a pair
misses all bands with probability (1 - 0.85**6)**40 = 6e-9, at 0.8 5e-6.

1. Rows with equal sequences of words (by a 128-bit digest of them) are one text;
   it goes on with the row of the smallest doc_id that has it.
2. In each band bucket every member is paired with the bucket's smallest node:
   a bucket of n gives n - 1 pairs. Pairs whose signatures agree on ``LOOSE`` or
   more are edges. A member that agrees with the smallest so well that whatever it
   is linked with has such an edge too (see ``_bounds``) is done with in this
   bucket; the others are held against each other in the same way, in bounded
   tasks, until each is done with or alone. The components of the edges are
   families, within which all links lie that share a bucket and agree on the
   values of ``_least``.
3. Families are dealt into tasks of a bounded number of documents and shingles.
   In a task, signatures are compared as matrices and pairs that may still join
   two components are confirmed on their full sets, shingles being told apart by
   their words. Of a family larger than a task each member is first held against
   the family's smallest only, which goes to every block of it; only the members
   that aren't linked with it then meet all blocks. So a family of n costs about
   n / BLOCK_DOCS tasks, and blocks of unlinked members times as many.
4. Components of the confirmed links are the answer, named by their least doc_id.

Rows are told apart, not ids: a null doc_id is linked with nothing (its
component is null), rows that repeat a doc_id are linked by their texts alone.
Empty or null text has no shingles and is linked with nothing. A text shorter
than a shingle is one shingle as a whole. Other columns of docs are never looked
at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, prefilter, row_hash, text_hash, text_of, whole_row
from .tokens import U64, Words, buffers, chunks, give_back, mix, words_of

PERMUTATIONS, BANDS, ROWS = 120, 40, 6
LOOSE = 0.45
BLOCK_DOCS, BLOCK_SHINGLES = 4000, 1_000_000
#: Chance at most that signatures of a pair at the threshold agree on less than ``_least``, if their values are independent.
CHANCE = 1e-6


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (h[:PERMUTATIONS] >> U64(32)).astype(np.uint32) | np.uint32(1), (h[PERMUTATIONS:] >> U64(32)).astype(np.uint32)


A, B = _multipliers()


def _distinct(text: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted within it, and the offsets of the texts; ``text`` ascends."""
    at = np.searchsorted(text, np.arange(rows + 1))
    value = value.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and the offsets of the texts."""
    return _distinct(*words.shingles(n), len(words.counts))


def exact_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Shingle sets of some texts as sorted numbers; two are equal only if the words are."""
    data, offs = buffers(texts)
    words = Words(data, offs, lower=True)
    code = words_of(words).dictionary_encode().indices.to_numpy().astype(np.int64)
    own = np.flatnonzero((words.counts > 0) & (words.counts < n))
    text, run, base = words.text, code, len(code) + 1
    for k in range(1, n):
        if len(code) > k:
            run = np.unique(run[: len(code) - k] * base + code[k:], return_inverse=True)[1]
    at = np.flatnonzero(text[: len(code) - n + 1] == text[n - 1 :]) if len(code) >= n else np.empty(0, np.int64)
    # Whole short texts are told apart by their words too; no longer text has such a shingle.
    whole: dict[tuple, int] = {}
    short = [-1 - whole.setdefault(tuple(code[words.first[i] : words.first[i] + words.counts[i]].tolist()), len(whole)) for i in own.tolist()]
    value, where = np.concatenate([run[at] if len(at) else at, np.array(short, np.int64)]), np.concatenate([text[at], own])
    order = np.argsort(where, kind="stable")
    value, cuts = _distinct(where[order], value[order], len(words.counts))
    return [value[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def text_digests(words: Words) -> list[bytes]:
    """128-bit digests of the texts' sequences of words."""
    data, first = words.data.tobytes(), words.first.tolist()
    starts, ends = words.starts, words.ends
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        out.append(hashlib.blake2b(b" ".join(data[starts[a] : ends[b - 1]].split()) if b > a else b"", digest_size=16).digest())
    return out


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Low 16 bits of minima and maxima under each permutation: texts by 2 * PERMUTATIONS; zero for a text without shingles."""
    rows = len(at) - 1
    out = np.zeros((rows, 2 * PERMUTATIONS), np.uint16)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        starts, x = at[:-1][some], (values >> U64(32)).astype(np.uint32)
        for k in range(PERMUTATIONS):
            y = x * A[k] + B[k]
            out[some, 2 * k] = np.minimum.reduceat(y, starts)
            out[some, 2 * k + 1] = np.maximum.reduceat(y, starts)
    return out


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for i, j, data, offs in chunks(b.column(2)):
                    words = Words(data, offs, lower=True)
                    values, at = shingle_sets(words, n)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(at)), pa.array(text_digests(words), pa.binary()), pa.array([r.tobytes() for r in signatures(values, at)], pa.binary())],
                        ["doc_id", "fp", "n_shingles", "digest", "sig"],
                    )
        give_back()

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, 2 * PERMUTATIONS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                sig = _matrix(part.column(1)).reshape(-1, BANDS, ROWS).astype(U64)
                key = np.full(sig.shape[:2], U64(0)) + np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
                for k in range(ROWS):
                    key = mix(key ^ (sig[:, :, k] + U64(1)) * U64(0xD1342543DE82EF95))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["key", "node"])


def _least(percent: int) -> int:
    """Signature values on which a linked pair agrees at least, but for ``CHANCE``: by the binomial tail."""
    n, p, total = 2 * PERMUTATIONS, percent / 100, 0.0
    for k in range(n):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total > CHANCE:
            return k
    return n


def _bounds(percent: int) -> tuple[int, int]:
    """(loose, tight): signature values on which an edge agrees, and on which a member agrees that is done with.

    Disagreements are a metric: what agrees with a centre on ``tight`` values, and with another document on as many as
    links do at least, makes that document agree with the centre on ``loose``.
    """
    values = 2 * PERMUTATIONS
    loose = math.ceil(LOOSE * values)
    return loose, loose + values - _least(percent)


def _agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = np.count_nonzero(_matrix(b.column(2)) == _matrix(b.column(3)), axis=1) if b.num_rows else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.int64())], ["u", "v", "same"])


def _stars(sig: np.ndarray, loose: int, tight: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each centre with its edges; members that agree on ``tight`` with a centre are no centres any more and meet no others."""
    at = np.arange(len(sig))
    while len(at) > 1:
        same = np.count_nonzero(sig[1:] == sig[0], axis=1)
        yield int(at[0]), at[1:][same >= loose]
        keep = same < tight
        at, sig = (at[1:], sig[1:]) if keep.all() else (at[1:][keep], sig[1:][keep])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the least of each component of the edges (u, v) to its other nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        for x in (label[a], label[b]):
            np.minimum.at(label, x, least)
        while (label[label] != label).any():
            label = label[label]
    hung = label != np.arange(len(nodes))
    return nodes[label[hung]], nodes[hung]


def _rest(loose: int, tight: int):
    """Edges among the members of buckets, as a forest: components are all that is asked of them, and a member in many buckets is one row."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("node", "ascending")]).combine_chunks()
        key, ids = table["key"].to_numpy(), table["node"].to_numpy()
        sig = _matrix(table["sig"])
        cuts = np.flatnonzero(np.diff(key)) + 1
        us, vs = [ids[:0]], [ids[:0]]
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            for i, found in _stars(sig[lo:hi], loose, tight):
                us.append(np.full(len(found), ids[lo + i]))
                vs.append(ids[lo + found])
        u, v = _forest(np.concatenate(us), np.concatenate(vs))
        give_back()
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _edges(nodes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(u, v): edges whose components are the families."""
    loose, tight = _bounds(percent)
    rows = nodes.select("node", "sig").mapInArrow(_bands, "key long, node long")
    least = rows.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("w")).where("u < w").select("key", "u")
    stars = scratch.write(rows.join(least, "key").where("node > u").select("key", "u", F.col("node").alias("v")), "stars")
    sig = nodes.select("node", "sig")
    pairs = stars.select("u", "v").distinct()
    pairs = pairs.join(sig.select(F.col("node").alias("u"), F.col("sig").alias("s")), "u").join(sig.select(F.col("node").alias("v"), F.col("sig").alias("t")), "v")
    same = scratch.write(pairs.select("u", "v", "s", "t").mapInArrow(_agreed, "u long, v long, same long"), "same")
    left = scratch.write(stars.join(same.where(F.col("same") < tight), ["u", "v"]).select("key", F.col("v").alias("node")), "left")
    counts = scratch.write(left.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    bins = max(8, -(-(counts.agg(F.sum("n")).first()[0] or 0) // BLOCK_DOCS))
    # A bucket of several blocks is dealt as pairs of blocks, so that any two members meet in a task.
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK_DOCS))).cast("long")
    placed = left.join(counts, "key").withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("i"))
    several = F.transform(others, lambda j: F.concat_ws("-", F.lit("pair"), "key", F.least("i", j), F.greatest("i", j)))
    one = F.array(F.concat(F.lit("bin-"), F.pmod(F.xxhash64("key"), F.lit(bins)).cast("string")))
    work = placed.select("key", "node", F.explode(F.when(F.col("blocks") > 1, several).otherwise(one)).alias("task"))
    rest = work.join(sig, "node").select("task", "key", "node", "sig").groupBy("task").applyInArrow(_rest(loose, tight), "u long, v long")
    return same.where(F.col("same") >= loose).select("u", "v").unionByName(rest).distinct()


class _Union(dict):
    def find(self, x: int) -> int:
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    merged = np.concatenate([s, t])
    merged.sort()
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (len(merged) - common)


def _confirmed(sets: list[np.ndarray], sig: np.ndarray, sides: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among the sets: of pairs on side 1 none is tried, and with a side 2 only pairs with it."""
    n, least = len(sets), _least(percent)
    size = np.array([len(s) for s in sets])
    union = _Union({i: i for i in range(n)})
    star = bool((sides == 2).any())
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        ok = np.minimum(size[rest], size[i]) * 100 >= np.maximum(size[rest], size[i]) * percent
        ok &= (sides[rest] == 2) | (sides[i] == 2) if star else (sides[rest] != 1) | (sides[i] != 1)
        rest = rest[ok]
        if len(rest):
            same = (sig[rest] == sig[i]).sum(axis=1)
            near = same >= least
            rest, same = rest[near], same[near]
            for j in rest[np.argsort(-same, kind="stable")].tolist():
                a, b = union.find(i), union.find(j)
                if a != b and _linked(sets[i], sets[j], percent):
                    union[max(a, b)] = min(a, b)
                    yield i, j


def _links(n: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("node", "ascending")])
        family, nodes = table["family"].to_numpy(), table["node"].to_numpy()
        cuts = np.flatnonzero(np.diff(family)) + 1
        found = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(family)], strict=True):
            part = table.slice(lo, hi - lo)
            sets = exact_sets(part["text"].combine_chunks(), n)
            found += [(int(nodes[lo + i]), int(nodes[lo + j])) for i, j in _confirmed(sets, _matrix(part["sig"]), part["side"].to_numpy(), percent)]
        give_back()
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


TASK = ["task", "family", "side", "node"]


def _name(kind: str, *parts) -> Column:
    return F.concat_ws("-", F.lit(kind), *parts)


def _first_tasks(members: DataFrame, large: DataFrame) -> DataFrame:
    """Whole small families, several to a task; blocks of large ones, each with the family's smallest member on side 2."""
    few = members.join(large, "family", "left_anti")
    load = few.agg(F.sum("n_shingles")).first()[0] or 0
    bins = max(8, -(-load // (BLOCK_SHINGLES // 2)))
    whole = few.select(_name("bin", F.pmod(F.xxhash64("family"), F.lit(bins))).alias("task"), "family", F.lit(0).alias("side"), "node")
    many = members.join(large, "family")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    own = many.where("node <> family").select(_name("star", "family", block).alias("task"), "family", F.lit(1).alias("side"), "node")
    centre = large.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    centre = centre.select(_name("star", "family", "k").alias("task"), "family", F.lit(2).alias("side"), F.col("family").alias("node"))
    return whole.unionByName(own).unionByName(centre)


def _other_tasks(members: DataFrame, large: DataFrame, linked: DataFrame) -> DataFrame:
    """Members of large families that aren't linked with the smallest (side 0), in blocks, against all blocks of the family (side 1)."""
    many = members.join(large, "family").where("node <> family")
    free = many.join(linked, "node", "left_anti").select("family", "blocks", "node", "n_shingles")
    cut = free.groupBy("family").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("free_blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = free.join(cut, "family").select("family", F.pmod(F.xxhash64("node", F.lit(1)), F.col("free_blocks")).alias("a"), every("blocks").alias("b"), F.lit(0).alias("side"), "node")
    told = many.join(linked, "node", "left_semi").join(cut, "family").select("family", every("free_blocks").alias("a"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("b"), F.lit(1).alias("side"), "node")
    # Unlinked members also meet each other, as the blocks of the other side.
    other = free.join(cut, "family").select("family", every("free_blocks").alias("a"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("b"), F.lit(1).alias("side"), "node")
    return asked.unionByName(told).unionByName(other).select(_name("pair", "family", "a", "b").alias("task"), "family", "side", "node")


def _blocks(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / F.lit(float(BLOCK_DOCS))), F.ceil(shingles / F.lit(float(BLOCK_SHINGLES)))).cast("long")


def text_groups(docs: DataFrame, shingle: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketch, firsts, found): (doc_id, fp, n_shingles, digest) of every row; (digest, node, first_id, first_fp) of every text; (node, component, component_id) of those with links."""
    texts = text_of(docs).select("doc_id", F.xxhash64("text").alias("fp"), "text")
    sketch = scratch.write(texts.mapInArrow(_sketch(shingle), "doc_id long, fp long, n_shingles long, digest binary, sig binary"), "sketch")
    rows = sketch.where("n_shingles > 0 and doc_id is not null")
    # One row stands for each text. It may be there several times: then its text is fetched once.
    alike = rows.groupBy("digest", "doc_id", "fp").agg(F.count("*").alias("n"))
    firsts = alike.groupBy("digest").agg(F.min(F.struct("doc_id", "fp", "n")).alias("x")).select("digest", "x.*")
    # A doc_id that stands for several texts names the first; the others get numbers of their own.
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest"))
    firsts = scratch.write(firsts.withColumn("node", F.when(place == 1, F.col("doc_id")).otherwise(F.xxhash64("digest"))), "firsts")
    held = firsts.agg(F.count("*"), F.count_distinct("node"), F.max("n")).first()
    if held[0] != held[1]:
        raise ValueError("numbers of texts collide")
    once = lambda df: df.dropDuplicates(["node"]) if (held[2] or 1) > 1 else df
    nodes = scratch.write(once(rows.join(firsts, ["digest", "doc_id", "fp"]).select("node", "doc_id", "fp", "n_shingles", "sig")), "nodes")

    families = connected_components(_edges(nodes, scratch, percent), scratch, "families")
    members = families.join(nodes.select("node", "n_shingles"), "node").select("node", F.col("component").alias("family"), "n_shingles")
    members = scratch.write(members, "members")
    large = members.groupBy("family").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("blocks")).where("blocks > 1")
    large = scratch.write(large, "large")
    scratch.drop("stars", "same", "left", "counts")
    wanted = members.join(nodes.select("node", "doc_id", "fp", "sig"), "node")
    reaches = prefilter(wanted.select(F.xxhash64("doc_id", "fp")), members.count())
    text = texts.where(reaches(F.xxhash64("doc_id", "fp"))).join(wanted.select("node", "doc_id", "fp", "sig"), ["doc_id", "fp"]).select("node", "sig", "text")
    text = scratch.write(once(text), "texts")

    def links(tasks: DataFrame) -> DataFrame:
        return tasks.join(text, "node").select(*TASK, "sig", "text").groupBy("task").applyInArrow(_links(shingle, percent), "u long, v long")

    found = scratch.write(links(_first_tasks(members, large)), "links-1")
    if not large.isEmpty():
        near = found.join(large, found.u == large.family).select(F.col("v").alias("node"))
        near = near.unionByName(found.join(large, found.v == large.family).select(F.col("u").alias("node"))).distinct()
        found = found.unionByName(scratch.write(links(_other_tasks(members, large, near)), "links-2"))
    groups = connected_components(found, scratch, "groups")
    named = groups.join(nodes.select("node", "doc_id"), "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = scratch.write(named.join(least, "component").select("node", "component", "component_id"), "found")
    scratch.drop("texts", "members", "large", "nodes", "links-1", "links-2")
    return sketch.drop("sig"), firsts.select("digest", "node", F.col("doc_id").alias("first_id"), F.col("fp").alias("first_fp")), found


def near_groups(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row."""
    sketch, firsts, found = text_groups(docs, shingle, percent, Scratch(docs.sparkSession))
    named = firsts.join(found, "node", "left").select("digest", F.coalesce("component_id", "first_id").alias("c"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = sketch.join(named, "digest", "left")
    component = F.when(linked, F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one of each group of linked texts, with docs' own columns, whatever their names.

    It is the row with the smallest doc_id, then with the least hash of the text and of all columns. Rows without words or doc_id
    stay. Only rows that may be in a group of several rows are shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    sketch, firsts, found = text_groups(docs, shingle, percent, scratch)
    rows = sketch.where("n_shingles > 0 and doc_id is not null").select("doc_id", "fp", "digest")
    texts = rows.groupBy("digest").agg(F.count("*").alias("n")).join(firsts, "digest").join(found, "node", "left")
    texts = scratch.write(texts.select("digest", "n", F.coalesce("component", "node").alias("g"), F.struct(F.col("first_id").alias("doc_id"), F.col("first_fp").alias("fp")).alias("first")), "grouped")
    groups = texts.groupBy("g").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1").select("g", "first")
    touched = rows.distinct().join(texts.select("digest", "g"), "digest").join(groups, "g")
    touched = scratch.write(touched.select(F.col("doc_id").alias("t_id"), F.col("fp").alias("t_fp"), (F.struct("doc_id", "fp") == F.col("first")).alias("stays")), "touched")
    reaches = prefilter(touched.select(F.xxhash64("t_id", "t_fp")), touched.count())
    keyed = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("fp"), row_hash(docs).alias("hash"))
    keyed = keyed.withColumn("asked", reaches(F.xxhash64("doc_id", "fp")))
    asked = keyed.where("asked").join(touched, (F.col("doc_id") == F.col("t_id")) & (F.col("fp") == F.col("t_fp")), "left")
    number = F.row_number().over(Window.partitionBy("doc_id", "fp").orderBy("hash"))
    others = asked.where("stays is null").select("row")
    stay = asked.where("stays").withColumn("n", number).where("n = 1").select("row")
    return keyed.where("not asked").select("row").unionByName(others).unionByName(stay).select("row.*")
