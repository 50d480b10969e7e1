"""Graphs over shared keys and vectors: overlap, spanning forests, propagation, neighbours."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.files import written


def overlap_edges(df: DataFrame, node: str, marker: str, self_pairs: bool = False) -> DataFrame:
    """(src, dst, weight): markers that two nodes share, src < dst (or <= with self pairs)."""
    x = df.select(node, marker).distinct()
    pairs = x.select(marker, F.col(node).alias("src")).join(x.select(marker, F.col(node).alias("dst")), marker)
    return pairs.where("src <= dst" if self_pairs else "src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def spanning_forest(edges: list[tuple], nodes: list) -> list[tuple]:
    """(parent, child, weight) of a maximum spanning forest grown from the smallest node of each part; ties by (from, to)."""
    near: dict = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((-w, a, b))
        near.setdefault(b, []).append((-w, b, a))
    seen, out = set(), []
    for root in sorted(nodes):
        if root in seen:
            continue
        seen.add(root)
        heap = list(near.get(root, ()))
        heapq.heapify(heap)
        while heap:
            w, a, b = heapq.heappop(heap)
            if b not in seen:
                seen.add(b)
                out.append((a, b, -w))
                for e in near.get(b, ()):
                    heapq.heappush(heap, e)
    return out


def spanning_forests(edges: DataFrame, scan: str) -> DataFrame:
    """(scan, parent, child, weight) for edges (scan, src, dst, weight); a scan's graph is one group."""
    kind = dict(edges.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = spanning_forest(list(pdf[["src", "dst", "weight"]].itertuples(index=False)), sorted({*pdf["src"], *pdf["dst"]}))
        return pd.DataFrame([(pdf[scan].iloc[0], *r) for r in rows], columns=[scan, "parent", "child", "weight"])

    return edges.select(scan, "src", "dst", "weight").groupBy(scan).applyInPandas(run, f"{scan} {kind[scan]}, parent {kind['src']}, child {kind['dst']}, weight {kind['weight']}")


def _rooted(links: DataFrame, part: str) -> DataFrame:
    """(part, node, root) of nodes that each point to one other of their part (part, node, to), where the only cycles are pairs: pointers are doubled until nothing moves. Of a pair the smaller is the root."""
    back = links.select(part, F.col("node").alias("to"), F.col("to").alias("__back"))
    now = links.join(back, [part, "to"], "left")
    pair = F.col("__back").eqNullSafe(F.col("node")) & (F.col("node") < F.col("to"))
    now = written(now.select(part, "node", F.when(pair, F.col("node")).otherwise(F.col("to")).alias("to")))
    while True:
        step = now.select(part, F.col("node").alias("to"), F.col("to").alias("__next"))
        new = written(now.join(step, [part, "to"], "left").select(part, "node", F.coalesce("__next", "to").alias("to"), (F.col("__next") != F.col("to")).alias("__moved")))
        now = new.select(part, "node", "to")
        if new.where("__moved").isEmpty():
            return now.withColumnRenamed("to", "root")


def forest_edges(edges: DataFrame, part: str) -> DataFrame:
    """(part, src, dst, weight) of the maximum spanning forest of each part's graph (part, src, dst, weight); of equal weights the lesser (src, dst) is better.

    Rounds of Boruvka: every component takes its best edge to another one (an aggregate), components that are so joined are
    contracted, and of the edges between two components only the best is kept. The number of components at least halves
    each round, and no part is gathered anywhere. Loops and edges with a null are left out; of parallel edges the best counts.
    """
    e = edges.select(part, "src", "dst", "weight").dropna().where("src <> dst")
    rank = F.struct((-F.col("weight")).alias("w"), F.col("src").alias("src"), F.col("dst").alias("dst"), F.col("weight").alias("weight"))
    live = written(e.select(part, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), rank.alias("best")).groupBy(part, "a", "b").agg(F.min("best").alias("best")))
    taken = []
    while not live.isEmpty():
        ends = live.select(part, F.col("a").alias("node"), F.col("b").alias("to"), "best").unionByName(live.select(part, F.col("b").alias("node"), F.col("a").alias("to"), "best"))
        pick = written(ends.groupBy(part, "node").agg(F.min(F.struct("best", "to")).alias("p")).select(part, "node", F.col("p.to").alias("to"), F.col("p.best").alias("best")))
        taken.append(pick.select(part, "best.src", "best.dst", "best.weight"))
        root = _rooted(pick.select(part, "node", "to"), part)
        live = live.join(root.select(part, F.col("node").alias("a"), F.col("root").alias("ra")), [part, "a"]).join(root.select(part, F.col("node").alias("b"), F.col("root").alias("rb")), [part, "b"])
        live = live.where("ra <> rb").groupBy(part, F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("best").alias("best"))
        live = written(live)
    if not taken:
        return edges.select(part, "src", "dst", "weight").limit(0)
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.distinct()


#: Of a block: its nodes, and the markers of all of them, about. Markers whose pairs are told one by one are those of fewer pairs than one in RARE; of the others so many are multiplied at once.
BLOCK_NODES, BLOCK_MARKERS, RARE, COLUMNS = 2_048, 2_000_000, 100, 1_024


def _common(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], n: int) -> np.ndarray:
    """How many of n markers each row on the left has in common with each on the right, of entries (row, marker): products of blocks of columns, and single pairs for rare markers."""
    out = np.zeros(shape, np.int32)
    counts = [np.bincount(m, minlength=n) for _, m in (left, right)]
    pairs = counts[0] * counts[1]
    if left is right:
        pairs[counts[0] == 1] = 0
    often = np.flatnonzero((pairs > 0) & (pairs * RARE >= shape[0] * shape[1]))
    seldom = np.flatnonzero((pairs > 0) & (pairs * RARE < shape[0] * shape[1]))
    place = np.full(n, -1)
    place[often], place[seldom] = np.arange(len(often)), len(often) + np.arange(len(seldom))
    sides = []
    for row, m in (left, right):
        order = np.argsort(place[m], kind="stable")
        at = place[m][order]
        sides.append((row[order], at, np.searchsorted(at, np.arange(len(often) + len(seldom) + 1))))
    for lo in range(0, len(often), COLUMNS):
        hi, dense = min(lo + COLUMNS, len(often)), []
        for (row, at, begins), rows in zip(sides, shape, strict=True):
            own = slice(begins[lo], begins[hi])
            x = np.zeros((rows, hi - lo), np.float32)
            x[row[own], at[own] - lo] = 1
            dense.append(x)
        out += (dense[0] @ dense[1].T).astype(np.int32)
    (a, _, i), (b, _, j) = sides
    for k in range(len(often), len(often) + len(seldom)):
        out[a[i[k] : i[k + 1], None], b[None, j[k] : j[k + 1]]] += 1
    return out


def _grown(weights: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, weight) of the maximum spanning forest of a matrix of weights, 0 for no edge; nodes are numbers, of rows in ``left`` and of columns in ``right`` (None: the same nodes). Of equal weights the lesser (src, dst) is better."""
    number = left if right is None else np.concatenate([left, right])
    n, size, top = len(number), int(number.max()) + 1, int(weights.max(initial=0))
    # An edge as one number: the lesser, the better.
    far = np.iinfo(np.int64).max
    best, there, taken, v = np.full(n, far), np.zeros(n, bool), [], 0
    for _ in range(n):
        there[v], best[v] = True, far
        to = slice(0, n) if right is None else slice(len(left), n) if v < len(left) else slice(0, len(left))
        w = weights[v] if v < len(left) else weights[:, v - len(left)]
        edge = ((top - w).astype(np.int64) * size + np.minimum(number[to], number[v])) * size + np.maximum(number[to], number[v])
        edge[(w == 0) | there[to]] = far
        np.minimum(best[to], edge, out=best[to])
        v = int(best.argmin())
        if best[v] < far:
            taken.append(best[v])
        else:  # another part of the graph begins
            v = int(there.argmin())
    e = np.array(taken, np.int64)
    return e // size % size, e % size, top - e // (size * size)


def shared_forest(df: DataFrame, part: str, node: str, markers: str) -> DataFrame:
    """(part, src, dst, weight) of the maximum spanning forest of each part's nodes, joined by as much weight as markers they share: ``forest_edges`` of all such pairs, which are not made as rows.

    df has a row for each node of a part, with the array of its different markers. A part's nodes are dealt into blocks of bounded size,
    and each two blocks are a task: it counts what their nodes share by products of matrices, and of these edges it gives only a
    spanning forest. An edge that is not in it closes a cycle of better ones, so it is in no larger forest either; what is left
    grows with the number of blocks, not of pairs, and ``forest_edges`` takes the forest of it. A node's markers are in one row.
    """
    x = written(df.select(part, F.col(node).alias("node"), F.col(markers).alias("markers")).dropna())
    blocks = x.groupBy(part).agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum(F.size("markers")) / BLOCK_MARKERS), F.lit(1)).cast("int").alias("__n"))
    own = x.join(blocks, part).withColumn("__own", F.pmod(F.xxhash64("node"), F.col("__n")).cast("int"))
    each = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    tasks = each.select(part, F.least("__own", "__other").alias("i"), F.greatest("__own", "__other").alias("j"), (F.col("__own") <= F.col("__other")).alias("left"), "node", "markers")
    kinds = [x.schema[part].dataType, x.schema["node"].dataType]
    out = StructType([StructField(part, kinds[0]), StructField("src", kinds[1]), StructField("dst", kinds[1]), StructField("weight", LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(pc.sort_indices(table["node"]))
        nodes, sets = table["node"].combine_chunks(), table["markers"].combine_chunks()
        codes = sets.flatten().dictionary_encode()
        marker, held = codes.indices.to_numpy(), pc.list_value_length(sets).to_numpy()
        row, left = np.repeat(np.arange(len(nodes)), held), table["left"].to_numpy()
        place = np.where(left, np.cumsum(left), np.cumsum(~left)) - 1
        sides, numbers = [], []
        for side in (left, ~left):
            mine = side[row]
            sides.append((place[row[mine]], marker[mine]))
            numbers.append(np.flatnonzero(side))
        whole = table["i"][0] == table["j"][0]
        if whole:
            sides[1] = sides[0]  # each row with each other one
        weights = _common(*sides, (len(numbers[0]), len(numbers[0] if whole else numbers[1])), len(codes.dictionary))
        if whole:
            np.fill_diagonal(weights, 0)
        src, dst, weight = _grown(weights, numbers[0], None if whole else numbers[1])
        return pa.table({part: pa.repeat(table[part][0], len(src)), "src": nodes.take(pa.array(src)), "dst": nodes.take(pa.array(dst)), "weight": pa.array(weight, pa.int64())})

    return forest_edges(tasks.groupBy(part, "i", "j").applyInArrow(run, out), part)


def propagated(roots: DataFrame, steps: DataFrame, compose) -> DataFrame:
    """(node, value): values carried from the roots (node, value) along tree edges (parent, child, value) until no node is new.

    One round per level of the tree; each round's frontier is written to the checkpoint folder. A tree has no more levels
    than edges: more rounds than that are an error, as the edges then hold a cycle.
    """
    from ..sources.files import ensure_checkpoints

    ensure_checkpoints(roots.sparkSession)
    done = frontier = roots.select("node", "value")
    most, levels = steps.count(), 0
    while True:
        step = steps.select(F.col("parent").alias("node"), "child", F.col("value").alias("by"))
        frontier = frontier.join(step, "node").select(F.col("child").alias("node"), compose(F.col("value"), F.col("by")).alias("value")).checkpoint()
        if frontier.isEmpty():
            return done
        levels += 1
        if levels > most:
            raise ValueError("the edges hold a cycle")
        done = done.unionByName(frontier)


def matmul3(a: Column, b: Column) -> Column:
    """Product of two 3x3 matrices as arrays of nine."""
    return F.array(*(sum((F.get(a, F.lit(3 * i + k)) * F.get(b, F.lit(3 * k + j)) for k in range(1, 3)), F.get(a, F.lit(3 * i)) * F.get(b, F.lit(j))) for i in range(3) for j in range(3)))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def _stack(vectors) -> np.ndarray:
    """Vectors of one length as rows."""
    rows = vectors.to_pylist()
    return np.array(rows, float).reshape(len(rows), -1)


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, float).reshape(len(rows), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int, digits: int) -> pa.RecordBatch:
    """The best k of the items for each of some queries."""
    s = np.round(q @ x.T, digits) + 0.0
    s[ids[:, None] == own[None]] = -np.inf
    take = min(k, s.shape[1])
    order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :take]
    value = np.take_along_axis(s, order, 1).ravel()
    ok = np.isfinite(value)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, take)[ok]), pa.array(own[order.ravel()][ok]), pa.array(value[ok])], ["query", "item", "similarity"])


#: Query rows that travel with the code, and rows of a block where there are more.
FEW_QUERIES, BLOCK_ROWS = 20_000, 5_000


def _in_blocks(queries: DataFrame, items: DataFrame, key: str, vector: str, f) -> DataFrame:
    """(query, item, similarity) that f(query ids, vectors, item ids, vectors) gives for blocks of queries and of items."""
    wanted = [F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")]
    queries, items = queries.select(*wanted), items.select(*wanted)
    out, n = "query long, item long, similarity double", queries.count()
    kinds = pa.schema([("query", pa.int64()), ("item", pa.int64()), ("similarity", pa.float64())])
    if n <= FEW_QUERIES:
        rows = queries.toArrow()
        ids, q = rows.column(0).to_numpy(), _stack(rows.column(1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, x = b.column(0).to_numpy(), _stack(b.column(1))
                for lo in range(0, len(q) if len(own) else 0, 512):
                    yield f(ids[lo : lo + 512], q[lo : lo + 512], own, x)

        return items.mapInArrow(run, out)
    q_blocks, i_blocks = -(-n // BLOCK_ROWS), max(1, -(-items.count() // BLOCK_ROWS))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = queries.select(F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("a"), every(i_blocks).alias("b"), "id", "v")
    i = items.select(every(q_blocks).alias("a"), F.pmod(F.xxhash64("id"), F.lit(i_blocks)).cast("int").alias("b"), "id", "v")

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, q, own, x = left["id"].to_numpy(), _stack(left["v"]), right["id"].to_numpy(), _stack(right["v"])
        return pa.Table.from_batches([f(ids[lo : lo + 512], q[lo : lo + 512], own, x) for lo in range(0, len(ids) if len(own) else 0, 512)], kinds)

    return q.groupBy("a", "b").cogroup(i.groupBy("a", "b")).applyInArrow(pair, out)


def products(queries: DataFrame, items: DataFrame, key: str, vector: str) -> DataFrame:
    """(query, item, similarity): the inner product of each query vector with each item vector, as products of blocks."""

    def all_of(ids, q, own, x):
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(own))), pa.array(np.tile(own, len(ids))), pa.array((q @ x.T).ravel())], ["query", "item", "similarity"])

    return _in_blocks(queries, items, key, vector, all_of)


def cosine_neighbours(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """(query, item, similarity, rank): the k items most alike to each query row, itself left out; ties by key.

    Blocks of queries are held against blocks of items as matrix products; each gives its own best k per query, and those are
    merged by a window per query. Up to ``FEW_QUERIES`` queries travel with the code and items are scanned where they are. Of more,
    both sides are dealt into blocks by a hash and every pair of blocks is a task: any number will do, and the driver sees none.
    """
    def best_of(ids, q, own, x):
        return _nearest(ids, _unit(q), own, _unit(x), k, digits)

    best = _in_blocks(queries, items, key, vector, best_of)
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "item")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reduced_counts(n: Column, share: float = 0.5) -> Column:
    """How many neighbours n points keep: ceil(n * share)."""
    return F.ceil(n * share).cast("long")


def attention(scores: Column, values: Column) -> Column:
    """Softmax-weighted mean of the values whose score is not null."""
    pairs = F.filter(F.arrays_zip(scores.alias("s"), values.alias("v")), lambda x: x["s"].isNotNull())
    top = F.array_max(F.transform(pairs, lambda x: x["s"]))
    weigh = lambda x: F.exp(x["s"] - top)
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + weigh(x))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + weigh(x) * x["v"]) / F.nullif(total, F.lit(0.0))
