"""Conversation prefix trie, built level by level.

Turns of a conversation stand in order of turn (null first), then of the digest of
role and text; a null role or text is empty. A turn is its digest (SHA-256 of
role and text), so texts are read once and never shuffled. Positions are two-level:
rows are dealt by range, numbered in their part, and the few conversations that
run over a border (one for each part at most) get what stands before it.

Per depth the live conversations are grouped by (parent node, next turn); a
node is named by its depth and the smallest conv_id in it. Nodes with more than
1/``HEAVY`` of all conversations, fewer than ``HEAVY`` at a depth, are given
back to their members by broadcast, the others by a shuffled join. A
conversation that is alone in its node is live no longer: what follows is a chain
and is read off its turns. So there are as many rounds as the longest prefix
that two conversations share has turns, each over the live ones alone.

Then the levels are joined from the deepest up: every node adds up its
children's leaves and savings. What a node saves is its text's words for every
member but one.

The hash of the conversations that end in a node runs over their ids in order.
Ids are sorted in bundles of an aligned range of ``1 << BUNDLE`` ids, and
bundles stream through the hash in order, so no group is held; SHA-256 itself
is sequential, so the bundles of one node pass one task.

Rows without conv_id belong to no conversation and are left out; rows that are
equal throughout are as many turns. An empty table has no node, not even a root.
Columns beside conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import words_in
from .scratch import Scratch, bounded_batches

HEAVY, BUNDLE = 512, 12
NOTHING = hashlib.sha256().hexdigest()


def turn_digest() -> Column:
    """SHA-256 of role and text, told apart by the role's length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return F.unhex(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``own``: the place from 1 of a row in its run of equal conv_id, over all batches of a part."""
    last, before = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        own = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv)))) + 1
        if last == conv[0]:
            own[: starts[1] if len(starts) > 1 else len(conv)] += before
        last, before = conv[-1], int(own[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], [*b.schema.names, "own"])


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, digest, n_words) of every turn, places from 1, and (conv_id, n): the number of turns."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest().alias("digest"), words_in().alias("n_words"))
    rows = scratch.write(rows.where("conv_id is not null"), "turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_words", F.spark_partition_id().alias("part"))
    dealt = scratch.write(dealt.mapInArrow(_numbered, "conv_id long, digest binary, n_words long, part int, own long"), "numbered")
    counts = scratch.write(dealt.groupBy("conv_id", "part").agg(F.max("own").alias("n")), "counts")
    line = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = counts.withColumn("before", F.sum("n").over(line)).where("before is not null").select("conv_id", "part", "before")
    # A part begins in the middle of one conversation at most.
    placed = dealt.join(F.broadcast(later), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "n_words"), counts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def plain_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, n_words, length) of every turn as it stands, and (conv_id, length)."""
    turns, convs = ordered_turns(conversations, scratch)
    convs = scratch.write(convs.withColumnRenamed("n", "length"), "lengths")
    return turns.withColumnRenamed("place", "depth").join(convs, "conv_id"), convs


def rebuilt_turns(conversations: DataFrame, scratch: Scratch, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """As plain_turns, of conversations that begin like the first of their block.

    Conversation c takes the first h turns (all if fewer, none if absent) of conversation c - c % block, then its own after
    its first h, where h = crc32(decimal c) % heads. A conversation may so come to have no turn: its length is 0.
    """
    turns, convs = ordered_turns(conversations, scratch)
    turns, convs = scratch.write(turns, "places"), scratch.write(convs, "sizes")
    of = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, "base": F.col("conv_id") - F.col("conv_id") % block})
    of = of.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    of = of.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    of = scratch.write(of.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "lengths")
    own = turns.join(of, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "n_words", "length")
    first = turns.where((F.col("conv_id") % block == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    first = first.join(of, "base").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "digest", "n_words", "length")
    return own.unionByName(first), of.select("conv_id", "length")


def _members(live: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """(conv_id, node, length) of the live rows (conv_id, parent, digest, length) whose node is shared: heavy nodes by broadcast."""
    key = ["parent", "digest"]
    heavy = F.broadcast(shared.where(F.col("n_convs") * HEAVY > total).select(*key, "node"))
    light = shared.where(F.col("n_convs") * HEAVY <= total).select(*key, "node")
    both = live.join(heavy, key).unionByName(live.join(heavy, key, "left_anti").join(light, key))
    return both.select("conv_id", "node", "length")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, node, ends_sha256) of sorted bundles (depth, node, bundle, ids)."""
    now, h = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([h.hexdigest()])], ["depth", "node", "ends_sha256"])

    for b in batches:
        for depth, node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
            if (depth, node) != now:
                if now is not None:
                    yield row()
                now, h = (depth, node), hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.as_buffer())
    if now is not None:
        yield row()


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of (depth, node, conv_id): the hash of a node's ids in ascending order, joined by commas."""
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    bundles = ends.groupBy("depth", "node", F.shiftright("conv_id", BUNDLE).alias("bundle")).agg(ids.alias("ids"))
    bundles = bundles.repartition("depth", "node").sortWithinPartitions("depth", "node", "bundle")
    return bundles.mapInArrow(_hashed, "depth long, node long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie of turns (conv_id, depth, digest, n_words, length), depths from 1, and convs (conv_id, length).

    A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 and turn_sha256 (of its last turn; the root has none).
    """
    # Sorted by depth, so that a level's scan passes over the pages of the others.
    turns = scratch.write(turns.sortWithinPartitions("depth"), "by-depth")
    whole = "node long, parent long, digest binary, n_convs long, n_words long"
    none = F.lit(None)
    root = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = scratch.write(root.select("node", none.cast("long").alias("parent"), none.cast("binary").alias("digest"), "n_convs", F.lit(0).cast("long").alias("n_words")), "nodes/depth=0")
    if not (top := root.first()):
        return _result(scratch, turns, None)
    total = top.n_convs
    here = scratch.write(convs.select("conv_id", F.lit(top.node).cast("long").alias("node"), "length"), "members/depth=0")
    depth = 0
    while True:
        depth += 1
        next_turns = turns.where(F.col("depth") == depth).select("conv_id", "digest", "n_words")
        live = scratch.write(here.where(F.col("length") >= depth).withColumnRenamed("node", "parent").join(next_turns, "conv_id"), f"live-{depth}")
        nodes = live.groupBy("parent", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"))
        nodes = scratch.write(nodes.select("node", "parent", "digest", "n_convs", "n_words"), f"nodes/depth={depth}")
        shared = nodes.where("n_convs > 1")
        if shared.isEmpty():
            scratch.drop(f"live-{depth}")
            break
        here = scratch.write(_members(live, shared, total), f"members/depth={depth}")
        scratch.drop(f"live-{depth}")
    kids = None
    for d in range(depth, -1, -1):
        level = scratch.spark.read.schema(whole).parquet(f"{scratch.base}/nodes/depth={d}")
        own = (F.col("n_convs") - 1) * F.col("n_words")
        # The root is never a chain, even of one conversation.
        alone = F.col("n_convs") == 1 if d else F.lit(False)
        if kids is None:
            up = level.select("node", "parent", "digest", "n_convs", F.lit(0).alias("n_children"), F.lit(1).alias("n_leaves"), own.alias("saved_tokens"))
        else:
            up = level.where(~alone).join(kids, F.col("node") == F.col("kids_of"), "left")
            zero = lambda c, least=0: F.coalesce(F.col(c), F.lit(least))
            up = up.select("node", "parent", "digest", "n_convs", zero("kids").alias("n_children"), zero("leaves", 1).alias("n_leaves"), (own + zero("saved")).alias("saved_tokens"))
            up = scratch.write(up, f"rolled/depth={d}")
            up = up.unionByName(level.where(alone).select("node", "parent", "digest", "n_convs", F.lit(0).alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens")))
        kids = up.groupBy(F.col("parent").alias("kids_of")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    return _result(scratch, turns, depth)


def _result(scratch: Scratch, turns: DataFrame, depth: int | None) -> DataFrame:
    """All nodes: those of several conversations as rolled up, and the chains below nodes of one."""

    def table(name: str, schema: str) -> DataFrame:
        if depth is None:
            return scratch.spark.createDataFrame([], f"{schema}, depth long")
        return scratch.spark.read.schema(f"{schema}, depth long").parquet(f"{scratch.base}/{name}")

    members = table("members", "conv_id long, node long, length long")
    hashes = ends_hashes(members.where("length = depth").select("depth", "node", "conv_id")).withColumnRenamed("depth", "at")
    nodes = table("rolled", "node long, parent long, digest binary, n_convs long, n_children long, n_leaves long, saved_tokens long")
    nodes = nodes.join(hashes.withColumnRenamed("node", "of"), (F.col("at") == F.col("depth")) & (F.col("of") == F.col("node")), "left")
    nodes = nodes.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), F.lower(F.hex("digest")).alias("turn_sha256"))
    alone = table("nodes", "node long, parent long, digest binary, n_convs long, n_words long").where("n_convs = 1 and depth > 0")
    chains = turns.join(alone.select(F.col("node").alias("conv_id"), F.col("depth").alias("start"), "parent"), "conv_id").where("depth >= start")
    last = F.col("depth") == F.col("length")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = chains.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NOTHING).alias("ends_sha256"), F.lower(F.hex("digest")).alias("turn_sha256"),
    )
    return nodes.unionByName(chains)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that rebuilt_turns makes."""
    scratch = Scratch(conversations.sparkSession)
    bounded_batches(conversations.sparkSession)
    return prefix_trie(*rebuilt_turns(conversations, scratch), scratch)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand."""
    scratch = Scratch(conversations.sparkSession)
    return prefix_trie(*plain_turns(conversations, scratch), scratch)


#: CRC-32 without its last inversion, bit by bit.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, 1 + length(c::VARCHAR)), lambda i: [ascii(substr(c::VARCHAR, i::BIGINT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, b: xor(xor(x, b) >> 1::BIGINT, CASE WHEN xor(x, b) % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))"""

ORACLE = r"""
WITH t AS (SELECT conv_id AS c, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS dig, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'g': dig, 'w': w} ORDER BY turn NULLS FIRST, dig) AS own FROM t GROUP BY c),
h AS (SELECT c, own, xor(CRC, 4294967295) % 4 AS h FROM o),
b AS (SELECT a.c, list_concat(coalesce(f.own[1:a.h], []), a.own[a.h + 1:]) AS seq FROM h a LEFT JOIN o f ON f.c = a.c - a.c % 20),
n AS (SELECT c, d, list_transform(seq[1:d], lambda x: x.g) AS path, len(seq) = d AS done, CASE WHEN d > 0 THEN seq[d].w ELSE 0 END AS w FROM (SELECT c, seq, unnest(generate_series(0, len(seq))) AS d FROM b)),
g AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE done), '') AS ends FROM n GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS up, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
m AS (SELECT g.*, coalesce(k.n, 0) AS kids FROM g LEFT JOIN k ON k.up = g.path),
s AS (SELECT a.path, sum(CASE WHEN z.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((z.n_convs - 1) * z.w) AS saved FROM (SELECT path[1:u] AS path, kids, n_convs, w FROM (SELECT *, unnest(generate_series(0, d)) AS u FROM m)) z JOIN m a ON a.path = z.path GROUP BY a.path)
SELECT m.conv_id, m.d AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.kids AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256, CASE WHEN m.d > 0 THEN m.path[m.d] END AS turn_sha256
FROM m JOIN s ON s.path = m.path LEFT JOIN m p ON m.d > 0 AND p.d = m.d - 1 AND p.path = m.path[1:m.d - 1]""".replace("CRC", _CRC)
