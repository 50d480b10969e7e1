"""Dataset assembly, order, splits, batches, seeded augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import mask_after, pad_truncate
from ..operators import dataset
from ..operators.augment import Flip, RandomCrop
from ..operators.rng import uniform, uniform_between, uniform_size, uniform_sql
from .registry import query

SEED = 7
BATCH = 16


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def multi_key_assembly(t):
    """Samples that have a file under every key."""
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id")


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, p.p_brand, s.s_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey")
def four_way_feature_join(t):
    """Inner join of four inputs."""
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return (
        l.join(t("orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "l_linenumber", "o_orderstatus", "p_brand", "s_name")
    )


@query("SELECT d.doc_id, l.quality, b.item_id, b.item_id IS NOT NULL AS has_item FROM documents d JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def optional_side_join(t):
    """Required sides inner, an optional one null."""
    b = t("benchmark").select("item_id")
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id").join(b, F.col("doc_id") == F.col("item_id"), "left").select("doc_id", "quality", "item_id", F.col("item_id").isNotNull().alias("has_item"))


_ORDERED = f"SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|{SEED}'), doc_id) - 1 AS entry_idx, count(*) OVER () AS n FROM documents"


@query(f"WITH e AS ({_ORDERED}) SELECT doc_id, entry_idx, CASE WHEN entry_idx < floor(0.8 * n + 0.5) THEN 'train' WHEN entry_idx < floor(0.8 * n + 0.5) + floor(0.1 * n + 0.5) THEN 'valid' ELSE 'test' END AS part FROM e")
def prefix_split(t):
    """Seeded order, then prefixes."""
    d = dataset.Dataset(t("documents").select("doc_id"), "doc_id", SEED)
    return dataset.split(d.entries, len(d), 0.8, 0.1).select("doc_id", "entry_idx", "part")


@query(f"""WITH e AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '|{SEED}'), o_orderkey) - 1 AS entry_idx, count(*) OVER () AS n FROM orders),
b AS (SELECT unnest(generate_series(0, CAST(ceil((SELECT count(*) FROM orders) / {BATCH}.0) AS BIGINT) * {BATCH} * 2 - 1)) AS i)
SELECT i // {BATCH} AS batch_id, (i // {BATCH}) * {BATCH} AS start_offset, CAST(i % {BATCH} AS INT) AS pos, o_orderkey FROM b JOIN e ON e.entry_idx = i % n""")
def cyclic_batches(t):
    """Two epochs of batches; the last batch of the first wraps and the cursor does not realign."""
    d = dataset.Dataset(t("orders").select("o_orderkey"), "o_orderkey", SEED)
    count = 2 * dataset.n_batches(len(d), BATCH)
    return d.batches(BATCH, 0, count).select("batch_id", "start_offset", "pos", "o_orderkey")


@query(f"SELECT part, count(*) AS n, CAST(ceil(count(*) / {BATCH}.0) AS BIGINT) AS n_batches FROM (WITH e AS ({_ORDERED}) SELECT CASE WHEN entry_idx < floor(0.8 * n + 0.5) THEN 'train' WHEN entry_idx < floor(0.8 * n + 0.5) + floor(0.1 * n + 0.5) THEN 'valid' ELSE 'test' END AS part FROM e) GROUP BY part")
def batches_per_part(t):
    d = dataset.Dataset(t("documents").select("doc_id"), "doc_id", SEED)
    return dataset.split(d.entries, len(d), 0.8, 0.1).groupBy("part").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BATCH).alias("n_batches"))


_OFFSET = f"(event_id // {BATCH}) * {BATCH}"


@query(f"SELECT event_id, {uniform_sql(_OFFSET, 0)} <= 0.5 AS flip_v, {uniform_sql(_OFFSET, 1)} <= 0.25 AS flip_h FROM events")
def seeded_flip(t):
    """Parameters of a flip, one draw for a batch."""
    off = F.floor(F.col("event_id") / BATCH) * BATCH
    p = Flip(0.5, 0.25).params(off, F.lit(64), F.lit(48))
    return t("events").select("event_id", *(c.alias(k) for k, c in p.items()))


@query(f"""WITH u AS (SELECT event_id, {uniform_sql(_OFFSET, 0)} AS u0, {uniform_sql(_OFFSET, 2)} AS u2, {uniform_sql(_OFFSET, 3)} AS u3 FROM events),
s AS (SELECT *, 16 + CAST(floor(u0 * 32) AS BIGINT) AS height, 8 + CAST(floor(u0 * 24) AS BIGINT) AS width FROM u)
SELECT event_id, height, width, CAST(floor(u2 * (64 - height - 1)) AS BIGINT) AS top, CAST(floor(u3 * (48 - width - 1)) AS BIGINT) AS "left" FROM s""")
def seeded_crop(t):
    """Parameters of a random crop; height and width share a draw."""
    off = F.floor(F.col("event_id") / BATCH) * BATCH
    h, w = uniform_between(off, 0, 16, 48), uniform_between(off, 0, 8, 32)
    return t("events").select("event_id", h.alias("height"), w.alias("width"), uniform_size(off, 2, 64 - h).alias("top"), uniform_size(off, 3, 48 - w).alias("left"))


@query(f"SELECT event_id AS idx, round({uniform_sql('event_id', 0)}, 12) AS a, round({uniform_sql('event_id', 5)}, 12) AS b FROM events")
def seeded_generator(t):
    return t("events").select(F.col("event_id").alias("id")).select(F.col("id").alias("idx"), F.round(uniform(F.col("id"), 0), 12).alias("a"), F.round(uniform(F.col("id"), 5), 12).alias("b"))


def _points(t):
    """Each vector as 32 points on a 100 by 80 raster."""
    at = lambda i: F.get("embedding", i).cast("double")
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.floor(F.abs(at(2 * i)) * 1000 % 100).cast("long").alias("r"), F.floor(F.abs(at(2 * i + 1)) * 1000 % 80).cast("long").alias("c")))
    return t("embeddings").select("vec_id", pts.alias("pts"))


_POINTS_SQL = "p AS (SELECT vec_id, i, CAST(floor(abs(embedding[2 * i + 1]::DOUBLE) * 1000 % 100) AS BIGINT) AS r, CAST(floor(abs(embedding[2 * i + 2]::DOUBLE) * 1000 % 80) AS BIGINT) AS c FROM embeddings, (SELECT unnest(generate_series(0, 31)) AS i))"


def _exploded(df):
    return df.select("vec_id", F.posexplode("pts").alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), "p.r", "p.c")


@query(f"WITH {_POINTS_SQL} SELECT vec_id, i, CASE WHEN {uniform_sql('vec_id', 0)} <= 0.5 THEN 99 - r ELSE r END AS r, CASE WHEN {uniform_sql('vec_id', 1)} <= 0.5 THEN 79 - c ELSE c END AS c FROM p")
def points_flip(t):
    s = Flip(0.5, 0.5)
    df = _points(t).withColumn("p", F.struct(*(c.alias(k) for k, c in s.params(F.col("vec_id"), F.lit(100), F.lit(80)).items())))
    return _exploded(df.withColumn("pts", F.transform("pts", lambda x: s.point(x, F.col("p"), F.lit(100), F.lit(80)))))


@query(f"""WITH {_POINTS_SQL}, u AS (SELECT *, {uniform_sql('vec_id', 0)} AS u0, {uniform_sql('vec_id', 2)} AS u2, {uniform_sql('vec_id', 3)} AS u3 FROM p),
s AS (SELECT *, 20 + CAST(floor(u0 * 40) AS BIGINT) AS h, 10 + CAST(floor(u0 * 30) AS BIGINT) AS w FROM u)
SELECT vec_id, i, r - CAST(floor(u2 * (100 - h - 1)) AS BIGINT) AS r, c - CAST(floor(u3 * (80 - w - 1)) AS BIGINT) AS c FROM s""")
def points_crop(t):
    s = RandomCrop(20, 10, 60, 40)
    df = _points(t).withColumn("p", F.struct(*(c.alias(k) for k, c in s.params(F.col("vec_id"), F.lit(100), F.lit(80)).items())))
    return _exploded(df.withColumn("pts", F.transform("pts", lambda x: s.point(x, F.col("p"), F.lit(100), F.lit(80)))))


@query(f"WITH {_POINTS_SQL} SELECT vec_id, i, CAST(floor(r * 48 / 100) AS BIGINT) AS r, CAST(floor(c * 36 / 80) AS BIGINT) AS c FROM p")
def points_resize(t):
    """Integer points are cut off after scaling."""
    move = lambda x: F.struct(F.floor(x["r"] * 48 / 100).alias("r"), F.floor(x["c"] * 36 / 80).alias("c"))
    return _exploded(_points(t).withColumn("pts", F.transform("pts", move)))


@query(f"WITH {_POINTS_SQL}, k AS (SELECT vec_id, i, r, c, vec_id % 9 AS len FROM p WHERE i < 8) SELECT vec_id, i, CASE WHEN i < len THEN r ELSE 0 END AS r, CASE WHEN i < len THEN c ELSE 0 END AS c, CAST(len AS INT) AS pts_len FROM k")
def points_ragged(t):
    """Lists of 0 to 8 points padded with zeros to 8, and their true lengths."""
    zero = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"))
    df = _points(t).withColumn("pts", F.slice("pts", 1, (F.col("vec_id") % 9).cast("int")))
    df = df.withColumns({"pts_len": F.size("pts"), "pts": pad_truncate(F.col("pts"), 8, zero)})
    return df.select("vec_id", "pts_len", F.posexplode("pts").alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), "p.r", "p.c", "pts_len")


@query("SELECT vec_id, i AS pos, CASE WHEN i < label + 1 THEN round(embedding[i + 1]::DOUBLE, 6) ELSE -2.0 END AS v FROM embeddings, (SELECT unnest(generate_series(0, 7)) AS i)")
def pad_truncate_mask(t):
    """The first eight values; positions beyond a count masked."""
    xs = pad_truncate(F.transform("embedding", lambda x: x.cast("double")), 8)
    return t("embeddings").select("vec_id", F.posexplode(mask_after(xs, F.col("label") + 1, -2.0)).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


@query("SELECT n AS total, count(*) AS ways, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 9) AS chance FROM (SELECT l_partkey % 6 + l_suppkey % 6 + 2 AS n FROM lineitem) GROUP BY n")
def dice_distribution(t):
    """How often two dice, thrown by each line's part and supplier, show each total."""
    d = t("lineitem").select((F.col("l_partkey") % 6 + F.col("l_suppkey") % 6 + 2).alias("total"))
    ways = d.groupBy("total").agg(F.count("*").alias("ways"))
    return ways.crossJoin(F.broadcast(ways.agg(F.sum("ways").alias("all")))).select("total", "ways", F.round(F.col("ways") / F.col("all"), 9).alias("chance"))


@query("SELECT 'parts' AS part, count(*) AS n, 1::BIGINT AS most_parts, count(*) AS n_keys FROM documents UNION ALL SELECT 'train', CAST(floor(0.8::DOUBLE * count(*) + 0.5) AS BIGINT), 1, CAST(floor(0.8::DOUBLE * count(*) + 0.5) AS BIGINT) FROM documents")
def no_leakage(t):
    """No entry is in two parts of a split, and none is lost: entries, the most parts that one is in, distinct keys; of all parts and of the first."""
    d = dataset.Dataset(t("documents").select("doc_id"), "doc_id", SEED)
    parts = d.split_train_validation_test(0.8, 0.1)
    both = parts[0].entries.select("doc_id", F.lit("train").alias("part"))
    for name, p in zip(("valid", "test"), parts[1:], strict=True):
        both = both.unionByName(p.entries.select("doc_id", F.lit(name).alias("part")))
    per_key = lambda df: df.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("part").alias("k")).agg(F.sum("n").alias("n"), F.max("k").alias("most_parts"), F.count("*").alias("n_keys"))
    return per_key(both).select(F.lit("parts").alias("part"), "*").unionByName(per_key(both.where("part = 'train'")).select(F.lit("train").alias("part"), "*"))
