"""Vector and graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import graph
from .registry import query

_DOT = "list_sum(list_transform(generate_series(1, 64), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_COS = f"round({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}), 6)"


@query(f"SELECT query, item, rank FROM (SELECT a.vec_id AS query, b.vec_id AS item, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 5")
def cosine_topk(t):
    """The five vectors most alike to each query vector (ids divisible by 100), against all rows."""
    e = t("embeddings")
    return graph.cosine_neighbours(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5).select("query", "item", "rank")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0")
def similarity_matrix(t):
    """Products of the query vectors (ids divisible by 100) with all vectors."""
    e = t("embeddings")
    got = graph.products(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding")
    return got.select(F.col("query").alias("a"), F.col("item").alias("b"), F.round("similarity", 6).alias("similarity"))


@query("SELECT label, count(*) AS n, CAST(ceil(count(*) * 0.5) AS BIGINT) AS k FROM embeddings GROUP BY label")
def reduced_counts(t):
    return t("embeddings").groupBy("label").agg(F.count("*").alias("n")).withColumn("k", graph.reduced_counts(F.col("n")))


@query("SELECT vec_id, label, CAST(rank AS INT) AS rank FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 6) DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 10")
def top_keypoints(t):
    """The ten best of each group by score."""
    w = Window.partitionBy("label").orderBy(F.round(F.get("embedding", F.lit(0)).cast("double"), 6).desc(), "vec_id")
    return t("embeddings").select("vec_id", "label", F.row_number().over(w).alias("rank")).where("rank <= 10")


@query("WITH x AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS weight FROM x a JOIN x b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL")
def overlap_graph(t):
    """Suppliers that share parts."""
    return graph.overlap_edges(t("lineitem"), "l_suppkey", "l_partkey")


@query()
def spanning_tree(t):
    """A maximum spanning forest of each region's nations, joined by shared customers' segments and balances; tests hold it against Kruskal's."""
    c = t("customer").select(F.col("c_nationkey"), F.floor(F.col("c_acctbal") / 50).alias("band"))
    n = t("nation").select("n_nationkey", "n_regionkey")
    c = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    x = c.select("n_regionkey", "c_nationkey", "band").distinct()
    e = x.select("n_regionkey", "band", F.col("c_nationkey").alias("src")).join(x.select("n_regionkey", "band", F.col("c_nationkey").alias("dst")), ["n_regionkey", "band"]).where("src < dst")
    e = e.groupBy("n_regionkey", "src", "dst").agg(F.count("*").alias("weight"))
    return graph.spanning_forests(e, "n_regionkey")


@query("""WITH RECURSIVE r AS (SELECT 0::BIGINT AS node, 1::BIGINT AS value UNION ALL SELECT s.s_suppkey, (r.value * 3 + s.s_suppkey) % 1000003 FROM r JOIN supplier s ON s.s_suppkey > 0 AND (s.s_suppkey - 1) // 2 = r.node) SELECT node, value FROM r""")
def transform_propagation(t):
    """Values carried from the root along the edges of a tree, a level in each round."""
    s = t("supplier").where("s_suppkey > 0").select(F.floor((F.col("s_suppkey") - 1) / 2).alias("parent"), F.col("s_suppkey").alias("child"), F.col("s_suppkey").alias("value"))
    root = t.spark.range(1).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("value"))
    return graph.propagated(root, s, lambda value, by: (value * 3 + by) % 1000003)


@query("SELECT vec_id, i AS pos, round(embedding[i + 1]::DOUBLE, 3) + 0.0 AS v FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i)")
def codec_roundtrip(t):
    """Vectors through the lossless codec (shuffled, zstd) and back."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    back = codec.decompress_column(codec.compress_column(e, codec.Options(half=False)))
    return back.select(F.col("id").alias("vec_id"), F.posexplode("values").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round(F.col("v").cast("double"), 3) + 0.0).alias("v"))


@query()
def codec_sizes(t):
    """Bytes before and after with half precision, and the ratio."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    s = codec.compress_column(e, codec.Options())
    return s.agg(F.sum("raw_bytes").alias("raw"), F.sum("packed_bytes").alias("packed")).withColumn("ratio", F.col("packed") / F.greatest(F.col("raw"), F.lit(1)))


@query("SELECT vec_id, round(list_sum(list_transform(generate_series(1, 32), lambda i: abs(embedding[i]::DOUBLE - embedding[i + 32]::DOUBLE))) / (32 * 255.0), 9) AS diff FROM embeddings")
def frame_difference(t):
    """Normalised absolute difference of two halves of a vector."""
    from ..operators.series import frame_difference as diff

    e = t("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("a"), F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double")).alias("b"))
    return e.select("vec_id", F.round(diff("a", "b", 32), 9).alias("diff"))
