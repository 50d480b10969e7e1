"""Catalog queries: names, kinds, resolutions, picks, generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns
from ..operators import catalog
from .registry import query

_N = "n AS (SELECT p_partkey, lower(p_name) AS name FROM part)"


@query(r"""SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS base, split_part(regexp_replace(url, '^[^:]*://', ''), '/', 1) AS head, url LIKE '%.html' AS is_html, regexp_matches(lower(url), '\.(html|htm)$') AS any_suffix FROM pages""")
def catalog_extract(t):
    """Parts of paths."""
    head, _ = columns.prefix_rest(F.regexp_replace("url", "^[^:]*://", ""))
    return t("pages").select("page_id", columns.basename(F.col("url")).alias("base"), head.alias("head"), F.col("url").endswith(".html").alias("is_html"), F.lower("url").rlike(r"\.(html|htm)$").alias("any_suffix"))


@query("""SELECT p_partkey, CASE WHEN contains(x, 'normal') THEN 'normal' WHEN contains(x, 'rough') THEN 'roughness' WHEN contains(x, 'disp') OR contains(x, 'height') THEN 'displacement' WHEN contains(x, 'ao') OR contains(x, 'ambientocclusion') THEN 'ao' WHEN contains(x, 'albedo') OR contains(x, 'basecolor') OR contains(x, '_col') OR contains(x, 'color') THEN 'basecolor' END AS kind
FROM (SELECT p_partkey, lower(p_name || '_' || CASE p_partkey % 6 WHEN 0 THEN 'Normal' WHEN 1 THEN 'ROUGHness' WHEN 2 THEN 'height' WHEN 3 THEN 'AO' WHEN 4 THEN 'Color' ELSE 'x' END) AS x FROM part)""")
def canonical_type(t):
    suffix = F.get(F.array(*map(F.lit, ("Normal", "ROUGHness", "height", "AO", "Color", "x"))), (F.col("p_partkey") % 6).cast("int"))
    return t("part").select("p_partkey", catalog.canonical_map(F.concat_ws("_", "p_name", suffix)).alias("kind"))


@query("SELECT p_partkey, CAST(nullif(regexp_extract(upper(p_name || '_' || p_size || 'k-png'), '([0-9]{1,2})K[_.-]', 1), '') AS INT) AS res FROM part")
def resolution_of_name(t):
    return t("part").select("p_partkey", catalog.resolution(F.concat("p_name", F.lit("_"), "p_size", F.lit("k-png"))).alias("res"))


@query("""WITH x AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS seq, l_shipdate, l_returnflag AS label, CAST(l_extendedprice * 100 AS BIGINT) AS size FROM lineitem),
u AS (SELECT l_partkey, seq, min(label) AS label, max(size) AS size FROM x GROUP BY l_partkey, seq), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY label <> 'R', CASE WHEN label = 'R' THEN seq END, size DESC, seq) AS n FROM u)
SELECT l_partkey, seq, label, size FROM r WHERE n = 1""")
def resolution_pick(t):
    """The first preferred file, else the largest."""
    x = t("lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("label"), F.expr("CAST(round(l_extendedprice * 100) AS BIGINT)").alias("size"))
    u = x.groupBy("l_partkey", "seq").agg(F.min("label").alias("label"), F.max("size").alias("size"))
    return catalog.resolution_pick(u, "l_partkey", "seq", "label", "size", ["R"])


@query("SELECT p_brand, min(p_partkey) AS first_seq, count(*) AS n FROM part GROUP BY p_brand ORDER BY first_seq LIMIT 10")
def grouped_assets(t):
    """The first ten brands in order of appearance (a report of the first)."""
    g = catalog.grouped_assets(t("part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey", 10)
    return g.select("p_brand", "first_seq", F.size("files").cast("long").alias("n"))


_KINDS = ["ring", "widget", "bolt", "gear"]


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'widget') THEN 'widget' WHEN contains(p_name, 'bolt') THEN 'bolt' WHEN contains(p_name, 'gear') THEN 'gear' ELSE 'other' END AS kind, contains(p_name, 'red') OR contains(p_name, 'blue') AS tinted FROM part")
def type_lookup(t):
    """Kind by ordered containment, and any-keyword containment."""
    named = F.when(catalog.any_keyword(F.col("p_name"), _KINDS), F.col("p_name")).otherwise(F.lit("other"))
    return t("part").select("p_partkey", catalog.object_kind(named, [*_KINDS, "other"]).alias("kind"), catalog.any_keyword(F.col("p_name"), ["red", "blue"]).alias("tinted"))


@query("""WITH p AS (SELECT n_nationkey, unnest(generate_series(0, 2)) AS pass FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY CASE WHEN pass = 0 THEN '' ELSE md5(n_nationkey || '|' || pass || '|5') END, n_nationkey) - 1 + pass * 25 AS pick FROM p)
SELECT pick, CAST(pass AS INT) AS pass, n_nationkey FROM r""")
def epochal_order(t):
    """Sorted first pass, then each pass in an order of its own."""
    return catalog.epochal_order(t("nation"), "n_nationkey", 3, 5)


@query("SELECT l_orderkey, l_linenumber, (l_partkey + 15) & ~15 AS aligned, replace('part {n} of it', '{n}', CAST(l_partkey AS VARCHAR)) AS text FROM lineitem")
def align_and_fill(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", columns.align_up(F.col("l_partkey"), 16).alias("aligned"), columns.fill(F.lit("part {n} of it"), F.col("l_partkey")).alias("text"))


@query("WITH x AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(list_position(q, list_min(q)) - 1 AS BIGINT) AS argmin, q[1] AS first, CAST(len(q) AS INT) AS n FROM x")
def array_functions(t):
    q = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"])
    x = t("lineitem").groupBy("l_orderkey").agg(q.alias("q"))
    return x.select("l_orderkey", columns.argmin(F.col("q")).alias("argmin"), F.get("q", F.lit(0)).alias("first"), F.size("q").alias("n"))
