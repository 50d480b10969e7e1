"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Sources in code-point order, null last, weigh 1, 2, 3, repeating. They share
the words of all documents by weight; no target exceeds ``CAP`` times its
source's words, and the excess goes to the others, in rounds of one aggregate
until no target is above. Every document of a source is expected
target / source_size times. Documents stand in line by class of size, chunk,
size, doc_id and hashes of the text and the row; the running sum of expected
copies plus one offset per source crosses a number of integers at each document,
and that many copies are taken: the floor or the ceiling of the expectation, so
at most CAP.

The running sum is two-level: a table of chunks is summed per source, then each
chunk numbers its own rows. A source of more than ``CHUNK`` documents is dealt
into chunks of about as many by a hash of doc_id, so a hot source or a hot size
is many chunks and the table has at most a chunk for each source and class of
size and one for each ``CHUNK`` rows and class. Ranks of sources, which may be
many, are two-level as well.

Null or empty text has size 0 and follows the same rule; a null doc_id sorts
first in chunk 0; a source without words has target 0; rows with equal doc_id
are separate rows in line, and where they are equal throughout they are
interchangeable. All is a function of the rows alone: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, row_hash, text_hash, whole_row

CAP = 3
CHUNK = 8192
WORD = r"[^\x20\x09-\x0D]+"


def words_in(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources with their position from 1 in code-point order, null last: ranges of sources are counted, then numbered each for itself."""
    order = F.col("source").asc_nulls_last()
    parts = scratch.write(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.withColumn("own", own).join(F.broadcast(before), "part").withColumn("position", (F.col("before") + F.col("own")).cast("long")).drop("part", "before", "own")


def targets(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, n, source_size) -> also position, weight and target. Each round shares what is left by weight and fills the sources that it would lift above their cap."""
    s = scratch.write(ranked(sources, scratch).withColumn("weight", (F.col("position") - 1) % 3 + 1), "sources")
    size = F.col("source_size")
    words = s.agg(F.sum(size)).first()[0] or 0
    level, filled = 0.0, -1
    while True:
        # Sources once filled stay so: the level never falls.
        full = F.lit(False) if filled < 0 else CAP * size.cast("double") <= F.col("weight") * F.lit(level)
        r = s.agg(F.count_if(full).alias("n"), F.sum(F.when(full, size)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if r.n == filled or not r.weights:
            return s.withColumn("target", F.when(full, CAP * size.cast("double")).otherwise(F.col("weight") * F.lit(level)))
        filled, level = r.n, float(words - CAP * (r.held or 0)) / float(r.weights)


def mix_sources(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies): row holds all columns of docs, whatever their names."""
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in().alias("size"), text_hash().alias("text_hash"), row_hash(docs).alias("row_hash"))
    keyed = keyed.withColumns(
        {"class": F.length(F.bin("size")), "place": F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2147483647)) * 48271, F.lit(2147483647))}
    )
    narrow = scratch.write(keyed.groupBy("source", "class", "place").agg(F.count("*").alias("n"), F.sum("size").alias("s")), "sizes")
    of = scratch.write(targets(narrow.groupBy("source").agg(F.sum("n").alias("n"), F.sum("s").alias("source_size")), scratch), "targets")
    hot = of.where(F.col("n") > CHUNK).select(F.col("source").alias("hot"), F.ceil(F.col("n") / F.lit(float(CHUNK))).cast("long").alias("chunks"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(hot, F.col("source").eqNullSafe(F.col("hot")), "left").withColumn("chunk", F.coalesce(F.col("place") % F.col("chunks"), F.lit(0))).drop("hot", "chunks", "place")

    chunks = dealt(narrow).groupBy("source", "class", "chunk").agg(F.sum("n").alias("n"))
    line = Window.partitionBy("source").orderBy("class", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0)))
    of = of.withColumns(
        {
            "rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0),
            "offset": (F.pmod((F.col("position") + seed) * 48271, F.lit(9973)) + 0.5) / 9973.0,
        }
    ).withColumnRenamed("source", "of")
    chunks = chunks.join(of, F.col("source").eqNullSafe(F.col("of")))
    chunks = scratch.write(chunks.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), F.col("chunk").alias("c_chunk"), "before", "rate", "offset", "source_size", "target"), "chunks")
    own = Window.partitionBy("source", "class", "chunk").orderBy("size", "doc_id", "text_hash", "row_hash")
    numbered = dealt(keyed).withColumn("n", F.row_number().over(own))
    numbered = numbered.join(chunks, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class")) & (F.col("chunk") == F.col("c_chunk")))
    last = F.col("before") + F.col("n")
    copies = F.floor(F.col("rate") * last + F.col("offset")) - F.floor(F.col("rate") * (last - 1) + F.col("offset"))
    return numbered.select("row", "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    m = mix_sources(docs.select("doc_id", "source", "text"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with docs' own columns."""
    m = mix_sources(docs).where("copies > 0")
    return m.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def _sql(words: str) -> str:
    return f"""
WITH sized AS (SELECT doc_id, source, {words} AS size, length(bin({words})) AS class FROM documents),
placed AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY source) > {CHUNK} THEN ((coalesce(doc_id, 0) % 2147483647) * 48271) % 2147483647 % CAST(ceil(count(*) OVER (PARTITION BY source) / {CHUNK}.0) AS BIGINT) ELSE 0 END AS chunk FROM sized),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS position FROM sized GROUP BY source),
w AS (SELECT *, (position - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, position) AS line FROM w),
f AS (SELECT *, CAST((sum(source_size) OVER () - {CAP} * coalesce(sum(source_size) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE) / CAST(sum(weight) OVER (ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM l),
g AS (SELECT *, {CAP} * CAST(source_size AS DOUBLE) <= weight * level AS filled FROM f),
t AS (SELECT source, source_size, position, CASE WHEN filled THEN {CAP} * CAST(source_size AS DOUBLE) ELSE weight * (SELECT arg_min(level, line) FROM g WHERE NOT filled) END AS target FROM g),
r AS (SELECT p.doc_id, p.size, t.source_size, t.target, row_number() OVER (PARTITION BY p.source ORDER BY p.class, p.chunk, p.size, p.doc_id NULLS FIRST) AS n,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate, ((((t.position + 17) * 48271) % 9973) + 0.5::DOUBLE) / 9973.0::DOUBLE AS offs
  FROM placed p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((floor(rate * n + offs) - floor(rate * (n - 1) + offs)) * size AS BIGINT) AS taken FROM r
"""


ORACLE = _sql(r"CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT)")
