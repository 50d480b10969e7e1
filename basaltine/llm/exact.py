"""Exact dedup with a heavy-hitter split.

Digests of whole normalised texts are written once. Misra-Gries summaries of
the partitions, summed, name every digest that may hold more than
1/``HEAVY`` of the rows: at most 2 * ``HEAVY`` of them, since the summed
estimates never exceed the number of rows. Those are verified by an exact
count and their winners (smallest doc_id) are broadcast, so that hot groups are
decided on the map side; all other digests are grouped by an ordinary shuffle.

Null text counts as empty. Rows are told apart, not ids: of rows that repeat both
doc_id and text the report gives each the same values, and ``exact_dedup`` keeps
one. A null doc_id wins only where a group has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, prefilter, row_hash, text_hash, text_of, whole_row

HEAVY = 256
SPACES = r"[\x20\x09-\x0D]+"


def digest(column: str = "text"):
    """Hex SHA-256 of the text with each run of white space as one space."""
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), SPACES, " "), "UTF-8"), 256)


def misra_gries(size: int):
    """mapInArrow function: a summary of ``size`` counters of the values of column 0 of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for x in b.column(0).value_counts():
                held[x["values"].as_py()] = held.get(x["values"].as_py(), 0) + x["counts"].as_py()
            if len(held) > size:
                # Several decrements at once: what all but the largest ``size`` have.
                cut = sorted(held.values(), reverse=True)[size]
                held = {k: v - cut for k, v in held.items() if v > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["digest", "estimate"])

    return run


def heavy_groups(keyed: DataFrame) -> DataFrame:
    """(digest) of frequent digests of a table with a column digest: all that hold 1/HEAVY of the rows, 2 * HEAVY at most."""
    total = keyed.count()
    summary = keyed.select("digest").mapInArrow(misra_gries(2 * HEAVY), "digest string, estimate long")
    return summary.groupBy("digest").agg(F.sum("estimate").alias("estimate")).where(F.col("estimate") > total / (2 * HEAVY)).select("digest")


def heavy_winners(keyed: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of frequent digests of (doc_id, digest), with exact counts."""
    return keyed.join(F.broadcast(heavy_groups(keyed)), "digest").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def _split(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, digest) written out, verified winners, groups of the other digests."""
    scratch = Scratch(docs.sparkSession)
    keyed = scratch.write(text_of(docs).select("doc_id", digest().alias("digest")), "digests")
    winners = scratch.write(heavy_winners(keyed), "winners")
    light = keyed.join(F.broadcast(winners), "digest", "left_anti")
    return keyed, winners, light.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    keyed, winners, groups = _split(docs)
    hot = keyed.join(F.broadcast(winners), "digest")
    rest = keyed.join(F.broadcast(winners), "digest", "left_anti").join(groups, "digest")
    return hot.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with docs' own columns, whatever their names.

    It is the row with the smallest doc_id (null last), then with the least hash of all its columns. Only rows whose text may be
    among the repeated ones are shuffled, and of frequent texts only the winner.
    """
    scratch = Scratch(docs.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("hash"))
    keyed = scratch.write(docs.select(digest().alias("digest"), text_hash().alias("fp"), place.alias("place")), "digests")
    winners = scratch.write(keyed.join(F.broadcast(heavy_groups(keyed)), "digest").groupBy("digest").agg(F.min("place").alias("first")), "winners")
    heavy = F.broadcast(winners)
    light = keyed.join(heavy, "digest", "left_anti")
    twice = light.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    texts = light.join(twice, "digest", "left_semi").unionByName(keyed.join(heavy, "digest", "left_semi")).select("fp").distinct()
    texts = scratch.write(texts, "repeated")
    repeated = prefilter(texts, texts.count())
    rows = docs.select(whole_row(docs), digest().alias("digest"), text_hash().alias("fp"), place.alias("place")).withColumn("again", repeated(F.col("fp")))
    once = rows.where("not again").select("row")
    again = rows.where("again").join(heavy, "digest", "left").where("first is null or place = first")
    kept = again.withColumn("n", F.row_number().over(Window.partitionBy("digest").orderBy("place"))).where("n = 1").select("row")
    return once.unionByName(kept).select("row.*")
