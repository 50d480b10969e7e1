"""Quality rules judged by host.

Rules of a document, over whole texts (words are runs outside white space):

* ``short``: fewer than ``LEAST_WORDS`` words,
* ``repetition``: more than 20 % of the words stand in a run of five words that the text has twice or more,
* ``symbols``: more than one of ``#*$%&|<>`` for ten words,
* ``lines``: more than 30 % of the lines with a word repeat an earlier line,
* ``word_length``: the mean word has fewer than 3 or more than 10 characters.

The first two are the base: a document that breaks one is rejected by itself. All
five are counted by host (what follows ``://`` in the source, lower-cased; a source
without ``://`` is its own host). A host's rate for a rule is shrunk to what hosts have
in general: a beta prior whose mean is that of the hosts' rates and whose strength comes
from their variance, less what sampling explains (method of moments, between
``WEAKEST`` and ``STRONGEST`` documents). A host is rejected with all its documents
where a shrunk rate is above ``LIMIT``, i.e. where a next document would rather break the
rule than not. So one bad document does not condemn a small host, however unlike
the other hosts are.

Counts by host are partial aggregates; hosts with more than 1/``HEAVY`` of the
documents, fewer than ``HEAVY``, are joined back by broadcast, the others by a
shuffle of narrow rows. A text is held by itself: memory grows with the longest
text alone.

Null text has no words (and is ``short``); a document without source has no host and
only its own base verdict. Rows that repeat a doc_id, or have none, are rows of
their own, and count each. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .scratch import Scratch, bounded_batches, prefilter, whole_row
from .tokens import _WORD, Words, chunks, give_back, words_of

RULES = ("short", "repetition", "symbols", "lines", "word_length")
#: Rules that reject a document by itself.
BASE = ("short", "repetition")
LEAST_WORDS, LIMIT, WEAKEST, STRONGEST, HEAVY = 10, 0.5, 10.0, 1000.0, 512
RUN = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "broken")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _ids(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    if not len(a):
        return a
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: Words) -> np.ndarray:
    """Of each text, the words in a run of RUN words that it has twice or more. Runs are compared by their words: pairs, fours and fives are numbered in turn."""
    n = len(words.counts)
    if len(words.starts) < RUN:
        return np.zeros(n, np.int64)
    one = _ids(words_of(words))
    two = _dense(one[:-1], one[1:])
    four = _dense(two[:-2], two[2:])
    five = _dense(four[:-1], one[RUN - 1 :])
    at = np.flatnonzero(words.text[: -RUN + 1] == words.text[RUN - 1 :])
    _, which, times = np.unique(_dense(five[at], words.text[at]), return_inverse=True, return_counts=True)
    at = at[times[which] > 1]
    edge = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + RUN, -1)
    return np.bincount(words.text[np.cumsum(edge[:-1]) > 0], minlength=n)


def lines_of(words: Words, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier one) of each text; lines end at ``\\n``."""
    n, data = len(offs) - 1, words.data
    if not len(words.starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.flatnonzero(data == 0x0A)
    starts = np.union1d(offs[:-1][offs[:-1] < len(data)], ends[ends + 1 < len(data)] + 1)
    # The lines' bytes without line ends, so that a text's last line equals others.
    place = np.append(starts - np.searchsorted(ends, starts), len(data) - len(ends)).astype(np.int64)
    lines = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data[data != 0x0A]))])
    has = np.unique(np.searchsorted(starts, words.starts, side="right") - 1)
    text = np.searchsorted(offs, starts[has], side="right") - 1
    first = np.unique(_dense(_ids(lines.take(pa.array(has))), text), return_index=True)[1]
    count = np.bincount(text, minlength=n)
    return count, count - np.bincount(text[first], minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; ``broken`` has a bit for each rule."""
    out = np.zeros((len(texts), len(FEATURES)), np.int64)
    for i, j, data, offs in chunks(texts):
        words = Words(data, offs)
        summed = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[offs])  # noqa: B023, E731
        out[i:j, 0] = words.counts
        out[i:j, 1] = summed(_WORD[data] & ((data & 0xC0) != 0x80))
        out[i:j, 2] = summed(_SYMBOL[data])
        out[i:j, 3], out[i:j, 4] = lines_of(words, offs)
        out[i:j, 5] = repeated_words(words)
    n, chars, symbols, lines, dup, repeat = out[:, :6].T
    broken = (n < LEAST_WORDS, 100 * repeat > 20 * n, 10 * symbols > n, 100 * dup > 30 * lines, (chars < 3 * n) | (chars > 10 * n))
    out[:, 6] = sum(x.astype(np.int64) << k for k, x in enumerate(broken))
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in features(b.column(2)).T)], ["doc_id", "host", *FEATURES])
    give_back()


@F.arrow_udf(LongType())
def _broken(text: pa.Array) -> pa.Array:
    return pa.array(features(text)[:, 6])


def host_of(column: str = "source") -> Column:
    source = F.col(column).cast("string")
    return F.when(F.instr(source, "://") > 0, F.lower(F.regexp_extract(source, r"://([^/?#]*)", 1))).otherwise(source)


def breaks(rules: tuple[str, ...]) -> Column:
    return F.col("broken").bitwiseAND(sum(1 << RULES.index(r) for r in rules)) != 0


def host_verdicts(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, n, rejected_for): of (host, broken), each host's documents and the rules that it is rejected for, joined by commas (empty: none)."""
    fails = [F.count_if(F.col("broken").bitwiseAND(1 << k) != 0).alias(f"f{k}") for k in range(len(RULES))]
    hosts = scratch.write(documents.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *fails), "hosts")
    rate = lambda k: F.col(f"f{k}") / F.col("n")
    prior = hosts.agg(F.avg(1 / F.col("n")).alias("w"), *(f for k in range(len(RULES)) for f in (F.avg(rate(k)).alias(f"m{k}"), F.avg(rate(k) * rate(k)).alias(f"s{k}"))))
    failed = []
    for k, rule in enumerate(RULES):
        m = F.col(f"m{k}")
        spread = m * (1 - m)
        between = F.col(f"s{k}") - m * m - spread * F.col("w")
        strength = F.when(between > 0, F.least(F.greatest(spread / between - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(STRONGEST)
        failed.append(F.when((F.col(f"f{k}") + m * strength) / (F.col("n") + strength) > LIMIT, F.lit(rule)))
    # The prior is one row.
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", F.concat_ws(",", *failed).alias("rejected_for"))


def rule_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, and the rules that its host is rejected for, of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host_of().alias("host"), F.col("text").cast("string").alias("text"))
    rows = scratch.write(rows.mapInArrow(_measured, "doc_id long, host string, " + ", ".join(f"{x} long" for x in FEATURES)), "measured")
    hosts = scratch.write(host_verdicts(rows, scratch), "verdicts")
    total = rows.count()
    heavy = F.broadcast(hosts.where(F.col("n") * HEAVY > total).drop("n"))
    light = hosts.where((F.col("n") * HEAVY <= total) & (F.col("rejected_for") != "")).drop("n")
    judged = rows.join(heavy, "host").unionByName(rows.join(heavy, "host", "left_anti").join(light, "host", "left"), allowMissingColumns=True)
    bad = F.coalesce("rejected_for", F.lit(""))
    return judged.select(*(c for c in ("doc_id", *FEATURES[:3], *FEATURES[4:6])), breaks(BASE).alias("base_failed"), (~breaks(BASE) & (bad == "")).alias("kept"), "host", bad.alias("host_rejected_for"))


def rule_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns. Rows that may be of a rejected host alone are joined with it; the others stay where they are."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    broken = scratch.write(docs.select(host_of().alias("host"), _broken(F.col("text").cast("string")).alias("broken")), "broken")
    bad = scratch.write(host_verdicts(broken, scratch).where("rejected_for <> ''").select("host", F.xxhash64("host").alias("key")), "rejected")
    may = prefilter(bad.select("key"), bad.count())
    rows = docs.select(whole_row(docs), host_of().alias("host"), _broken(F.col("text").cast("string")).alias("broken")).where(~breaks(BASE)).withColumn("doubt", F.col("host").isNotNull() & may(F.xxhash64("host")))
    sure = rows.where("not doubt").select("row")
    return sure.unionByName(rows.where("doubt").join(bad, "host", "left_anti").select("row")).select("row.*")


_RATES = ",\n".join(
    f"""(SELECT avg(f{k} / n::DOUBLE) FROM h) AS m{k}, (SELECT avg((f{k} / n::DOUBLE) * (f{k} / n::DOUBLE)) FROM h) AS s{k}""" for k in range(len(RULES))
)
_FAILED = ", ".join(
    f"""CASE WHEN (f{k} + m{k} * z{k}) / (n + z{k}) > 0.5 THEN '{rule}' END""" for k, rule in enumerate(RULES)
)
_STRENGTH = ", ".join(
    f"""CASE WHEN s{k} - m{k} * m{k} - m{k} * (1 - m{k}) * w > 0 THEN least(greatest(m{k} * (1 - m{k}) / (s{k} - m{k} * m{k} - m{k} * (1 - m{k}) * w) - 1, 10), 1000) ELSE 1000 END AS z{k}""" for k in range(len(RULES))
)

ORACLE = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, CASE WHEN contains(source, '://') THEN lower(regexp_extract(source, '://([^/?#]*)', 1)) ELSE source END AS host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(generate_series(1, len(words) - 4)) AS pos, words FROM w WHERE len(words) >= 5),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(words[pos:pos + 4], ' ')) AS times FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(pos, pos + 4)) AS p FROM r WHERE times > 1) GROUP BY doc_id),
f AS (SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 AS b0, 100 * n_repeat_words > 20 * n_words AS b1, 10 * n_symbols > n_words AS b2, 100 * n_dup_lines > 30 * n_lines AS b3, word_chars < 3 * n_words OR word_chars > 10 * n_words AS b4 FROM f),
h AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE b{k}) AS f{k}" for k in range(len(RULES)))} FROM b WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT (SELECT avg(1 / n::DOUBLE) FROM h) AS w, {_RATES}),
z AS (SELECT h.*, p.*, {_STRENGTH} FROM h CROSS JOIN p),
v AS (SELECT host, concat_ws(',', {_FAILED}) AS bad FROM z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 OR b1 AS base_failed, NOT (b0 OR b1) AND coalesce(v.bad, '') = '' AS kept, b.host, coalesce(v.bad, '') AS host_rejected_for
FROM b LEFT JOIN v ON v.host = b.host"""
