"""Quality classifier: a modified Kneser-Ney model of trusted text.

Training (relational): of the labelled rows with quality 1, half, by a hash of doc_id,
are for training: all of them, with their whole texts, however long. The model's
alphabet is what stands in them (the ``LETTERS`` most frequent characters, if there
are more; all others are one unknown character). Their character 4-grams are
counted per language and for all languages together (``*``). Lower orders count
distinct left neighbours. Discounts D1, D2, D3+ come from counts of counts per
language and order, and interpolated probabilities and backoff weights from joins
of each order's table with its contexts and with the order below.

The model is a set of sorted tables, a shard for each order and kind with the
language in the key's head; it holds the different n-grams of the trusted text, whose
number grows slower than the text but has no fixed bound, and travels with the code.
Scoring joins each document's n-grams with the shards in turn, highest order first, and
passes what a shard lacks to the next.

A document's score is the perplexity per character of its text, with ``PRIOR``
characters at the language's own mean added, so that a few words are no
evidence. A language's threshold is the ``QUANTILE`` of the scores of all its
trusted documents that were not trained on, times ``SLACK``. Documents above it
are rejected.

Languages with fewer than ``LEAST_DOCS`` training rows, and null, use ``*``; the
empty string is a language like others. Empty or null text scores the language's
mean and stays. Where one half of the trusted rows has no text, all of them serve for
training and threshold alike. Only without any trusted row that has text there is no
model: scores and thresholds are null and everything stays. Rows that repeat a doc_id, or have none, are scored
each for itself; a null doc_id has no label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, prefilter
from .tokens import chunks, give_back

ORDER, BITS = 4, 13
LETTERS = (1 << BITS) - 2
#: Rows that a language needs for a model of its own, and most languages that have one: as many as a key's head can tell apart.
LEAST_DOCS, LANGS = 30, 2000
#: Bounds of the sample that training was cut to. Nothing reads them any more; an older test still sets them.
TRAIN_CHARS, LONG_CHARS = 0, 0
#: Different n-grams that a task holds before it hands their counts on.
HELD_GRAMS = 2_000_000
PRIOR, QUANTILE, SLACK = 100, 0.99, 1.05
ALL = "*"
#: Most trusted ids, of eight bytes each, that are broadcast.
FEW_IDS = 500_000
#: Bytes of text that are scored at once, and the place of the language in a key.
PART_BYTES, HEAD = 1 << 18, BITS * ORDER


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(code points, their texts, how many at the start are only context): texts of a column in parts of bounded size; a longer text is several, each with the ORDER - 1 points before it."""
    for i, _, data, offs in chunks(texts, PART_BYTES):
        points = np.frombuffer(data.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
        text = np.repeat(np.arange(i, i + len(offs) - 1), np.diff(lead))
        for a in range(0, len(points), PART_BYTES):
            b = max(0, a - ORDER + 1)
            yield points[b : a + PART_BYTES], text[b : a + PART_BYTES], a - b


def _keys(points: np.ndarray, text: np.ndarray, skip: int, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed ORDER-gram, text) of each character but the first ``skip``: codes from 1 by the alphabet, one more for unknown characters, 0 before a text."""
    at = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
    code = np.where(letters[at] == points, at + 1, len(letters) + 1)
    key = code.copy()
    for k in range(1, ORDER):
        key[k:] |= np.where(text[k:] == text[:-k], code[:-k], 0) << (BITS * k)
    return key[skip:], text[skip:]


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for points, _, skip in _parts(b.column(0)):
            value, n = np.unique(points[skip:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], ["point", "n"])


def _counted(letters: np.ndarray):
    """Counts of n-grams by language, added up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def summed(name: str) -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held[name], strict=True))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(n, first)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for name in held:
                keys, n = summed(name)
                yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(len(keys), np.int32), pa.array([name])).cast(pa.string()), pa.array(keys), pa.array(n)], ["lang", "key", "n"])
            held.clear()

        for b in batches:
            lang = b.column(0).dictionary_encode()
            names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            for part in _parts(b.column(1)):
                key, text = _keys(*part, letters)
                for k in np.unique(which[text]).tolist():
                    value, n = np.unique(key[which[text] == k], return_counts=True)
                    held.setdefault(names[k], []).append((value, n.astype(np.int64)))
                    size += len(value)
                if size > HELD_GRAMS:
                    for name in held:
                        held[name] = [summed(name)]
                    size = sum(len(x[0][0]) for x in held.values())
                    if 2 * size > HELD_GRAMS:
                        yield from handed_on()
                        size = 0
        yield from handed_on()
        give_back()

    return run


@dataclass
class Model:
    """Languages, alphabet, and for each order the sorted keys and logs of seen n-grams and of the weights of seen contexts."""

    langs: list[str]
    letters: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    weights: list[tuple[np.ndarray, np.ndarray]]

    def index(self, langs: pa.Array) -> np.ndarray:
        place = {x: i for i, x in enumerate(self.langs)}
        named = langs.cast(pa.string()).dictionary_encode()
        known = np.array([place.get(x, place[ALL]) for x in named.dictionary.to_pylist()] + [place[ALL]], np.int64)
        return known[named.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]

    def nll(self, texts: pa.Array, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(characters, negative log likelihood) of each text."""
        n, total = np.zeros(len(lang), np.int64), np.zeros(len(lang))
        for part in _parts(texts):
            key, text = _keys(*part, self.letters)
            logp = self._logs(key, lang[text])
            n += np.bincount(text, minlength=len(lang))
            total -= np.bincount(text, weights=logp, minlength=len(lang))
        return n, total

    def _logs(self, key: np.ndarray, lang: np.ndarray) -> np.ndarray:
        out, rest, head = np.zeros(len(key)), np.arange(len(key)), lang << HEAD
        for order in range(ORDER, 0, -1):
            k = key[rest] & ((1 << (BITS * order)) - 1)
            keys, values = self.grams[order - 1]
            at = np.minimum(np.searchsorted(keys, head[rest] | k), len(keys) - 1)
            hit = keys[at] == head[rest] | k
            out[rest[hit]] += values[at[hit]]
            rest, k = rest[~hit], k[~hit]
            if not len(rest):
                return out
            keys, values = self.weights[order - 1]
            at = np.minimum(np.searchsorted(keys, head[rest] | k >> BITS), len(keys) - 1)
            out[rest] += np.where(keys[at] == head[rest] | k >> BITS, values[at], 0.0)
        out[rest] -= np.log(len(self.letters) + 1.0)
        return out


def _tables(counts: DataFrame, scratch: Scratch, symbols: int) -> DataFrame:
    """(kind, order, lang, key, value): logs of seen n-grams' probabilities (kind 0) and of seen contexts' weights (kind 1). Each order's tables are written, as the next builds on them."""
    by_order = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        lower = by_order[order + 1].groupBy("lang", (F.col("key").bitwiseAND((1 << (BITS * order)) - 1)).alias("key")).agg(F.count("*").alias("n"))
        by_order[order] = scratch.write(lower, f"counts-{order}")
    out, lower = None, None
    for order in range(1, ORDER + 1):
        t = by_order[order]
        d = t.groupBy("lang").agg(*(F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))
        # Where a count of counts is missing the usual single discount stands in.
        discount = lambda k, a, b: F.least(F.greatest(F.coalesce(k - (k + 1) * y * F.nullif(F.col(b), F.lit(0.0)) / F.nullif(F.col(a), F.lit(0.0)), F.lit(0.5)), F.lit(0.05)), F.lit(k - 0.05))
        d = d.select("lang", discount(1, "n1", "n2").alias("d1"), discount(2, "n2", "n3").alias("d2"), discount(3, "n3", "n4").alias("d3"))
        t = t.join(F.broadcast(d), "lang").select("lang", "key", "n", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"), F.shiftright("key", BITS).alias("context"))
        c = t.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("cut"))
        own, weight = (F.col("n") - F.col("d")) / F.col("total"), F.col("cut") / F.col("total")
        p = t.join(c, ["lang", "context"])
        if lower is None:
            p = p.select("lang", "key", (own + weight / float(symbols)).alias("p"))
        else:
            p = p.withColumn("low", F.col("key").bitwiseAND((1 << (BITS * (order - 1))) - 1)).join(lower, ["lang", "low"]).select("lang", "key", (own + weight * F.col("q")).alias("p"))
        p = scratch.write(p, f"probabilities-{order}")
        lower = p.select("lang", F.col("key").alias("low"), F.col("p").alias("q"))
        row = lambda kind, df, key, value: df.select(F.lit(kind).alias("kind"), F.lit(order).alias("order"), "lang", F.col(key).alias("key"), F.log(value).alias("value"))  # noqa: E731, B023
        both = row(0, p, "key", F.col("p")).unionByName(row(1, c, "context", weight))
        out = both if out is None else out.unionByName(both)
    return out


def _half(column: str = "doc_id"):
    return F.pmod(F.xxhash64(F.col(column), F.lit(7)), F.lit(1_000_000))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> Model | None:
    """The model, from all trusted rows whose hash falls in the first half; from all trusted ones where those have no text."""
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.where("text <> ''")
    for name, part in (("half", trusted_ids(labels).where(_half() < 500_000)), ("all", trusted_ids(labels))):
        ids = scratch.write(part, f"ids-{name}")
        n = ids.count()
        # Beyond the broadcast a bitmap lets a few others pass, which the join takes out.
        sample = _trusted_rows(texts, ids, n) if n <= FEW_IDS else _trusted_rows(texts, ids, n).join(ids, "doc_id", "left_semi")
        sample = scratch.write(sample.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), f"trusted-{name}")
        if not sample.isEmpty():
            break
    else:
        return None
    by_lang = sample.where(F.col("lang") != ALL).groupBy("lang").count().where(F.col("count") >= LEAST_DOCS)
    common = [r[0] for r in by_lang.orderBy(F.col("count").desc(), "lang").limit(LANGS).collect()]
    seen = sample.select("text").mapInArrow(_letters, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    letters = np.array(sorted(r[0] for r in seen.orderBy(F.col("n").desc(), "point").limit(LETTERS).collect()), np.int64)
    known = F.when(F.col("lang").isin(common), F.col("lang")).otherwise(ALL) if common else F.lit(ALL)
    counts = sample.select(known.alias("lang"), "text").mapInArrow(_counted(letters), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "counts-by-language")
    every = counts.groupBy("key").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "key", "n")
    counts = scratch.write(counts.where(F.col("lang") != ALL).unionByName(every), "counts")
    langs = sorted([*common, ALL])
    place = {x: i for i, x in enumerate(langs)}

    # One column of keys with the language in the head: what the driver passes on is the model alone.
    heads = F.create_map(*(F.lit(x) for lang, i in place.items() for x in (lang, i << HEAD)))
    tables = _tables(counts, scratch, len(letters) + 1)
    got = tables.select(F.col("kind").cast("byte"), F.col("order").cast("byte"), F.col("key").bitwiseOR(F.element_at(heads, F.col("lang"))).alias("key"), "value").toArrow()
    kind, order, key, value = (got[c].to_numpy() for c in ("kind", "order", "key", "value"))

    def shard(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        mine = np.flatnonzero((kind == k) & (order == n))
        mine = mine[np.argsort(key[mine])]
        return key[mine], value[mine]

    return Model(langs, letters, [shard(0, n) for n in range(1, ORDER + 1)], [shard(1, n) for n in range(1, ORDER + 1)])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, model (its language, or ``*``), n_chars and nll of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.langs, pa.string())
        for b in batches:
            which = model.index(b.column(1))
            n, nll = model.nll(b.column(2), which)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), names.take(pa.array(which)), pa.array(n), pa.array(nll)], ["doc_id", "lang", "model", "n_chars", "nll"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang string, model string, n_chars long, nll double")


def thresholds(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """(model, mean, threshold) from all trusted documents not trained on; from all trusted ones where there are no others."""
    held = scores.where("n_chars > 0").join(trusted_ids(labels), "doc_id").select("model", "n_chars", "nll", (_half() >= 500_000).alias("fresh"))
    if not (fresh := held.where("fresh")).isEmpty():
        held = fresh
    mean = held.groupBy("model").agg((F.sum("nll") / F.sum("n_chars")).alias("mean"))
    line = held.join(F.broadcast(mean), "model").groupBy("model").agg(F.first("mean").alias("mean"), F.percentile_approx(smoothed(), QUANTILE, 10_000).alias("q"))
    return line.select("model", "mean", (F.col("q") * SLACK).alias("threshold"))


def smoothed():
    return F.exp((F.col("nll") + PRIOR * F.col("mean")) / (F.col("n_chars") + PRIOR))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold and kept of every row."""
    scratch = Scratch(docs.sparkSession)
    model = train(docs, labels, scratch)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    scores = scratch.write(scored(docs, model), "scores")
    limits = thresholds(scores, labels)
    out = scores.join(F.broadcast(limits), "model", "left").withColumn("perplexity", smoothed())
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))


def _trusted_rows(docs: DataFrame, trusted: DataFrame, n: int) -> DataFrame:
    """(doc_id, lang, text) of rows that may be trusted, none of which is shuffled: up to ``FEW_IDS`` ids are broadcast, of more a bitmap."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    return rows.join(F.broadcast(trusted), "doc_id", "left_semi") if n <= FEW_IDS else rows.where(prefilter(trusted, n)(F.col("doc_id")))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' own columns.

    Thresholds need the scores of trusted rows only. Rows are then judged where they stand: text is never shuffled, and no column
    but language and text goes through Python.
    """
    scratch = Scratch(docs.sparkSession)
    model = train(docs, labels, scratch)
    if model is None:
        return docs
    trusted = scratch.write(trusted_ids(labels), "trusted-ids")
    limits = thresholds(scratch.write(scored(_trusted_rows(docs, trusted, trusted.count()), model), "scores"), labels)
    found = {r.model: (r.mean, r.threshold) for r in limits.collect()}  # a row for each language of the model
    mean = np.array([found.get(x, (0.0, 0.0))[0] for x in model.langs])
    top = np.array([found.get(x, (0.0, np.inf))[1] for x in model.langs])

    @F.arrow_udf("boolean")
    def good(lang: pa.Array, text: pa.Array) -> pa.Array:
        which = model.index(lang)
        n, nll = model.nll(text, which)
        give_back()
        return pa.array((n == 0) | (np.exp((nll + PRIOR * mean[which]) / (n + PRIOR)) <= top[which]))

    return docs.where(good(F.col("lang").cast("string"), F.col("text").cast("string")))
