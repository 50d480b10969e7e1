"""Registered queries against their SQL, and the pipeline, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from basaltine.llm import exact, minhash, mixing, pieces, quality, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(small, t)}.parquet'")
    got = queries.QUERIES[name](spark, small)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(names).collect()) == Counter(want.fetchall())


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    kept = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    one = stages[names[0]](spark, docs, small)
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    two = stages[names[1]](spark, one, small)
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in exact.exact_groups(one).where("kept").collect()}
    three = stages[names[2]](spark, two, small)
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in minhash.near_groups(two, 5, 80).where("kept").collect()}
    four = stages[names[3]](spark, three, small)
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix_report(three).where("size > 0").collect()}
    assert Counter(r.doc_id for r in four.collect()) == Counter({k: v for k, v in taken.items() if v})
    assert four.columns == docs.columns
    assert pieces.encode(four).where("not round_trip").count() == 0


def brute_pipeline(spark, small):
    """The pipeline's rows by plain Python, the mix's SQL and the tokenizer's own library: nothing of the operators but their constants."""
    import re

    import sentencepiece
    from test_llm import brute_kneser_ney

    docs = [(r.doc_id, r.text or "", r.lang, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    first = {r.doc_id for r in labels.where(quality._half() < 500_000).collect()}
    trusted = {r.doc_id for r in labels.collect()}
    # 1: a Kneser-Ney model of each language with enough training rows, and one of all.
    train = [d for d in docs if d[0] in first and d[1]]
    langs = {lang for lang, n in Counter(d[2] for d in train).items() if lang is not None and n >= quality.LEAST_DOCS}
    letters = {c for d in train for c in d[1]}
    models = {lang: brute_kneser_ney([d[1] for d in train if lang in ("*", d[2])], letters) for lang in ["*", *langs]}
    scores = [(d, d[2] if d[2] in langs else "*") for d in docs]
    scores = [(d, m, models[m](d[1])) for d, m in scores]
    limits = {}
    for m in models:
        held = [(d, nll) for d, k, nll in scores if k == m and d[1] and d[0] in trusted - first]
        if held:
            mean = sum(x for _, x in held) / sum(len(d[1]) for d, _ in held)
            smooth = lambda n, x, mean=mean: math.exp((x + quality.PRIOR * mean) / (n + quality.PRIOR))
            ranked = sorted(smooth(len(d[1]), x) for d, x in held)
            limits[m] = smooth, ranked[math.ceil(quality.QUANTILE * len(ranked)) - 1] * quality.SLACK
    kept = [d for d, m, nll in scores if not d[1] or m not in limits or limits[m][0](len(d[1]), nll) <= limits[m][1]]
    # 2: of equal texts the smallest doc_id.
    once = {}
    for d in sorted(kept, key=lambda d: d[0]):
        once.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d[1]), d)
    # 3: all pairs of sets of five-word runs.
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for d in once.values():
        w = [x.decode() for x in d[1].translate(lower).encode().split()]
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    root = {d[0]: d[0] for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    left = [d for d, _ in sets if find(d[0]) == d[0]]
    # 4: the mix's SQL over what is left.
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", left)
    sql = mixing.ORACLE.replace("* size AS BIGINT) AS taken", "AS BIGINT) AS copies")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    copies = {r[names.index("doc_id")]: r[names.index("copies")] for r in got.fetchall()}
    # 5: the library's pieces.
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    return Counter({(d[0], tuple(sp.encode(d[1]))): copies[d[0]] for d in left if copies[d[0]]}), len(docs), len(kept), len(once), len(left)


def test_pipeline_by_brute_force(spark, small):
    want, *sizes = brute_pipeline(spark, small)
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] > sizes[3]
    got = Counter((r.doc_id, tuple(r.piece_ids)) for r in corpus_pipeline.run(spark, small).collect())
    assert got == want
