"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, fingerprints, lm_scores, minhash, mixing, pieces, quality, rules, secrets, substring, tries, urls, whitening
from .scratch import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(documents(spark, sf_dir), width=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir), shingle=3, percent=85)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores.lm_scores(documents(spark, sf_dir))
    # Sums of logs depend on their order in the last digits.
    return scores.withColumns({"log_score": F.round("log_score", 6), "log_sum": F.round("log_sum", 4)})


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.next_document_report(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_minhash_near_dedup,
        op3_mix_sources,
        op4_exact_dedup,
        op5_secret_scan,
        op6_lm_scores,
        op7_quality_classifier,
        op8_fingerprints,
        op9_sentencepiece,
        op10_url_filter,
        op11_prefix_trie,
        op12_embedding_whitening,
        op13_quality_rules,
    )
}

ORACLE_SQL = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(generate_series(1, len(words) - 49)) AS pos, words FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY array_to_string(words[pos:pos + 49], ' ')) AS first_id FROM g),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 49)) AS pos FROM h WHERE first_id < doc_id),
x AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda v, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id)""",
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id WHERE r.m < e.b),
k AS (SELECT id, min(m) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN k ON k.id = d.doc_id""",
    "op3_mix_sources": mixing.ORACLE,
    "op4_exact_dedup": r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)""",
    "op6_lm_scores": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, pos, words[pos] AS x, CASE WHEN pos > 1 THEN words[pos - 1] END AS v, CASE WHEN pos > 2 THEN words[pos - 2] END AS u FROM (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS pos FROM w)),
c1 AS (SELECT x, count(*) AS c FROM t GROUP BY x), o1 AS (SELECT doc_id, x, count(*) AS c FROM t GROUP BY ALL),
c2 AS (SELECT v, x, count(*) AS c FROM t WHERE pos > 1 GROUP BY ALL), o2 AS (SELECT doc_id, v, x, count(*) AS c FROM t WHERE pos > 1 GROUP BY ALL),
c3 AS (SELECT u, v, x, count(*) AS c FROM t WHERE pos > 2 GROUP BY ALL), o3 AS (SELECT doc_id, u, v, x, count(*) AS c FROM t WHERE pos > 2 GROUP BY ALL),
r1 AS (SELECT doc_id, x, c1.c - o1.c AS n FROM o1 JOIN c1 USING (x)),
r2 AS (SELECT doc_id, v, x, c2.c - o2.c AS n FROM o2 JOIN c2 USING (v, x)),
r3 AS (SELECT doc_id, u, v, x, c3.c - o3.c AS n FROM o3 JOIN c3 USING (u, v, x)),
j AS (SELECT t.doc_id, t.pos, greatest(a.n, 0.5::DOUBLE) / (SELECT count(*) FROM t) AS s1, b.n AS n2, av.n AS n1v, d.n AS n3, bv.n AS n2v
  FROM t JOIN r1 a ON a.doc_id = t.doc_id AND a.x = t.x
  LEFT JOIN r2 b ON b.doc_id = t.doc_id AND b.v = t.v AND b.x = t.x LEFT JOIN r1 av ON av.doc_id = t.doc_id AND av.x = t.v
  LEFT JOIN r3 d ON d.doc_id = t.doc_id AND d.u = t.u AND d.v = t.v AND d.x = t.x LEFT JOIN r2 bv ON bv.doc_id = t.doc_id AND bv.v = t.u AND bv.x = t.v),
k AS (SELECT doc_id, pos, n3, n2v, CASE WHEN pos = 1 THEN ln(s1) WHEN n2 > 0 THEN ln(n2 / n1v::DOUBLE) ELSE ln(0.4::DOUBLE) + ln(s1) END AS l2 FROM j),
s AS (SELECT doc_id, sum(CASE WHEN pos < 3 THEN l2 WHEN n3 > 0 THEN ln(n3 / n2v::DOUBLE) ELSE ln(0.4::DOUBLE) + l2 END) AS score FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, round(coalesce(score / len(words), 0.0), 6) AS log_score, round(coalesce(score, 0.0), 4) AS log_sum FROM w LEFT JOIN s USING (doc_id)""",
    "op10_url_filter": urls.ORACLE,
    "op11_prefix_trie": tries.ORACLE,
    "op13_quality_rules": rules.ORACLE,
}
