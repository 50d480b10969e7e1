"""Prefix trie, whitening and host rules against brute force and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltine.llm import rules, tries, whitening
from basaltine.llm.scratch import Scratch

# 11

CONV = "conv_id long, turn long, role string, text string, node int, depth int, `odd name` int"


def conversations(seed: int = 3) -> list[tuple]:
    g = random.Random(seed)
    out = []
    for c in [*range(0, 70), -41, -20, -7, 10**12, 10**12 + 5]:
        if c in (20, 41):
            continue
        for t in range(g.randint(1, 6)):
            out.append((c, t, g.choice(["user", "assistant"]), g.choice(["a b", "c", "", "x  y z"])))
    out += [(100, None, None, None), (100, None, "user", None), (100, 4, "user", "late"), (100, 4, "user", "late"), (100, 4, "a", "tie"), (None, 1, "user", "nobody")]
    # One long conversation, copies of it, and one that leaves it late.
    for c in (120, 141, 162, 183):
        out += [(c, t, "user", f"turn {t % 7}" if (c, t) != (183, 6) else "other") for t in range(8)]
    g.shuffle(out)
    return out


def ordered(rows: list[tuple]) -> dict[int, list]:
    got = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            got[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    return {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in got.items()}


def rebuilt(convs: dict[int, list]) -> dict[int, list]:
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def brute_trie(convs: dict[int, list]) -> Counter:
    members, kids = defaultdict(list), defaultdict(set)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                kids[tuple(seq[: d - 1])].add(tuple(seq[:d]))

    def below(path):
        stack, leaves, saved = [path], 0, 0
        while stack:
            p = stack.pop()
            leaves += not kids[p]
            saved += (len(members[p]) - 1) * len(p[-1][1].split()) if p else 0
            stack += kids[p]
        return leaves, saved

    out = Counter()
    for p, m in list(members.items()):
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out[(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("heavy", [1, 512])
def test_trie(spark, heavy, monkeypatch):
    monkeypatch.setattr(tries, "HEAVY", heavy)
    monkeypatch.setattr(tries, "BUNDLE", 4)
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], CONV).repartition(5)
    got = Counter(tuple(r) for r in tries.rebuilt_trie(df).select(NODE).collect())
    assert got == brute_trie(rebuilt(ordered(rows)))
    if heavy == 1:
        got = Counter(tuple(r) for r in tries.conversation_trie(df).select(NODE).collect())
        assert got == brute_trie(ordered(rows))


def test_trie_odd(spark):
    empty = spark.createDataFrame([], CONV)
    assert tries.rebuilt_trie(empty).count() == 0
    assert tries.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")).count() == 0
    # Conversation 1 has two turns, takes the first two of conversation 0, which is absent: the root alone.
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 2)
    one = spark.createDataFrame([(c, 0, "user", "a"), (c, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in tries.rebuilt_trie(one).select(NODE).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_trie_long_and_hot(spark):
    """A conversation of 40,000 turns over many parts, and 5,000 that begin alike: rounds only where prefixes are shared."""
    long = spark.range(40_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.format_string("t%d", "id").alias("text"))
    hot = spark.range(100, 5100).crossJoin(spark.range(2).withColumnRenamed("id", "turn")).select(F.col("id").alias("conv_id"), "turn", F.lit("user").alias("role"), F.when(F.col("turn") == 0, "hello").otherwise(F.format_string("c%d", F.col("id") % 4)).alias("text"))
    got = tries.conversation_trie(long.unionByName(hot))
    assert got.count() == 1 + 40_000 + 1 + 4
    assert got.where("conv_id = 7 and depth > 0").agg(F.sum("n_children"), F.max("depth")).first()[:] == (39_999, 40_000)
    ends = {r.conv_id: r.ends_sha256 for r in got.where("depth = 2 and conv_id <> 7").collect()}
    assert ends == {100 + k: hashlib.sha256(",".join(str(c) for c in range(100, 5100) if c % 4 == k).encode()).hexdigest() for k in range(4)}


# 12


def grid(vectors: list) -> np.ndarray:
    return np.floor(np.array(vectors, float) * 64) + 1_000_000


def vectors(n: int, wide: int, seed: int, decay: float) -> list[list[float]]:
    g = np.random.default_rng(seed)
    turn = np.linalg.qr(g.standard_normal((wide, wide)))[0]
    return (g.standard_normal((n, wide)) * decay ** np.arange(wide) * 40 @ turn).astype(np.float32).tolist()


@pytest.mark.parametrize(("wide", "decay", "most"), [(64, 0.999, 32), (90, 0.5, 4), (70, 0.75, 32), (5, 0.9, 32)])
def test_whitening(spark, wide, decay, most):
    got = vectors(400, wide, 1, decay)
    got[3] = got[9] = got[1]
    rows = [(i, v, i, 1) for i, v in enumerate(got)]
    odd = [(-1, None, 0, 0), (-2, [None] + got[0][1:], 0, 0), (-3, [float("nan")] + got[0][1:], 0, 0), (-4, [float("-inf")] + got[0][1:], 0, 0)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, n long, explained int").repartition(5)
    x = grid(got)
    n, c = len(x), x - x.mean(axis=0)
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    k = min(most, wide)
    out = whitening.whitened(df, most).toPandas()
    assert len(out) == n * k and set(out["n"]) == {n} and set(out["component"]) == set(range(1, k + 1))
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9
    z = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = c @ w[:, :k] / np.sqrt(e[:k])
    want *= np.sign((want * z).sum(axis=0))
    assert np.abs(z - want).max() < 1e-7
    explained = out.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, e[:k] / e.sum(), rtol=1e-9)
    whole = [[int(v) for v in r] for r in x]
    sums = [sum(col) for col in zip(*whole, strict=True)]
    deviation = {i: sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for i, r in enumerate(whole)}
    assert dict(zip(out["vec_id"], out["deviation"], strict=True)) == deviation


def test_range_finder(spark, monkeypatch):
    """A falling spectrum is done in passes over narrow bases; a flat one needs the full dimension."""
    rows = spark.createDataFrame([(v,) for v in vectors(300, 80, 2, 0.6)], "embedding array<double>")
    flat = spark.createDataFrame([(v,) for v in vectors(300, 80, 2, 1.0)], "embedding array<double>")
    widths, real = [], whitening._product
    monkeypatch.setattr(whitening, "_product", lambda r, f, b: widths.append(b.shape[1]) or real(r, f, b))
    whitening.components(rows, whitening.fitted(rows, 80), 4)
    assert set(widths) == {4 + whitening.EXTRA}
    widths.clear()
    whitening.components(flat, whitening.fitted(flat, 80), 4)
    assert widths[-1] == 80


def test_whitening_odd(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whitened(spark.createDataFrame([(None, [1.0, 2.0])] * 3, schema)).collect()
    assert len(same) == 6 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, None, None)}
    few = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [3.0, 1.0, 0.0])], schema)).collect()
    assert len(few) == 6 and [r.whitened is None for r in sorted(few, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 2
    assert few[0].identity_error < 1e-9 and sum(r.explained for r in few) == pytest.approx(2.0)
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e30]), (2, [1.0])]):
        with pytest.raises(Exception, match="unlike lengths|too large"):
            whitening.whitened(spark.createDataFrame(bad, schema)).count()


# 13


def brute_features(text: str | None) -> tuple:
    text = text or ""
    white = " \t\n\x0b\x0c\r"
    words = [w.decode() for w in text.encode().split()]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    held = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(white)]
    n, chars, symbols, dup, repeat = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held)
    broken = [n < 10, 100 * repeat > 20 * n, 10 * symbols > n, 100 * dup > 30 * len(lines), chars < 3 * n or chars > 10 * n]
    return n, chars, symbols, len(lines), dup, repeat, sum(b << k for k, b in enumerate(broken))


def odd_texts(g: random.Random) -> list:
    some = [None, "", " \n\t ", "\n\n", "one", "a b c d e a b c d e", "x " * 5000, "é     é", "a\nb\na", "a\nb\na\n", "l1\r\nl1\n l1", "#*$%&|<> " * 20, "w" * 300_000]
    for _ in range(80):
        some.append("".join(g.choice(["aa", "bbb", "cccc", "ü", "#"]) + g.choice([" ", "  ", "\n", "\t", " "]) for _ in range(g.randint(1, 60))))
    return some


@pytest.mark.parametrize("limit", [8, 200, 1 << 20])
def test_features(limit, monkeypatch):
    import pyarrow as pa

    real = rules.chunks
    monkeypatch.setattr(rules, "chunks", lambda t: real(t, limit))
    texts = odd_texts(random.Random(5))
    assert [tuple(r) for r in rules.features(pa.array(texts, pa.string())).tolist()] == [brute_features(t) for t in texts]


def brute_hosts(rows: list[tuple[str | None, int]]) -> dict[str, str]:
    held = defaultdict(list)
    for host, broken in rows:
        if host is not None:
            held[host].append(broken)
    bad = defaultdict(list)
    for k, rule in enumerate(rules.RULES):
        rates = {h: sum(b >> k & 1 for b in v) / len(v) for h, v in held.items()}
        m = sum(rates.values()) / len(rates)
        between = sum(r * r for r in rates.values()) / len(rates) - m * m - m * (1 - m) * sum(1 / len(v) for v in held.values()) / len(rates)
        strength = min(max(m * (1 - m) / between - 1, 10), 1000) if between > 1e-15 else 1000
        for h, v in held.items():
            if (rates[h] * len(v) + m * strength) / (len(v) + strength) > 0.5:
                bad[h].append(rule)
    return {h: ",".join(bad[h]) for h in held}


SOURCED = "doc_id long, text string, source string, host string, broken int, `odd name` int"


def sourced() -> list[tuple]:
    g = random.Random(6)
    good = lambda: " ".join(g.choices([f"word{k}" for k in range(40)], k=40) + [str(g.random())])
    spam = lambda: "".join(f" #{g.random()}" for _ in range(20))
    out = []
    for i, t in enumerate(odd_texts(g)):
        out.append((i, t, g.choice(["s1", None, "https://A.example/x", "http://a.EXAMPLE?q"])))
    out += [(1000 + i, good(), g.choice(["s1", "s2", "https://a.example/", "s4", "s5", "s6"])) for i in range(150)]
    # Hosts of symbol spam: a large one that goes, and one with a single bad document beside none.
    out += [(2000 + i, good() + spam() if i % 10 else good(), "spam") for i in range(60)]
    out += [(3000, good() + spam(), "small"), (None, good(), "s2"), (1001, good(), "s2"), (1001, good(), "s2")]
    return out


@pytest.mark.parametrize("heavy", [1, 512])
def test_rule_report(spark, heavy, monkeypatch):
    monkeypatch.setattr(rules, "HEAVY", heavy)
    rows = sourced()
    df = spark.createDataFrame([(*r, "q", 1, 2) for r in rows], SOURCED).repartition(4)
    host = lambda s: s.split("://")[1].split("/")[0].split("?")[0].lower() if s and "://" in s else s
    found = [(i, host(s), brute_features(t)) for i, t, s in rows]
    bad = brute_hosts([(h, f[6]) for _, h, f in found])
    assert "symbols" in bad["spam"] and bad["small"] == bad["s2"] == ""
    want = Counter((i, *f[:3], *f[4:6], bool(f[6] & 3), not f[6] & 3 and not bad.get(h), h, bad.get(h, "")) for i, h, f in found)
    got = rules.rule_report(df)
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = rules.rule_filter(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k in want.elements() if k[7])


def test_rules_odd(spark):
    empty = spark.createDataFrame([], SOURCED)
    assert rules.rule_report(empty).count() == 0 and rules.rule_filter(empty).count() == 0
    lone = spark.createDataFrame([(1, "too short", None)], "doc_id long, text string, source string")
    assert [(r.base_failed, r.kept, r.host) for r in rules.rule_report(lone).collect()] == [(True, False, None)]


def test_scratch_names(spark):
    """Levels written one by one read as one table with their depth."""
    s = Scratch(spark)
    for d in (0, 1):
        s.write(spark.range(d + 1), f"levels/depth={d}")
    assert sorted(tuple(r) for r in spark.read.schema("id long, depth long").parquet(f"{s.base}/levels").collect()) == [(0, 0), (0, 1), (1, 1)]


# 7


def test_one_long_trusted_text(spark, monkeypatch):
    """A trusted text beyond the training bound, wherever it stands, neither empties the sample nor keeps others out."""
    from basaltine.llm import quality

    monkeypatch.setattr(quality, "TRAIN_CHARS", 30_000)
    monkeypatch.setattr(quality, "LONG_CHARS", 2_000)
    g = random.Random(8)
    good = lambda k: " ".join(g.choices(["the", "river", "runs", "under", "old", "stones", "and", "winter", "trees"], k=k))
    bad = lambda: "".join(g.choices("qxzjkvw#%0123456789", k=250))
    rows = [(i, good(40), "en") for i in range(300)] + [(1000 + i, bad(), "en") for i in range(100)]
    half = spark.range(300).withColumnRenamed("id", "doc_id").where(quality._half() < 500_000).orderBy(quality._half()).collect()
    for at in (half[0].doc_id, half[-1].doc_id):
        docs = spark.createDataFrame([r if r[0] != at else (at, good(8_000), "en") for r in rows], "doc_id long, text string, lang string")
        labels = docs.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"), F.lit(0).alias("toxic"))
        got = quality.classify(docs, labels)
        assert got.where("perplexity is null").count() == 0
        kept = {r.doc_id for r in got.where("kept").collect()}
        assert len(kept & set(range(300))) >= 290 and not kept & set(range(1000, 1100))
        assert {r.doc_id for r in quality.quality_filter(docs, labels).collect()} == kept
    # Trusted rows of one half alone, or with text in one half alone, still make a model.
    for one in ({half[0].doc_id}, set(range(300)) - {r.doc_id for r in half}):
        labels = docs.select("doc_id", F.col("doc_id").isin(list(one)).cast("int").alias("quality"), F.lit(0).alias("toxic"))
        assert quality.classify(docs, labels).where("threshold is null").count() == 0


# 5, 9, 10: very long runs


def test_long_cuts_equal_the_library():
    import pyarrow as pa
    import sentencepiece

    from basaltine.llm import pieces
    from basaltine.llm.tokens import buffers

    v, sp = pieces.load_vocabulary(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    g = random.Random(4)
    letters = "".join(g.choices("abcdefghijklmnopqrstuvwxyz", k=60_000))
    wide = "".join(g.choices("\u6f22\u5b57\u65e5\u672c\u8a9e\u4e00\u4e8c\u4e09\u7684\u662f", k=20_000))
    texts = [letters, wide, "a" * 50_000, "ab" * 20_000 + "c", "x" + " " * 30_000 + "end" + " " * 20_001, "\U0001f9e0" * 9_000 + "\x00", "word " + letters[:9000] + " \u00e9 " + wide[:5000] + "  " + letters[:9000], "a b  c", " " * 40, "=" * 9_001 + "\n" * 9_001]
    with np.errstate(over="ignore"):
        ids, offsets = pieces.encode_batch(v, *buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == sp.encode(t), i
    assert [b.decode() for b in pieces.decode_batch(v, ids, offsets)] == texts


def test_long_runs_of_key_starts():
    """Runs that start like a key at every few characters, wrapped blobs, and a real key behind them."""
    import base64
    import time

    from basaltine.llm import secrets

    g = random.Random(2)
    number = lambda n: b"\x02" + bytes([n]) + bytes(g.randrange(1, 127) for _ in range(n))
    body = b"\x02\x01\x00" + b"".join(number(20) for _ in range(8))
    key = base64.b64encode(b"\x30\x81" + bytes([len(body)]) + body).decode()
    blob = "\n".join("MIIEvQ" + "".join(g.choices("abcABC012+/", k=58)) for _ in range(5_000))
    began = time.time()
    for text in ("30/" * 200_000, "MIIEvQ/" * 50_000, "b3BlbnNzaC1rZXktdjEA/" * 20_000, blob):
        whole = f"{text} {key} x"
        assert (len(text) + 1, 3, len(text) + 1 + len(key)) in secrets.scan(whole)
    lines = "\n".join(key[i : i + 64] for i in range(0, len(key), 64))
    assert [x for x in secrets.scan(f"{blob}\n\n{lines}\n") if x[1] == 3] == [(len(blob) + 2, 3, len(blob) + 2 + len(lines))]
    assert time.time() - began < 60


def test_long_urls():
    import pyarrow as pa

    from basaltine.llm import urls
    from basaltine.llm.tokens import buffers

    automaton = urls.ShiftAnd([p for _, r in urls.RULES for p in urls.host_patterns(r)] + [urls.glob_pattern(x) for x in urls.GLOBS])
    texts = ["a" * 200_000 + "casino", "x.com/en/" + "b" * 100_000, "x.com/en", "", "spam-farm", *(f"h{i}.net/de/{'c' * i}" for i in range(100))]
    got = automaton.match(*buffers(pa.array(texts)))
    one = np.concatenate([automaton.match(*buffers(pa.array([t]))) for t in texts])
    assert (got == one).all()
    assert got[0].tolist().count(True) == 1 and got[1].any() and not got[2].any() and got[5:].any(axis=1).all()
