"""Chained windows, forests, polygons of any shape and banded tables against brute force."""

import itertools
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltine.operators import generate, graph, series, sessions, tracks
from basaltine.plans import ORACLE_SQL, QUERIES


def brute_limiter(rows, limit, seconds):
    window, hits, out = None, Counter(), {}
    for i, key, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if window is None or (at - window).total_seconds() > seconds:
            window, hits = at, Counter()
        hits[key] += 1
        out[i] = (window, hits[key], hits[key] <= limit)
    return out


@pytest.mark.parametrize("gap", [3, 200])
def test_reset_limiter(spark, gap):
    """Dense hits, long gaps, hits exactly at the end of a window, ties."""
    g, at, rows = random.Random(gap), datetime(2024, 1, 1, 0, 0, 7), []
    for i in range(400):
        at += timedelta(seconds=g.choice([0, 0.5, 1, 20, 60, gap, 61 if i % 50 == 0 else 2]))
        rows.append((i, g.choice("abc"), at))
    rows += [(900, "a", None), (901, "a", rows[0][2] + timedelta(seconds=60)), (902, "b", rows[0][2])]
    df = spark.createDataFrame(rows, "id long, key string, at timestamp").repartition(3)
    got = {r.id: (r.window_start, r.hit, r.allowed) for r in sessions.reset_limited(df, "key", "at", ["at", "id"], 3).collect()}
    assert got == brute_limiter(rows, 3, 60)
    assert sessions.reset_limited(df.limit(0), "key", "at", ["at", "id"], 3).count() == 0


def kruskal(edges):
    parent, out = {}, []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for part, a, b, w in sorted(edges, key=lambda e: (e[0], -e[3], e[1], e[2])):
        x, y = find((part, a)), find((part, b))
        if x != y:
            parent[x] = y
            out.append((part, a, b, w))
    return sorted(out)


@pytest.mark.parametrize("weights", [1, 3, 100])
def test_forest(spark, weights):
    """Ties of all weights, several components, chains and a star."""
    g = random.Random(weights)
    edges = [(p, a, b, g.randint(1, weights)) for p in range(3) for a, b in itertools.combinations(range(25), 2) if g.random() < 0.12]
    edges += [(7, k, k + 1, 1) for k in range(40)] + [(8, 0, k, k % 2) for k in range(1, 40)]
    odd = [(0, 3, 3, 9), (0, None, 1, 9), (9, 1, 2, 5), (9, 1, 2, 4)]
    df = spark.createDataFrame([*edges, *odd], "part int, src long, dst long, weight long").repartition(3)
    got = sorted(tuple(r) for r in graph.forest_edges(df, "part").collect())
    assert got == kruskal([*edges, odd[2]])
    assert graph.forest_edges(df.limit(0), "part").count() == 0


@pytest.mark.parametrize("few", [3, 40])
def test_shared_forest(spark, monkeypatch, few):
    """Nodes in many blocks, named by numbers and by strings: the forest of all pairs that share a marker."""
    g = random.Random(few)
    sets = [(p, f"n{k}" if p % 2 else f"{k:03d}", sorted({g.randrange(few * (1 + k % 3)) for _ in range(g.randint(0, 9))})) for p in range(4) for k in range(60 if p else 5)]
    sets += [(9, "alone", [1]), (9, None, [1]), (None, "x", [1]), (9, "none", None), (10, "a", [10**6]), (10, "b", [10**6])]
    whole = [(p, k, [datetime(2024, 1, 1) + timedelta(days=d % 10**4) for d in v] if v else v) for p, k, v in sets]
    edges = [(p, a, b, len(set(v) & set(w))) for (p, a, v), (q, b, w) in itertools.permutations([s for s in sets if None not in s], 2) if p == q and a < b and set(v) & set(w)]
    for nodes in (8, 2_048):
        monkeypatch.setattr(graph, "BLOCK_NODES", nodes)
        df = spark.createDataFrame(whole, "part int, node string, markers array<timestamp_ntz>").repartition(3)
        got = graph.shared_forest(df, "part", "node", "markers")
        assert dict(got.dtypes) == {"part": "int", "src": "string", "dst": "string", "weight": "bigint"}
        assert sorted(map(tuple, got.collect())) == kruskal(edges)
    assert graph.shared_forest(df.limit(0), "part", "node", "markers").count() == 0


@pytest.mark.parametrize("rare", [1, 10, 10**6])
def test_common_markers(monkeypatch, rare):
    """By products, by single pairs and by both."""
    monkeypatch.setattr(graph, "RARE", rare)
    monkeypatch.setattr(graph, "COLUMNS", 7)
    g = np.random.default_rng(rare)
    x, y = (g.random((n, 50)) < np.linspace(0.01, 0.7, 50) for n in (30, 17))
    sides = [np.nonzero(m) for m in (x, y)]
    assert (graph._common(*sides, (30, 17), 50) == x.astype(int) @ y.T.astype(int)).all()
    own = graph._common(sides[0], sides[0], (30, 30), 50)
    assert (own == x.astype(int) @ x.T.astype(int))[~np.eye(30, dtype=bool)].all()


def test_forest_of_many_pairs(spark, tmp_path, monkeypatch):
    """2,000 suppliers of a nation that all ship on the same 500 days: a thousand million pairs, of which no rows are made."""
    monkeypatch.setattr(graph, "BLOCK_NODES", 700)
    day = F.timestamp_seconds(F.col("id") % 500 * 86400).cast("timestamp_ntz")
    spark.range(1_000_000).select(F.floor(F.col("id") / 500).alias("l_suppkey"), day.alias("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(2_000).select(F.col("id").alias("s_suppkey"), F.lit(3).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    began = time.monotonic()
    got = QUERIES["forest_edges"](spark, str(tmp_path)).collect()
    assert time.monotonic() - began < 60
    assert sorted(map(tuple, got)) == [(3, 0, k, 500) for k in range(1, 2_000)]


def inside(p, poly):
    """Even-odd."""
    x, y, odd = *p, False
    for (x1, y1), (x2, y2) in zip(poly, np.roll(poly, -1, axis=0), strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
            odd = not odd
    return odd


@pytest.mark.parametrize("seed", range(6))
def test_polygons_on_a_grid(seed):
    """Concave stars, boxes that touch, and a bow tie, against counting."""
    g = np.random.default_rng(seed)
    star = lambda n, s: np.stack([s[0] + (r := g.uniform(0.5, 2, n)) * np.cos(w := np.arange(n) * 2 * np.pi / n), s[1] + r * np.sin(w)], axis=1)
    shapes = [star(9, (0, 0)), star(7, (0.5, 0.3)), np.array([[-1, -1], [1, 1], [1, -1], [-1, 1]]), np.array([[0, 0], [2, 0], [2, 1], [1, 1], [1, 2], [0, 2]]), np.array([[0, 0], [1, 0], [1, 1], [1, 2], [2, 2], [2, 0], [3, 0], [3, 3], [0, 3]])]
    n = 160
    grid = [((i + 0.5) / n * 6 - 2.5, (j + 0.5) / n * 6 - 2.5) for i in range(n) for j in range(n)]
    for a, b in itertools.combinations_with_replacement(shapes[seed % 2 :: 2] if seed < 4 else shapes, 2):
        want = sum(inside(p, a) and inside(p, b) for p in grid) * (6 / n) ** 2
        assert tracks.common_area(a, b) == pytest.approx(want, abs=0.12)
    convex = np.array([[-1, -1], [1.5, -1], [1.5, 0.8], [-1, 0.8]])
    assert tracks.common_area(shapes[0], convex) == pytest.approx(tracks.polygon_area(tracks.clip_convex(shapes[0], convex)), abs=1e-9)
    assert tracks.common_area(shapes[3], shapes[3][::-1]) == pytest.approx(3.0) and tracks.common_area(shapes[3], shapes[3] + 10) == 0


def test_polygon_rows(spark):
    box = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    df = spark.createDataFrame([(1, box, [[x + 0.5, y] for x, y in box]), (2, None, box), (3, [], box)], "id int, a array<array<double>>, b array<array<double>>")
    got = {r.id: (r.iou, r.covered) for r in tracks.polygon_overlaps(df, "a", "b").collect()}
    assert got[1] == pytest.approx((1 / 3, 0.5)) and got[2] == (None, None) and got[3] == (0.0, 0.0)


def test_polygons_by_batches(spark):
    """Pairs of mixed shapes in one batch are what each pair is alone, and a row takes microseconds."""
    g = np.random.default_rng(3)
    shape = lambda n: (g.integers(0, 9, (n, 2)) / 2.0).tolist()
    rows = [(i, None if i % 41 == 0 else shape(i % 7), None if i % 43 == 0 else shape(3 + i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a array<array<double>>, b array<array<double>>").coalesce(1)
    got = {r.id: (r.iou, r.covered) for r in tracks.polygon_overlaps(df, "a", "b").collect()}
    for i, a, b in rows:
        want = (None, None) if a is None or b is None else tracks.polygon_iou(np.array(a).reshape(-1, 2), np.array(b))
        assert got[i] == (want if want[0] is None else pytest.approx(want, abs=1e-12)), i
    many = df.crossJoin(spark.range(100)).coalesce(1)
    began = time.monotonic()
    assert tracks.polygon_overlaps(many, "a", "b").selectExpr("count(iou)").first()[0] == 100 * sum(v[0] is not None for v in got.values())
    assert time.monotonic() - began < 20


def test_polygons_in_blocks(monkeypatch):
    """Blocks of pairs, edges and strips add up to the same."""
    g = np.random.default_rng(4)
    a, b = g.uniform(0, 3, (40, 9, 2)), g.uniform(0, 3, (40, 7, 2))
    whole = tracks._areas(a, b)
    monkeypatch.setattr(tracks, "POLYGON_CELLS", 50)
    assert np.allclose(tracks._areas(a, b), whole, atol=1e-12)


def test_polygon_ties(spark, tmp_path):
    """Shares that end in a five after six digits are rounded as SQL rounds them."""
    keys = [(3678, 39), (68347, 18), (95717, 18), (684172, 18), (795863, 31), (932713, 31)]
    spark.createDataFrame(keys, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    got = QUERIES["polygon_overlap"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE_SQL["polygon_overlap"]).fetchall())


def brute_lut(hist, levels, band):
    n, best = len(hist), None
    for cuts in itertools.combinations(range(1, n), levels - 1):
        edge = [0, *cuts, n]
        if all(abs(y - round(levels * x / n)) <= band for y in range(levels) for x in range(edge[y], edge[y + 1])):
            cost = sum(sum(hist[a:b]) - max(hist[a:b]) for a, b in zip(edge, edge[1:], strict=False))
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("band", [1, 2, 9])
def test_banded_lut(band):
    g = random.Random(band)
    for _ in range(25):
        n, levels = g.randint(5, 11), g.randint(2, 5)
        hist = [g.choice([0, 0, 1, 5, 9]) for _ in range(n)]
        want = brute_lut(hist, levels, band)
        if want is None:
            with pytest.raises(ValueError, match="band"):
                series.banded_lut(np.array(hist), levels, band)
            continue
        lut = series.banded_lut(np.array(hist), levels, band)
        assert lut[0] == 0 and lut[-1] == levels - 1 and set(np.diff(lut)) <= {0, 1}
        assert all(abs(y - round(levels * x / n)) <= band for x, y in enumerate(lut))
        assert sum(sum(v := [hist[x] for x in range(n) if lut[x] == y]) - max(v) for y in range(levels)) == want


def test_lookup_tables(spark):
    rows = [("a", k % 700) for k in range(2000)] + [("b", 5)] * 10 + [("b", None), ("b", 5000)]
    got = {r.k: r for r in series.lookup_tables(spark.createDataFrame(rows, "k string, value int"), ["k"], "value").collect()}
    hist = np.bincount([v for k, v in rows if k == "a"], minlength=1024)
    assert got["a"].lut == series.banded_lut(hist).tolist() and got["b"].collisions == 0 and len(got["b"].lut) == 1024


def test_fades(spark, monkeypatch):
    """Images with no, one and many points, unknown ones, and rows made in small blocks, against plain Python."""
    g = random.Random(5)
    point = lambda: (g.uniform(-3, 12), g.uniform(-3, 9), [g.randint(0, 1500) for _ in range(3)])
    rows = [(i, [point() for _ in range(i % 6)]) for i in range(20)]
    rows += [(20, None), (21, [(None, 2.0, [500, 400, 300]), point()]), (22, [(2.0, 2.0, [700, None])]), (23, [None, point()]), (None, [point()]), (24, [(1.0, 1.0, None)])]
    df = spark.createDataFrame(rows, "image int, points array<struct<cx: double, cy: double, color: array<int>>>").coalesce(1)

    def pixel(points, y, x, c):
        total = None if points is None else 0.0
        for p in points or []:
            cx, cy, color = p or (None, None, None)
            fade = 0.0 if cx is None or cy is None else max(0.0, 1 - ((x - cx) ** 2 + (y - cy) ** 2) ** 0.5 / 4.0)
            known = color is not None and c < len(color) and color[c] is not None
            total = total + fade * color[c] if known and total is not None else None
        value = int(min(1023.0 if total is None else total, 1023.0))
        turned = 1023 - value if value else 0
        return 0 if turned <= 200 else turned

    want = {(i, y, x): [pixel(p, y, x, c) for c in range(3)] for i, p in rows for y in range(7) for x in range(9)}
    got = generate.radial_fades(df, "image", "points", 7, 9, 4.0, 200).collect()
    assert len(got) == len(want) and {(r.image, r.y, r.x): r.channels for r in got} == want
    monkeypatch.setattr(generate, "CELLS", 60)
    table = df.toArrow()["points"].combine_chunks()
    parts = [(i, y, v.reshape(-1, 3)) for image, ys, rows in generate._faded(table, 7, 9, 4.0, 200) for i, y, v in zip(image, ys, rows, strict=True)]
    assert len(parts) == 7 * len(rows) and all((v == [want[rows[i][0], y, x] for x in range(9)]).all() for i, y, v in parts)


def test_fades_are_dealt_out(spark):
    """A small table makes many pixels: they are several tasks, and a pixel takes less than a few microseconds."""
    spots = F.array(*(F.struct((F.col("id") * k % 400).alias("cx"), F.lit(50 * k).alias("cy"), F.array(F.lit(900), F.lit(70), F.lit(k)).alias("color")) for k in range(4)))
    df = spark.range(0, 40, 1, 1).select(F.col("id").alias("image"), spots.alias("points"))
    began = time.monotonic()
    got = generate.radial_fades(df, "image", "points", 250, 400, 90.0, 200)
    assert got.rdd.getNumPartitions() == 2
    assert got.selectExpr("count(channels)").first()[0] == 40 * 250 * 400
    assert time.monotonic() - began < 30
