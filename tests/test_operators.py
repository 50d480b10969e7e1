"""Operators against plain Python and NumPy."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basaltine.functions import codec, exif
from basaltine.operators import augment, catalog, dataset, detect, geometry, graph, rng, series, sessions, tracks


def test_uniform_columns_equal_numbers(spark):
    rows = spark.range(64).select("id", rng.uniform(F.col("id"), 0).alias("a"), rng.uniform(F.col("id"), 3).alias("b")).collect()
    for r in rows:
        assert r.a == rng.uniform_number(r.id, 0) and r.b == rng.uniform_number(r.id, 3)
        assert 0 <= r.a <= 1


@pytest.mark.parametrize("seed", range(0, 64, 7))
def test_raster_flip_and_crop(seed):
    a = np.arange(40 * 30 * 3, dtype=np.float32).reshape(40, 30, 3)
    want = a[::-1] if rng.uniform_number(seed, 0) <= 0.5 else a
    want = want[:, ::-1] if rng.uniform_number(seed, 1) <= 0.5 else want
    assert (augment.Flip(0.5, 0.5).raster(a, seed) == want).all()
    c = augment.RandomCrop(10, 8, 20, 16).raster(a, seed)
    u = rng.uniform_number(seed, 0)
    assert c.shape[:2] == (10 + int(u * 10), 8 + int(u * 8))
    r, k = divmod(int(c[0, 0, 0]) // 3, 30)
    assert (a[r : r + c.shape[0], k : k + c.shape[1]] == c).all()


def test_points_follow_the_raster(spark):
    """A marked pixel and its point end at the same place."""
    pipe = augment.Pipe(augment.Flip(0.5, 0.5), augment.RandomCrop(24, 20, 24, 20), augment.Pad(40, 40))
    pts = [(r, c) for r in range(10, 30, 4) for c in range(8, 24, 5)]
    df = spark.createDataFrame([(s, [(r, c) for r, c in pts]) for s in range(16)], "id long, pts array<struct<r:int,c:int>>")
    moved = pipe.points(df, "pts", F.col("id"), F.lit(40), F.lit(32)).collect()
    for row in moved:
        for (r, c), p in zip(pts, row.pts, strict=True):
            a = np.zeros((40, 32, 1), np.float32)
            a[r, c] = 1
            for s in pipe.stages:
                a = s.raster(a, row.id)
            at = np.argwhere(a[..., 0] == 1)
            if len(at):
                assert tuple(at[0]) == (p.r, p.c)
        assert (row.out_h, row.out_w) == (40, 40)


def test_raster_pipe_in_spark(spark):
    a = np.repeat(np.arange(32, dtype=np.uint8)[:, None, None] * 4 + 60, 24 * 3, axis=1).reshape(32, 24, 3)
    df = spark.createDataFrame([(0, 5, ([32, 24, 3], "uint8", bytearray(a.tobytes())))], "id long, seed long, tensor struct<shape:array<int>,dtype:string,data:binary>")
    t = augment.Pipe(augment.Resize(16, 12)).rasters(df).first().tensor
    assert t.shape == [16, 12, 3]
    got = np.frombuffer(t.data, np.uint8).reshape(16, 12, 3)
    assert np.abs(got.astype(float) - (a[0::2, 0::2].astype(float) + a[1::2, 0::2]) / 2).max() <= 1


def test_resize_ramp():
    i, j = np.mgrid[0:128, 0:64].astype(np.float32)
    got = augment.Resize(48, 36).raster(np.stack([i, j, i + j], axis=2), 0)
    want = (np.arange(48) + 0.5) * 128 / 48 - 0.5
    assert np.abs(got[:, 0, 0] - want).max() < 0.5


def test_pipe_rules():
    for bad in (lambda: augment.Pipe(), lambda: augment.Flip(0, 0), lambda: augment.RandomCrop(5, 5, 4, 9), lambda: augment.Pipe(augment.Flip(1, 1)), lambda: augment.Pipe(augment.Resize(4, 4), augment.RandomCrop(1, 1, 2, 2))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        augment.Resize(4, 4).raster(np.zeros((8, 8, 1), np.uint8), 0)


def test_orientation_and_roi():
    a = np.arange(6).reshape(2, 3, 1)
    assert augment.orient(a, 6).shape == (3, 2, 1) and (augment.orient(augment.orient(a, 6), 8) == a).all()
    assert (augment.orient(augment.orient(a, 5), 5) == a).all() and (augment.orient(augment.orient(a, 7), 7) == a).all()
    assert augment.padded_roi(np.zeros((50, 50)), 5, 40, 10, 8).shape == (25, 20)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=4), st.booleans(), st.booleans(), st.integers(0, 99))
def test_codec_round_trip(shape, half, shuffle, seed):
    a = np.random.default_rng(seed).normal(size=shape).astype(np.float32)
    for perms in ((), codec.all_permutations(len(shape))):
        for codecs in ((), ("zstd3", "zstd22")):
            b = codec.decompress(codec.compress(a, codec.Options(half, shuffle, perms, codecs)))
            assert b.shape == a.shape
            assert (b == (a.astype(np.float16).astype(np.float32) if half else a)).all()


def test_codec_details():
    data = np.random.default_rng(1).integers(0, 255, 40_004).astype(np.uint8).tobytes()
    assert codec.bit_unshuffle(codec.bit_shuffle(data, 4), 4) == data
    packed = codec.compress(np.ones((3, 3, 4)))
    assert codec.TRAILER.size == 104 and (len(packed) - 104) % 16 == 0
    assert codec.header(packed)["shape"] == [3, 3, 4]
    with pytest.raises(ValueError):
        codec.compress(np.ones((2, 2)), codec.Options(permutations=((0, 0),)))
    with pytest.raises(ValueError):
        codec.decompress(b"\0" * 200)


def test_exif():
    for order, mark in (("<", b"II"), (">", b"MM")):
        import struct

        ifd = struct.pack(f"{order}H", 2) + struct.pack(f"{order}HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack(f"{order}HHII", 0x8769, 4, 1, 38) + struct.pack(f"{order}I", 0)
        sub = struct.pack(f"{order}H", 1) + struct.pack(f"{order}HHII", 0x920A, 5, 1, 56) + struct.pack(f"{order}I", 0)
        tiff = mark + struct.pack(f"{order}HI", 42, 8) + ifd + sub + struct.pack(f"{order}II", 425, 100)
        body = b"Exif\0\0" + tiff
        jpg = b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda"
        assert exif.orientation(jpg) == 6 and exif.focal_length(jpg) == 4.25
    assert exif.orientation(b"") is None and exif.focal_length(None) is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=12))
def test_delta_rule(values):
    kept = series.sampled_rows(np.array(values, float), 3)
    last = None
    for i, v in enumerate(values):
        assert (i in kept) == (last is None or abs(v - last) > 3)
        last = v if i in kept else last


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=9))
def test_best_partition_is_a_cheapest_cut(values):
    e = np.array(values, float)
    picks = series.best_partition(e)
    n, least = len(e), max(1, round(0.15 * len(e)))
    k = len(picks)
    cuts = [c for c in itertools.combinations(range(1, n), k - 1) if all(b - a >= least for a, b in itertools.pairwise((0, *c, n)))]
    best = min(sum(e[a:b].min() for a, b in itertools.pairwise((0, *c, n))) for c in cuts)
    assert sum(e[picks]) == best and e[picks].max() <= 3 * e[picks].mean() + 1e-9


def test_edge_mean_short_series(spark):
    for n in (1, 2, 5, 40):
        df = spark.createDataFrame([(0, i, float(i * i % 17)) for i in range(n)], "k int, i long, v double")
        got = [r["mean"] for r in series.edge_mean(df, "k", "i", "v").orderBy("idx").collect()]
        e = [float(i * i % 17) for i in range(n)]
        want = [sum(e[min(max(j, 0), n - 1)] for j in range(i - 8, i + 7)) / 15 for i in range(n + 2)]
        assert np.allclose(got, want)


def test_best_lut():
    h = np.array([5, 1, 1, 7, 2, 9])
    lut = series.best_lut(h, 3)
    assert (np.diff(lut) >= 0).all()
    got = sum(h[lut == k].sum() - h[lut == k].max(initial=0) for k in range(3))
    best = min(sum(sum(h[a:b]) - max(h[a:b], default=0) for a, b in itertools.pairwise((0, *c, 6))) for c in itertools.combinations_with_replacement(range(7), 2) if all(b - a <= 4 for a, b in itertools.pairwise((0, *c, 6))))
    assert got == best


def test_fold_edits(spark):
    rng_ = np.random.default_rng(2)
    log = [(int(rng_.integers(3)), i, str(rng_.choice(["delete", "undo", "toggle"])), int(rng_.integers(5))) for i in range(120)]
    got = {r.k: r.deleted for r in tracks.fold_edits(spark.createDataFrame(log, "k int, t int, kind string, item int"), "k", ["t"], "kind", "item", 4).collect()}
    for k in range(3):
        gone, undo = [], []
        for _, _, kind, x in (r for r in log if r[0] == k):
            if kind == "delete":
                gone += [x] if x not in gone else []
                undo = (undo + [x])[-4:]
            elif kind == "undo" and undo:
                y = undo.pop()
                gone = [g for g in gone if g != y]
            elif kind == "toggle":
                gone = [g for g in gone if g != x] if x in gone else gone + [x]
        assert got[k] == sorted(gone)


def test_nms_and_matching():
    b = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [20, 20, 30, 30], [0, 0, 0, 0]], float)
    assert detect.suppressed(b, np.array([0.5, 0.9, 0.1, 0.2]), 0.5) == [1, 3, 2]
    assert detect.matched(b, np.array([0.5, 0.9, 0.1, 0.2]), b[:1], 0.5).tolist() == [False, True, False, False]


def test_average_precision(spark):
    hits = [("a", 0, 0.9, True), ("a", 1, 0.8, False), ("a", 2, 0.7, True), ("a", 3, 0.6, False)]
    got = detect.average_precision(spark.createDataFrame(hits, "image string, box_id long, score double, hit boolean"), ["image"], F.lit(3)).first().ap
    curve = [(0.0, 1.0), (1.0, 0.0)]
    tp = 0
    for n, h in enumerate(hits, 1):
        tp += h[3]
        curve.append((tp / 3, tp / n))
    curve.sort(key=lambda x: x[0], reverse=True)
    top, area, out = -1.0, 0.0, []
    for r, p in curve:
        top = max(top, p)
        out.append((r, top))
    for (r1, p1), (r2, p2) in itertools.pairwise(out):
        area += (p1 + p2) / 2 * (r1 - r2)
    assert abs(got - area) < 1e-9


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=7), st.integers(0, 30))
def test_water_fill(spark, xs, target):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x long")
    got = [r.kept for r in detect.water_fill(df, [], "i", "x", F.lit(target)).orderBy("i").collect()]
    want = list(xs)
    while sum(want) > target and max(want) > 0:
        want[want.index(max(want))] -= 1
    assert got == want


def test_forest():
    rng_ = np.random.default_rng(3)
    edges = [(i, j, int(rng_.integers(1, 50))) for i in range(9) for j in range(i) if rng_.random() < 0.4 and (i < 6) == (j < 6)]
    got = graph.spanning_forest(edges, list(range(9)))
    root = list(range(9))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = n = 0
    for a, b, w in sorted(edges, key=lambda e: -e[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total, n = total + w, n + 1
    assert sum(w for *_, w in got) == total and len(got) == n


def test_merged_ids(spark):
    nodes = spark.range(10)
    votes = spark.createDataFrame([(1, 2, 3), (2, 5, 3), (7, 8, 3), (5, 9, 4)], "a long, b long, votes long")
    got = {r.id: r.merged for r in tracks.merged_ids(nodes, votes).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7, 8: 7, 9: 1}


def test_merged_ids_of_a_chain(spark):
    """A long chain of ids in random order is one group."""
    order = np.random.default_rng(2).permutation(600).tolist()
    votes = spark.createDataFrame([(min(x), max(x), 1) for x in zip(order, order[1:], strict=False)], "a long, b long, votes long")
    got = {r.id: r.merged for r in tracks.merged_ids(spark.range(601), votes).collect()}
    assert got == {i: 0 for i in range(600)} | {600: 600}


def test_similarity_matrix(spark, small):
    """Every vector stands against every query vector."""
    from basaltine.plans import QUERIES

    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    got = {(r.a, r.b): r.similarity for r in QUERIES["similarity_matrix"](spark, small).collect()}
    assert set(got) == {(a, b) for a in e if a % 100 == 0 for b in e}
    assert all(abs(v - e[a] @ e[b]) < 2e-6 for (a, b), v in got.items())


def test_neighbours_in_blocks(spark, small, monkeypatch):
    """More queries than travel with the code give the same rows, from pairs of blocks."""
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    few = graph.cosine_neighbours(e.where("vec_id % 10 = 0"), e, "vec_id", "embedding", 3).collect()
    monkeypatch.setattr(graph, "FEW_QUERIES", 5)
    monkeypatch.setattr(graph, "BLOCK_ROWS", 20)
    many = graph.cosine_neighbours(e.where("vec_id % 10 = 0"), e, "vec_id", "embedding", 3).collect()
    assert len(few) == 150 and sorted(map(tuple, few)) == sorted(map(tuple, many))


def test_long_series_partition():
    """A series of 20,000 frames takes no square of them."""
    g = np.random.default_rng(3)
    e = g.random(20_000)
    picks = series.best_partition(e)
    assert len(picks) == 6 and picks == sorted(picks)


def test_sampled_counts(spark):
    """Three to seven of each group, none twice, the same in every run."""
    df = spark.range(400).selectExpr("id", "id % 20 AS g")
    one = catalog.sampled(df, "g", "id", 3, 7, 1).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, catalog.sampled(df.repartition(3), "g", "id", 3, 7, 1).collect()))
    n = pd.Series([r.g for r in one]).value_counts()
    assert len(n) == 20 and n.between(3, 7).all() and n.nunique() > 1


def test_propagation_down_a_deep_chain(spark):
    """To the end of a chain of more than a hundred edges; a cycle is an error."""
    roots = spark.createDataFrame([(0, 1)], "node long, value long")
    steps = spark.range(105).selectExpr("id AS parent", "id + 1 AS child", "1L AS value").coalesce(1)
    got = {r.node: r.value for r in graph.propagated(roots, steps, lambda value, by: value + by).collect()}
    assert got == {i: i + 1 for i in range(106)}
    cycle = spark.createDataFrame([(0, 1, 1), (1, 0, 1)], "parent long, child long, value long")
    with pytest.raises(ValueError):
        graph.propagated(roots, cycle, lambda value, by: value + by)


def test_geometry():
    g = np.random.default_rng(4)
    p = g.normal(size=(20, 3))
    a = 0.7
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    q = 2.5 * p @ r.T + [1, 2, 3]
    r2, t2, s2 = geometry.rigid(p, q, True)
    assert np.allclose(r, r2) and np.allclose(t2, [1, 2, 3]) and abs(s2 - 2.5) < 1e-9
    plane = np.stack([*np.mgrid[0:5, 0:4].reshape(2, -1), np.zeros(20)], axis=1)
    k = np.array([[800, 0, 320], [0, 780, 240], [0, 0, 1.0]])
    hs, poses = [], []
    for tilt in (0.2, -0.3, 0.4):
        rx = np.array([[1, 0, 0], [0, np.cos(tilt), -np.sin(tilt)], [0, np.sin(tilt), np.cos(tilt)]])
        ry = np.array([[np.cos(tilt / 2), 0, np.sin(tilt / 2)], [0, 1, 0], [-np.sin(tilt / 2), 0, np.cos(tilt / 2)]])
        pose = (rx @ ry, np.array([-1, -1, 9.0]))
        poses.append(pose)
        hs.append(geometry.homography(plane[:, :2], geometry.project(plane, k, *pose)))
    assert np.allclose(geometry.intrinsics(hs), k, atol=1e-3)
    pix = [geometry.project(plane, k, *p, 0.1, -0.02) for p in poses]
    assert np.allclose(geometry.distortion([plane] * 3, pix, k, poses), (0.1, -0.02), atol=1e-6)
    assert np.allclose(geometry.undistorted(pix[0], k, 0.1, -0.02), geometry.project(plane, k, *poses[0]), atol=1e-3)
    fit = geometry.refine(lambda x: np.array([x[0] ** 2 - 4, x[1] - x[0]]), np.array([1.0, 0.0]))
    assert np.allclose(fit, [2, 2])


def test_polygons():
    a = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    iou, inside = tracks.polygon_iou(a, a + [2, 2])
    assert abs(iou - 4 / 28) < 1e-9 and abs(inside - 0.25) < 1e-9


def test_split_and_batches(spark):
    d = dataset.Dataset(spark.range(10).withColumnRenamed("id", "stem"), "stem", 1)
    parts = d.split_train_validation_test(0.5, 0.2)
    assert [len(p) for p in parts] == [5, 2, 3]
    assert sorted(r.stem for p in parts for r in p.entries.collect()) == list(range(10))
    with pytest.raises(ValueError):
        dataset.split_bounds(3, 0.9, 0.1)
    got = [r.entry_idx for r in d.batches(4, 0, 6).orderBy("batch_id", "pos").collect()]
    assert got == [i % 10 for i in range(24)]
    c = dataset.BatchCursor(d, 4)
    c.get_next_batch(), c.get_next_batch()
    c.delivered(0)
    assert c.rewind() == 1


def test_sessions(spark):
    cfg = sessions.with_default_config(spark.createDataFrame([], sessions.CONFIG))
    assert cfg.first().session_image_cap == 20
    assert set(sessions.migrated({}, spark)) == {"sessions", "images", "dedup_index", "uploads", "config"}
    rows = [("a", 1, "x", "image/png", 10), ("a", 2, "x", "image/png", 10), ("b", 3, "y", "image/png", 10), ("b", 4, "z", "text/plain", 10), ("b", 5, "w", "image/png", 10)]
    inc = spark.createDataFrame(rows, "session_id string, seq int, sha256 string, original_mime string, size_bytes long")
    tables = sessions.migrated({}, spark)
    known = spark.createDataFrame([("w", 1)], sessions.DEDUP)
    got = sorted(r.seq for r in sessions.accepted(inc, tables["images"], known, 20).collect())
    assert got == [1, 3]


def test_catalog(spark):
    df = spark.createDataFrame([('{"a": {"n": 1}, "b": {"n": 2}}',), ('[{"id": "c", "n": 3}]',)], "t string")
    assert sorted(r.id for r in catalog.catalog_entries(df, "t").collect()) == ["a", "b", "c"]
    fit = spark.range(1).select(catalog.fitted_scale([F.lit(x) for x in (1.0, 2.0, 3.0)], [F.lit(x) for x in (6.0, 2.0, 4.0)]).alias("f")).first().f
    assert fit["axes"] == "120" and abs(fit["scale"] - 2.0) < 1e-9
    with pytest.raises(Exception, match="unknown kind"):
        spark.range(1).select(catalog.object_kind(F.lit("zzz"), ["pen"])).collect()
    assert catalog.camera_pairs(spark, 3).count() == 6
