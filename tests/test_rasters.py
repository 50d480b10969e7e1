"""Rasters, deep PNG files and raw video against direct loops and generated files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltine.operators import raster
from basaltine.sources import files, video


def bilinear(a, x, y):
    h, w, out = *a.shape[:2], 0.0
    for i in (int(np.floor(y)), int(np.floor(y)) + 1):
        for j in (int(np.floor(x)), int(np.floor(x)) + 1):
            if 0 <= i < h and 0 <= j < w:
                out = out + a[i, j] * (1 - abs(x - j)) * (1 - abs(y - i))
    return out


def test_undistorted_by_a_loop():
    a = np.random.default_rng(0).random((9, 12, 3))
    fx, fy, skew, px, py, k1, k2 = camera = np.array([20.0, 18.0, 0.7, 11.0, 9.5, 0.3, -0.1])
    got = raster.undistorted(a, camera, (24, 18))
    for v in range(9):
        for u in range(12):
            y = (v - py / 2) / (fy / 2)
            x = (u - px / 2 - skew / 2 * y) / (fx / 2)
            f = 1 + k1 * (x * x + y * y) + k2 * (x * x + y * y) ** 2
            assert got[v, u] == pytest.approx(bilinear(a, fx / 2 * x * f + px / 2, fy / 2 * y * f + py / 2))
    flat = raster.undistorted(np.full((18, 24), 7, np.uint8), np.array([20.0, 18, 0, 12, 9, -0.2, 0]), (24, 18))
    assert (flat == 7).all()
    with pytest.raises(ValueError, match="does not fit"):
        raster.undistorted(a, camera, (24, 19))


def test_projected_and_area():
    g = np.random.default_rng(1)
    a, h = g.random((7, 6)), np.array([[1.1, 0.2, 0.5], [-0.1, 0.9, 0.3], [0.01, 0.02, 1.0]])
    got, back = raster.projected(a, h, 8, 5), np.linalg.inv(h)
    for v in range(8):
        for u in range(5):
            x, y, z = back @ [u, v, 1]
            assert got[v, u] == pytest.approx(bilinear(a, x / z, y / z))
    b = g.random((7, 10, 2))
    got = raster.area_resized(b, 3, 4)
    for i in range(3):
        for j in range(4):
            wy = [max(0, min(r + 1, (i + 1) * 7 / 3) - max(r, i * 7 / 3)) for r in range(7)]
            wx = [max(0, min(c + 1, (j + 1) * 2.5) - max(c, j * 2.5)) for c in range(10)]
            assert got[i, j] == pytest.approx(sum(wy[r] * wx[c] * b[r, c] for r in range(7) for c in range(10)) / (7 / 3 * 2.5))
    assert (raster.area_resized(np.full((9, 5), 200, np.uint8), 4, 4) == 200).all()
    turned = raster.birds_eye(a, np.eye(3), (6, 7))
    assert turned.shape == (6, 7)


def test_raster_rows(spark):
    a = np.arange(12, dtype=np.uint8).reshape(4, 3)
    rows = [(1, ([4, 3], "uint8", bytearray(a.tobytes()))), (2, None)]
    df = spark.createDataFrame(rows, "id int, tensor struct<shape:array<int>,dtype:string,data:binary>")
    still = raster.undistort(df, "tensor", F.array(*(F.lit(float(x)) for x in (5, 5, 0, 1, 1, 0, 0))), (3, 4)).orderBy("id").collect()
    assert bytes(still[0].tensor.data) == a.tobytes() and still[1].tensor is None
    assert raster.area_resize(df, "tensor", 2, 1).orderBy("id").first().tensor.shape == [2, 1]
    assert raster.warp(df, "tensor", F.array(*(F.lit(float(x)) for x in np.eye(3).ravel())), (3, 4)).where("tensor is not null").count() == 1
    assert sorted((r.row, r.col, r.value) for r in raster.pixels(df, "tensor", "id").collect()) == [(i, j, float(a[i, j])) for i in range(4) for j in range(3)]


def png(a: np.ndarray, ways: list[int]) -> bytes:
    """A PNG of 16 bits whose lines are filtered in the given ways in turn."""
    h, w, n = a.shape
    raw = a.astype(">u2").view(np.uint8).reshape(h, w, 2 * n).astype(int)
    padded = np.zeros((h + 1, w + 1, 2 * n), int)
    padded[1:, 1:] = raw
    lines = b""
    for y in range(h):
        way, up, left, corner = ways[y % len(ways)], padded[y, 1:], padded[y + 1, :-1], padded[y, :-1]
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0, left, up, (left + up) // 2, near][way]
        lines += bytes([way]) + ((raw[y] - guess) % 256).astype(np.uint8).tobytes()
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    kind = {1: 0, 3: 2, 2: 4, 4: 6}[n]
    packed = zlib.compress(lines)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, kind, 0, 0, 0)) + part(b"IDAT", packed[:20]) + part(b"IDAT", packed[20:]) + part(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_deep_png(channels):
    a = np.random.default_rng(channels).integers(0, 1 << 16, (11, 6, channels))
    got = files.decode_deep_png(png(a, [0, 1, 2, 3, 4]))
    want = np.repeat(a[:, :, :1] >> 8, 3, axis=2) if channels < 3 else a[:, :, :3] >> 8
    assert (got == want).all()


def test_images_of_both_depths(spark, tmp_path):
    deep = np.array([[0x1234, 0xFF00, 0x00FF]]).reshape(1, 3, 1)
    (tmp_path / "grey.png").write_bytes(png(deep, [1]))
    (tmp_path / "colour.PNG").write_bytes(png(np.repeat(deep, 3, axis=2), [4]))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    shallow = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\x07\x09")) + part(b"IEND", b"")
    (tmp_path / "plain.png").write_bytes(shallow)
    got = {r.path.rsplit("/", 1)[1]: np.frombuffer(r.tensor.data, np.uint8).reshape(r.tensor.shape) for r in files.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"grey.png", "colour.PNG", "plain.png"}
    assert got["grey.png"][0, :, 0].tolist() == got["colour.PNG"][0, :, 2].tolist() == [18, 255, 0]
    assert got["plain.png"][0, :, 1].tolist() == [7, 9]


@pytest.mark.parametrize(("chroma", "bits"), [("420", 8), ("422", 10), ("444", 10), ("mono", 8)])
def test_video(spark, tmp_path, chroma, bits):
    """Only wanted frames are decoded: the others here are broken."""
    g, header = np.random.default_rng(bits), video.Header(7, 5, chroma, bits, (25, 1), 0)
    h, w = header.chroma_shape
    planes = [tuple(g.integers(0, 1 << bits, s) for s in ([(5, 7), (h, w), (h, w)] if h else [(5, 7)])) for _ in range(40)]
    data = video.write_y4m(planes, header)
    parsed = video.parse_header(data)
    assert (parsed.width, parsed.height, parsed.chroma, parsed.bits, parsed.rate) == (7, 5, chroma, bits, (25, 1))
    each, broken = 6 + parsed.frame_bytes, bytearray(data)
    for k in range(40):
        if k not in (3, 9, 38):
            broken[parsed.first + k * each] = 0
    (tmp_path / "a.y4m").write_bytes(bytes(broken))
    rows = video.read_frames(spark, str(tmp_path / "a.y4m"), [3, 9, 38, 99], 8).collect()
    assert sorted(r.frame for r in rows) == [3, 9, 38] and {(r.height, r.width, r.bits) for r in rows} == {(5, 7, bits)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for where, want in (("frame > 37 and frame <= 38 and bits > 1", [38]), ("frame in (9, 3, 50)", [3, 9]), ("frame < 4 and frame >= 3", [3]), ("frame = 99", [])):
        assert sorted(r.frame for r in spark.read.format("y4m_frames").options(framesPerPartition=8, pushdown="true").load(str(tmp_path / "a.y4m")).where(where).collect()) == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    for r in rows:
        got = np.frombuffer(r.tensor.data, r.tensor.dtype).reshape(r.tensor.shape)
        p, scale, top = planes[r.frame], 1 << (bits - 8), (1 << bits) - 1
        for y, x in ((0, 0), (4, 6), (2, 3)):
            down, across = video._CHROMA[chroma]
            luma = (p[0][y, x] / scale - 16) / 219
            b, c = ((p[k][y // down, x // across] / scale - 128) / 224 for k in (1, 2)) if h else (0, 0)
            want = [luma + 1.402 * c, luma - 0.344136 * b - 0.714136 * c, luma + 1.772 * b]
            assert got[y, x].tolist() == [int(np.clip(np.rint(v * top), 0, top)) for v in want]
    with pytest.raises(Exception, match="no frame"):
        video.read_frames(spark, str(tmp_path / "a.y4m")).collect()
    (tmp_path / "b.y4m").write_bytes(data[:-1])
    with pytest.raises(Exception, match="ends within"):
        video.read_frames(spark, str(tmp_path / "b.y4m")).collect()


def test_mosaic(spark):
    """Turned and scaled rasters on tiles of both signs, against a loop over all pixels."""
    g = np.random.default_rng(3)
    rasters = [g.random((6, 9)), g.random((5, 5)), g.random((6, 9))]
    maps = [np.array([[1.5, 0.3, -4.0], [-0.2, 1.2, 2.0], [0, 0, 1]]), np.array([[0.8, -0.6, 3.0], [0.6, 0.8, -5.0], [0.01, 0, 1]]), np.eye(3)]
    rows = [(([*a.shape], "float64", bytearray(a.tobytes())), h.ravel().tolist()) for a, h in zip(rasters, maps, strict=True)] + [(None, maps[0].ravel().tolist())]
    df = spark.createDataFrame(rows, "tensor struct<shape:array<int>,dtype:string,data:binary>, h array<double>").repartition(3)
    got = {}
    for r in raster.mosaic(df, "tensor", "h", 8).collect():
        mean, hits = (np.frombuffer(t.data, t.dtype).reshape(t.shape) for t in (r.average, r.hits))
        got |= {(r.tile_row * 8 + i, r.tile_col * 8 + j): (mean[i, j], hits[i, j]) for i in range(8) for j in range(8) if hits[i, j]}
    want = {}
    for y in range(-20, 25):
        for x in range(-20, 25):
            values = []
            for a, h in zip(rasters, maps, strict=True):
                u, v, w = np.linalg.inv(h) @ [x, y, 1]
                u, v = round(u / w, 9), round(v / w, 9)
                if 0 <= u <= a.shape[1] - 1 and 0 <= v <= a.shape[0] - 1:
                    values.append(float(bilinear(a, u, v)))
            if values:
                want[y, x] = (pytest.approx(sum(values) / len(values), abs=1e-7), len(values))
    assert got == want


def test_files_all_or_none(spark, tmp_path):
    from basaltine.sources.file_sink import write_files

    out, schema = tmp_path / "out", "n string, c binary"
    there = lambda: sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file())
    rows = [(f"d{k % 3}/f{k}.bin", bytearray([k] * k)) for k in range(20)]
    write_files(spark.createDataFrame(rows, schema).repartition(4), "n", "c", str(out))
    assert there() == sorted([*(n for n, _ in rows), "_SUCCESS"]) and (out / "d1/f4.bin").read_bytes() == b"\x04" * 4
    # A task that fails after others have written, a repeated name, a name that is there, one outside.
    late = spark.createDataFrame([(f"late{k}", bytearray(b"x")) for k in range(8)] + [("bad", None)], schema).repartitionByRange(4, "n")
    for df in (late, spark.createDataFrame([("a", bytearray()), ("a", bytearray())], schema), spark.createDataFrame([("new", bytearray()), (rows[1][0], bytearray())], schema), spark.createDataFrame([("../x", bytearray())], schema)):
        with pytest.raises(Exception, match="name|there already"):
            write_files(df, "n", "c", str(out))
        assert there() == sorted([*(n for n, _ in rows), "_SUCCESS"]) and not [p for p in out.iterdir() if p.name.startswith("_staging")]
    write_files(spark.createDataFrame([("only", bytearray(b"1"))], schema), "n", "c", str(out), "overwrite")
    assert there() == ["_SUCCESS", "only"]
