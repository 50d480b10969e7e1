"""File sources and sinks on small trees."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltine.functions import codec, columns
from basaltine.operators.dataset import Dataset
from basaltine.sources import files, sinks


@pytest.fixture
def tree(tmp_path):
    for sub in ("a", "b"):
        os.makedirs(tmp_path / sub / "deep")
    for i in range(10):
        np.save(tmp_path / "a" / f"file{i}.npy", np.full((3, 3), i, np.float32))
        if i != 4:
            (tmp_path / "b" / f"file{i}.compressed").write_bytes(codec.compress(np.full((2, 2), i, np.float32)))
    np.save(tmp_path / "a" / "deep" / "x.npy", np.zeros((3, 3), np.float32))
    return str(tmp_path)


def test_assembly(spark, tree):
    e = files.assembled(spark, tree, ["a", "b"])
    assert sorted(r.stem for r in e.collect()) == sorted(f"file{i}" for i in range(10) if i != 4)
    assert files.consistent(e).count() == 9
    with pytest.raises(Exception):
        files.assembled(spark, tree, ["a", "missing"]).count()
    d = Dataset.from_subdirs(spark, tree, ["a"])
    assert len(d) == 11
    assert files.listing(spark, tree, (".npy",)).count() == 11


def test_decoding(spark, tree):
    got = {os.path.basename(r.path): np.frombuffer(r.tensor.data, r.tensor.dtype).reshape(r.tensor.shape) for r in files.read_tensors(spark, tree).collect()}
    assert (got["file3.npy"] == 3).all() and got["file3.npy"].shape == (3, 3)
    assert (got["file3.compressed"] == 3).all()
    p = files.probe(spark, tree, ["a", "b"])
    assert p["a"] == ("float32", [3, 3], "npy") and p["b"][1] == [2, 2]
    with pytest.raises(ValueError):
        files.decode_npy(_npy(np.zeros(3, np.float64)))
    files.register_decoder("raw", lambda b: np.frombuffer(b, np.uint8))
    assert "raw" in files.DECODERS


def _npy(a):
    import io

    f = io.BytesIO()
    np.save(f, a)
    return f.getvalue()


def test_images(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 255, (20, 30, 3))
    jvm = spark.sparkContext._jvm
    img = jvm.java.awt.image.BufferedImage(30, 20, 1)
    for y in range(20):
        for x in range(30):
            img.setRGB(x, y, int(a[y, x, 0]) << 16 | int(a[y, x, 1]) << 8 | int(a[y, x, 2]))
    jvm.javax.imageio.ImageIO.write(img, "png", jvm.java.io.File(str(tmp_path / "x.png")))
    t = files.read_images(spark, str(tmp_path)).first().tensor
    assert (np.frombuffer(t.data, np.uint8).reshape(t.shape) == a).all()


def test_exr():
    h, w = 5, 4
    a = np.random.default_rng(1).random((h, w, 3)).astype(np.float32)
    attr = lambda n, k, v: n.encode() + b"\0" + k.encode() + b"\0" + struct.pack("<i", len(v)) + v
    chans = b"".join(c + b"\0" + struct.pack("<iB3xii", 2, 0, 1, 1) for c in (b"B", b"G", b"R")) + b"\0"
    head = struct.pack("<II", 20000630, 2) + attr("channels", "chlist", chans) + attr("compression", "compression", b"\0") + attr("dataWindow", "box2i", struct.pack("<4i", 0, 0, w - 1, h - 1)) + b"\0"
    at, offs, body = len(head) + 8 * h, b"", b""
    for y in range(h):
        line = b"".join(a[y, :, k].tobytes() for k in (2, 1, 0))
        offs += struct.pack("<Q", at + len(body))
        body += struct.pack("<ii", y, len(line)) + line
    assert (files.decode_exr(head + offs + body) == a).all()


def test_reports(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<testsuites><testsuite><testcase classname="m" name="a"/><testcase classname="m" name="b"><failure message="no">x</failure></testcase><testcase classname="m" name="c"><skipped message="later"/></testcase></testsuite></testsuites>')
    got = {r.name: (r.status, r.message) for r in files.read_junit(spark, str(tmp_path / "r.xml")).collect()}
    assert got == {"m::a": ("passed", ""), "m::b": ("failed", "no"), "m::c": ("skipped", "later")}
    df = spark.createDataFrame([("g", "passed", "b"), ("g", "failed", "z"), ("g", "odd", "a")], "g string, s string, n string")
    assert [r.n for r in sinks.report_rows(df, "g", "s", "n").collect()] == ["z", "b", "a"]
    assert sinks.report_markdown(df, "g", "s", "n").first().text.startswith("## g\n\n- failed: z")
    (tmp_path / "b.json").write_text(json.dumps({"benchmarks": [{"name": "x", "stats": {"mean": 1.5}, "extra_info": {"k": "v"}}]}))
    assert files.read_benchmarks(spark, str(tmp_path / "b.json")).first().rounds == 0
    (tmp_path / "cpu").write_text("model name\t: A: B\nmodel name\t: C\nflags : x\n")
    assert {r.key: r.value for r in files.read_key_values(spark, str(tmp_path / "cpu")).collect()} == {"model name": "A: B", "flags": "x"}
    assert files.video_info('{"streams": [{"codec_type": "video", "width": 4, "height": 3, "nb_frames": "7", "pix_fmt": "yuv420p10le"}]}') == {"width": 4, "height": 3, "frames": 7, "bits": 10}


def test_tracks(spark, tmp_path):
    track = {"instances": {"1": {"is_class_instance": True, "class_confidence": 0.9, "area": 5.0}}, "important_frames": [{"index": 3, "data": {"1": {"segmentation": [], "bbox": [1, 2, 3, 4], "area": 12.0}}, "stabilizer_homography": [1.0] * 9}], "variant_frames": []}
    (tmp_path / "v.json").write_text(json.dumps(track))
    r = files.read_tracks(spark, str(tmp_path / "v.json")).first()
    assert (r.video, r.frame, r.obj_id, r.row, r.width, r.is_occluded, r.is_class) == ("v", 3, "1", 1, 4, True, True)
    out = str(tmp_path / "out")
    sinks.write_tracks(files.read_tracks(spark, str(tmp_path / "v.json")), out)
    assert spark.read.json(out).first().important_frames[0]["index"] == 3


def test_writers(spark, tree, tmp_path):
    out = str(tmp_path / "packed")
    sinks.write_compressed(files.read_tensors(spark, tree + "/a"), out)
    r = spark.read.parquet(out).where("name = 'file7.npy.compressed'").first()
    assert (codec.decompress(bytes(r.content)) == 7).all()
    sinks.write_quoted_csv(spark.createDataFrame([('a"b', None)], "x string, y string"), str(tmp_path / "csv"))
    text = "".join(open(tmp_path / "csv" / f).read() for f in os.listdir(tmp_path / "csv") if f.endswith(".csv"))
    assert '"x","y"\n' in text and '"a""b"' in text


def test_column_functions(spark):
    one = spark.range(1)
    r = one.select(
        columns.basename(F.lit("a/b/c.tar/")).alias("base"),
        columns.splitext(F.lit("x.y.png"))[1].alias("ext"),
        columns.integer_keys(F.create_map(F.lit("3"), F.lit("x"), F.lit("q"), F.lit("y"))).alias("keys"),
        columns.merged_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))).alias("merged"),
        columns.uint_at(F.unhex(F.lit("0102FF")), 1, 2).alias("be"),
        columns.uint_at(F.unhex(F.lit("0102FF")), 1, 2, False).alias("le"),
        columns.argsort(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("order"),
        columns.last_n(F.sequence(F.lit(1), F.lit(12)), 8).alias("last"),
        columns.gather(F.array(F.lit(5), F.lit(6)), F.array(F.lit(1), F.lit(9))).alias("got"),
        columns.linspace(0.0, 1.0, 5).alias("lin"),
        columns.problem("E", n=F.lit(3)).alias("problem"),
        columns.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("soft"),
    ).first()
    assert (r.base, r.ext, r["keys"], r.merged) == ("c.tar", ".png", {3: "x"}, {"a": 2})
    assert (r.be, r.le, r.order, r["last"]) == (0x02FF, 0xFF02, [1, 2, 0], list(range(5, 13)))
    assert r.got == [6, None] and r.lin == [0, 0.25, 0.5, 0.75, 1] and r.problem.params.n == "3" and r.soft == [0.5, 0.5]
    assert one.select(sinks.padded_labels(F.array(F.array(F.lit(1.0))), 3).alias("x")).first().x[1] == [0.0] * 6


def test_an_undecodable_image_is_an_error(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not an image"):
        files.read_images(spark, str(tmp_path)).collect()


def test_meta_and_metrics(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from basaltine.sources import sinks

    df = spark.createDataFrame([("a", 1), ("b", None)], "name string, n long")
    out, seen = sinks.measured(df, "passed", F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))
    sinks.write_meta(out.coalesce(1), str(tmp_path / "meta"))
    lines = [json.loads(line) for f in (tmp_path / "meta").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["name"]) == [{"name": "a", "n": 1}, {"name": "b", "n": None}]
    assert seen.get == {"rows": 2, "total": 1}
