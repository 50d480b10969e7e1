"""File sources: multi-key datasets, tensors, images, catalogs, reports.

All bytes come through Spark's own readers (binaryFile, json, csv, text, xml),
so any store that Spark reaches will do; decoding runs in Arrow batches.
"""

from __future__ import annotations

import io
import json
import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import decompress, header

TENSOR = "struct<shape:array<int>,dtype:string,data:binary>"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own where none is set and the session is local."""
    got = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not got and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return got or tempfile.mkdtemp(prefix="basaltine-")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and nothing is computed twice."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), most_bytes: int | None = None) -> DataFrame:
    """(path, length, modificationTime) of all files below root, sorted by nothing; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    if suffixes:
        df = df.where(F.lower("path").rlike("(" + "|".join(re.escape(s.lower()) for s in suffixes) + ")$"))
    return df if most_bytes is None else df.where(F.col("length") <= most_bytes)


def stem(path, subdir: str):
    """Path below the subdirectory without its extension."""
    return F.regexp_extract(path, "/" + re.escape(subdir) + r"/(.+?)(\.[^./]+)?$", 1)


def assembled(spark: SparkSession, root: str, subdirs: list[str], optional: list[str] = ()) -> DataFrame:
    """(stem, <subdir>_path ...): files of all subdirectories with the same stem; a sample that lacks a required file is dropped, optional ones are null.

    An empty or missing required subdirectory is an error.
    """
    out = None
    for sub in [*subdirs, *optional]:
        files = listing(spark, f"{root.rstrip('/')}/{sub}").select(stem(F.col("path"), sub).alias("stem"), F.col("path").alias(f"{sub}_path"))
        if sub in subdirs and files.isEmpty():
            raise ValueError(f"no files in {sub}")
        out = files if out is None else out.join(files, "stem", "inner" if sub in subdirs else "left")
    return out


def consistent(entries: DataFrame) -> DataFrame:
    """The entries, checked when read: no null path."""
    paths = [c for c in entries.columns if c.endswith("_path")]
    ok = F.lit(True)
    for c in paths:
        ok = ok & F.col(c).isNotNull()
    return entries.withColumn("stem", F.when(ok, F.col("stem")).otherwise(F.raise_error(F.lit("an entry lacks a file"))))


def decode_npy(data: bytes) -> np.ndarray:
    """A C-ordered array of four-byte words, as float32."""
    a = np.load(io.BytesIO(data), allow_pickle=False)
    if a.dtype.itemsize != 4:
        raise ValueError(f"npy items of {a.dtype}")
    return np.ascontiguousarray(a).view(np.float32) if a.dtype != np.float32 else np.ascontiguousarray(a)


def probe_npy(data: bytes) -> tuple[str, list[int]]:
    a = decode_npy(data)
    if 0 in a.shape:
        raise ValueError("an empty npy sample")
    return "float32", list(a.shape)


def decode_exr(data: bytes) -> np.ndarray:
    """R, G, B of a scan-line EXR (half or float; stored, ZIPS or ZIP) as rows x columns x 3 float32."""
    if struct.unpack_from("<I", data)[0] != 20000630:
        raise ValueError("not EXR")
    at, fields = 8, {}
    while data[at]:
        parts = []
        for _ in range(2):
            end = data.index(b"\0", at)
            parts.append(data[at:end].decode())
            at = end + 1
        (size,) = struct.unpack_from("<i", data, at)
        fields[parts[0]] = data[at + 4 : at + 4 + size]
        at += 4 + size
    at += 1
    x0, y0, x1, y1 = struct.unpack("<4i", fields["dataWindow"])
    width, height = x1 - x0 + 1, y1 - y0 + 1
    channels, k, raw = [], 0, fields["channels"]
    while raw[k]:
        end = raw.index(b"\0", k)
        channels.append((raw[k:end].decode(), struct.unpack_from("<i", raw, end + 1)[0]))
        k = end + 17
    if not {"R", "G", "B"} <= {c for c, _ in channels}:
        raise ValueError("EXR without R, G, B")
    packing = fields["compression"][0]
    if packing not in (0, 2, 3):
        raise ValueError(f"EXR compression {packing}")
    lines = 16 if packing == 3 else 1
    kinds = {0: np.dtype("<u4"), 1: np.dtype("<f2"), 2: np.dtype("<f4")}
    out = np.zeros((height, width, 3), np.float32)
    for offset in struct.unpack_from(f"<{-(-height // lines)}Q", data, at):
        y, size = struct.unpack_from("<ii", data, offset)
        block = data[offset + 8 : offset + 8 + size]
        rows = min(lines, y1 - y + 1)
        full = rows * width * sum(kinds[t].itemsize for _, t in channels)
        if packing and size < full:
            d = np.frombuffer(zlib.decompress(block), np.uint8).astype(np.int64)
            d[1:] -= 128
            d = (np.cumsum(d) & 255).astype(np.uint8)
            both = np.empty_like(d)
            half = (len(d) + 1) // 2
            both[0::2], both[1::2] = d[:half], d[half:]
            block = both.tobytes()
        k = 0
        for row in range(rows):
            for name, t in channels:
                n = width * kinds[t].itemsize
                if name in "RGB":
                    out[y - y0 + row, :, "RGB".index(name)] = np.frombuffer(block[k : k + n], kinds[t])
                k += n
    return out


#: Decoders by extension; images go through ``read_images``. Register others here.
DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {"npy": decode_npy, "exr": decode_exr, "compressed": decompress}


def register_decoder(extension: str, decoder: Callable[[bytes], np.ndarray]) -> None:
    DECODERS[extension.lower()] = decoder


def decoded(files: DataFrame) -> DataFrame:
    """(path, tensor) of binary files (path, content), decoded by extension; an unknown one is an error."""
    decoders = dict(DECODERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                if kind not in decoders:
                    raise ValueError(f"no decoder for .{kind}")
                a = decoders[kind](content)
                rows.append({"shape": list(a.shape), "dtype": str(a.dtype), "data": np.ascontiguousarray(a).tobytes()})
            tensor = pa.array(rows, pa.struct([("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("data", pa.binary())]))
            yield pa.RecordBatch.from_arrays([b.column(0), tensor], ["path", "tensor"])

    return files.select("path", "content").mapInArrow(run, f"path string, tensor {TENSOR}")


def read_tensors(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))


#: What a PNG of 16 bits says in its header: colour kinds and their channels, and where depth and kind stand.
_PNG, _PNG_CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 4: 2, 6: 4}


def decode_deep_png(content: bytes) -> np.ndarray:
    """A PNG of 16 bits a channel (grey or colour, not interlaced) as rows x columns x 3 uint8: the high byte of each channel, alpha dropped."""
    w, h, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", content[16:29])
    if not content.startswith(_PNG) or bits != 16 or kind not in _PNG_CHANNELS or interlaced:
        raise ValueError("not a plain PNG of 16 bits")
    at, body = 8, []
    while at + 8 <= len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        if name == b"IDAT":
            body.append(content[at + 8 : at + 8 + size])
        at += 12 + size
    n = _PNG_CHANNELS[kind]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + 2 * n * w)
    out = np.zeros((h + 1, w + 1, 2 * n), np.uint8)  # a line and a pixel of zeros before all others
    for y in range(h):
        way, line, up, now = lines[y, 0], lines[y, 1:].reshape(w, 2 * n), out[y], out[y + 1]
        if way == 0:
            now[1:] = line
        elif way == 1:
            now[1:] = np.cumsum(line, axis=0, dtype=np.uint64).astype(np.uint8)
        elif way == 2:
            now[1:] = line + up[1:]
        elif way in (3, 4):
            for x in range(w):
                left, above, corner = now[x].astype(int), up[x + 1].astype(int), up[x].astype(int)
                if way == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    d = np.abs(np.stack([p - left, p - above, p - corner]))
                    guess = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
                now[x + 1] = (line[x] + guess).astype(np.uint8)
        else:
            raise ValueError("a PNG line of an unknown kind")
    high = out[1:, 1:, ::2]
    return np.repeat(high[:, :, :1], 3, axis=2) if n < 3 else high[:, :, :3]


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, tensor) of JPG and PNG files as rows x columns x 3 uint8 in RGB; grey is repeated, alpha dropped. A file that can't be decoded is an error.

    PNG files of 16 bits keep the high byte of each channel. Spark's image reader has no such step and would keep the low one, so the
    depth is read from the header of each PNG and those files are decoded apart.
    """
    plain = lambda c: F.regexp_replace(c, "^(\\w+):/+", "$1:/")
    png = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").load(path)
    deep = png.where((F.substring("content", 1, 8) == F.lit(_PNG)) & (F.substring("content", 25, 1) == F.lit(b"\x10")))
    img = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    img = img.withColumn("key", plain("path")).join(deep.select(plain("path").alias("key")), "key", "left_anti").select("path", "height", "width", "nChannels", "data")
    kind = pa.struct([("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("data", pa.binary())])
    row = lambda a: {"shape": list(a.shape), "dtype": "uint8", "data": np.ascontiguousarray(a).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, h, w, n, data in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if h < 0 or n not in (1, 3, 4):
                    raise ValueError(f"not an image of 8 bits: {path}")
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rows.append(row(np.repeat(a, 3, axis=2) if n == 1 else a[:, :, 2::-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["path", "tensor"])

    def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([row(decode_deep_png(c)) for c in b.column(1).to_pylist()], kind)], ["path", "tensor"])

    out = f"path string, tensor {TENSOR}"
    return img.mapInArrow(run, out).unionByName(deep.select("path", "content").mapInArrow(stripped, out))


def probe(spark: SparkSession, root: str, subdirs: list[str]) -> dict[str, tuple[str, list[int], str]]:
    """(dtype, shape, extension) of the first file of each subdirectory, by path; errors for an empty one or an unknown extension."""
    out = {}
    for sub in subdirs:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/{sub}")
        least = files.agg(F.min("path")).first()[0]
        if least is None:
            raise ValueError(f"no files in {sub}")
        kind = least.rsplit(".", 1)[-1].lower()
        if kind in ("jpg", "png"):
            t = read_images(spark, least).first().tensor
            out[sub] = (t.dtype, list(t.shape), kind)
            continue
        if kind not in DECODERS:
            raise ValueError(f"no decoder for .{kind}")
        content = bytes(files.where(F.col("path") == least).first().content)
        if kind == "compressed":
            out[sub] = ("float32", list(header(content)["shape"]), kind)
        else:
            a = DECODERS[kind](content)
            if 0 in a.shape:
                raise ValueError("an empty sample")
            out[sub] = (str(a.dtype), list(a.shape), kind)
    return out


TRACK = "instances map<string,struct<is_class_instance:boolean,class_confidence:double,area:double>>, important_frames array<struct<index:int,data:map<string,struct<segmentation:array<array<int>>,bbox:array<int>,area:double,is_occluded:boolean>>,stabilizer_homography:array<double>>>, variant_frames array<int>"


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(video, frame, obj_id, row, col, height, width, area, is_occluded, is_class) of track JSON files."""
    df = spark.read.schema(TRACK).option("multiLine", True).json(path).withColumn("video", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    f = df.select("video", "instances", F.explode("important_frames").alias("f")).select("video", "instances", F.col("f.index").alias("frame"), F.explode("f.data").alias("obj_id", "d"))
    box = [F.get(F.col("d.bbox"), F.lit(k)).alias(n) for k, n in enumerate(("row", "col", "height", "width"))]
    return f.select("video", "frame", "obj_id", *box, F.col("d.area").alias("area"), F.coalesce("d.is_occluded", F.size("d.segmentation") == 0).alias("is_occluded"), F.col("instances")[F.col("obj_id")]["is_class_instance"].alias("is_class"))


CATALOG = "asset_id string, attribute string, filetype string, size long, downloadLink string, rawLink string, category string"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CATALOG)


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """(name, status, message) of each test case of JUnit XML files."""
    schema = "_classname string, _name string, failure struct<_message:string,_VALUE:string>, error struct<_message:string,_VALUE:string>, skipped struct<_message:string,_VALUE:string>"
    df = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    status = F.when(F.col("failure").isNotNull(), "failed").when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return df.select(F.concat_ws("::", "_classname", "_name").alias("name"), status.alias("status"), F.coalesce("failure._message", "error._message", "skipped._message", F.lit("")).alias("message"))


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """(name, mean, stddev, rounds, extra) of benchmark JSON files; extra is sorted (key, value) pairs."""
    schema = "benchmarks array<struct<name:string,stats:struct<mean:double,stddev:double,rounds:long>,extra_info:map<string,string>>>"
    b = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("benchmarks").alias("b"))
    return b.select("b.name", "b.stats.mean", F.coalesce("b.stats.stddev", F.lit(0.0)).alias("stddev"), F.coalesce("b.stats.rounds", F.lit(0)).alias("rounds"), F.array_sort(F.map_entries(F.coalesce("b.extra_info", F.create_map().cast("map<string,string>")))).alias("extra"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): the first line of each key of ``key : value`` text files."""
    df = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text")).where(F.col("text").contains(":"))
    pair = F.split("text", ":", 2)
    return df.groupBy(F.trim(F.regexp_replace(pair[0], "\t", "")).alias("key")).agg(F.min_by(F.trim(pair[1]), "line").alias("value"))


def frames(df: DataFrame, index: str, wanted: list[int]) -> DataFrame:
    """Rows of the wanted frames; the test reaches the scan."""
    return df.where(F.col(index).isin(wanted)) if wanted else df.limit(0)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational store, given its driver's jar."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def video_info(text: str) -> dict:
    """Size, frames and bit depth from a probe's JSON."""
    s = next(x for x in json.loads(text)["streams"] if x.get("codec_type", "video") == "video")
    depth = re.search(r"(?<=p)(\d{2})(?=le|be)", s.get("pix_fmt", ""))
    return {"width": int(s["width"]), "height": int(s["height"]), "frames": int(s.get("nb_frames") or 0), "bits": int(depth[0]) if depth else 8}


