"""Asset catalogs: map types, resolutions, preferences, generators and messages."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rng import uniform

# Name parts that tell a texture map's kind, tried in this order.
MAP_KINDS = (
    ("normal", ("normal",)),
    ("roughness", ("rough",)),
    ("displacement", ("disp", "height")),
    ("ao", ("ao", "ambientocclusion")),
    ("basecolor", ("albedo", "basecolor", "_col", "color")),
)
RESOLUTION = r"([0-9]{1,2})K(?=[_.-])"
LEADING_RESOLUTION = r"^(\d+)K"


def canonical_map(name: Column) -> Column:
    """The kind of map that a name tells; null if none."""
    low, out = F.lower(name), None
    for kind, parts in MAP_KINDS:
        test = None
        for p in parts:
            test = low.contains(p) if test is None else test | low.contains(p)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def resolution(name: Column) -> Column:
    """The number before K in an upper-cased name; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(name), RESOLUTION, 1), F.lit("")).cast("int")


def any_keyword(name: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(name).contains(F.lower(w)))


def any_category(categories: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.transform(categories, F.lower), F.array(*(F.lit(w.lower()) for w in wanted)))


def grouped_assets(df: DataFrame, asset: str, seq: str, most: int) -> DataFrame:
    """(asset, first_seq, files) of the first assets in order of appearance, at most ``most`` (a feature: a report of the first)."""
    g = df.groupBy(asset).agg(F.min(seq).alias("first_seq"), F.array_sort(F.collect_list(F.struct(seq, *(c for c in df.columns if c not in (asset, seq))))).alias("files"))
    return g.orderBy("first_seq").limit(most)


def resolution_pick(df: DataFrame, asset: str, seq: str, label: str, size: str, preferred: list[str]) -> DataFrame:
    """One row for each asset: the first in file order with a preferred label, else the largest by bytes, the first of equals."""
    rest = [c for c in df.columns if c != asset]
    liked = F.col(label).isin(preferred)
    g = df.groupBy(asset).agg(F.min_by(F.struct(*rest), F.when(liked, F.col(seq))).alias("a"), F.max_by(F.struct(*rest), F.struct(F.col(size), -F.col(seq))).alias("b"))
    return g.select(asset, F.coalesce("a", "b").alias("x")).select(asset, "x.*")


def first_available(available: Column, preferred: list[str]) -> Column:
    """The first preferred value that is available, else the first available."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, preferred)), lambda p: F.array_contains(available, p)), F.lit(0)), F.get(available, F.lit(0)))


def catalog_entries(df: DataFrame, text: str) -> DataFrame:
    """(id, entry) rows of a JSON text that holds a map of objects or a list of objects with an id."""
    as_map = F.from_json(F.when(F.ltrim(text).startswith("{"), F.col(text)), "map<string,string>")
    as_list = F.from_json(F.when(F.ltrim(text).startswith("["), F.col(text)), "array<string>")
    pairs = F.when(as_map.isNotNull(), F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("entry")))).otherwise(F.transform(as_list, lambda e: F.struct(F.get_json_object(e, "$.id").alias("id"), e.alias("entry"))))
    return df.select(F.inline(pairs))


# Sides of known things in metres, by kind, tried in this order.
REAL_SIZES = (
    ("keys", 0.07, 0.07, 0.07),
    ("pen", 0.14, 0.008, 0.008),
    ("credit-card", 0.0856, 0.05398, 0.00076),
    ("cup", 0.10, 0.08, 0.08),
    ("smartphone", 0.15, 0.075, 0.008),
    ("tape", 0.06, 0.06, 0.025),
    ("microsd", 0.015, 0.011, 0.001),
    ("macrosd", 0.032, 0.024, 0.0021),
)


def object_kind(name: Column, kinds: list[str]) -> Column:
    """The first kind that the name contains; an error for a name of none."""
    out = None
    for k in kinds:
        test = F.lower(name).contains(k.lower())
        out = F.when(test, k) if out is None else out.when(test, k)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown kind of object: "), name)))


def fitted_scale(model: list[Column], real: list[Column]) -> Column:
    """Struct (cost, order, scale, axes): of the orders of the real sides, the one whose ratios to the model's sides differ least from their median, which is the scale."""
    def fit(i: int, p: tuple[int, ...]) -> Column:
        r = [real[p[k]] / model[k] for k in range(3)]
        middle = F.get(F.array_sort(F.array(*r)), F.lit(1))
        cost = sum((F.greatest(x / middle, middle / x) for x in r[1:]), F.greatest(r[0] / middle, middle / r[0]))
        return F.struct(cost.alias("cost"), F.lit(i).alias("order"), middle.alias("scale"), F.lit("".join(map(str, p))).alias("axes"))

    return F.array_min(F.array(*(fit(i, p) for i, p in enumerate(permutations(range(3))))))


def camera_pairs(spark, scenes: int, seed: int = 0) -> DataFrame:
    """Two cameras for each scene with seeded position, height, focal length and distortion."""
    df = spark.range(scenes).select(F.col("id").alias("scene_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("camera_id"))
    s = F.col("scene_id") * 2 + F.col("camera_id") + seed
    within = lambda k, lo, hi: F.lit(lo) + uniform(s, k) * (hi - lo)
    return df.select("scene_id", "camera_id", within(0, -1.0, 1.0).alias("x"), within(1, -1.0, 1.0).alias("y"), within(2, 1.0, 2.0).alias("z"), within(3, 24.0, 50.0).alias("focal_length"), within(4, -0.1, 0.1).alias("k1"))


def others(df: DataFrame, label: str, avoided, n: int, order: list[str]) -> DataFrame:
    """The first n rows whose label is another than the avoided one; rows without label are none of them."""
    return df.where(F.col(label) != F.lit(avoided)).orderBy(*order).limit(n)


def placed_objects(df: DataFrame, scene: str, position: str) -> DataFrame:
    """Seeded place in [-1, 1] and turn in [0, 2 pi) of each object; ids count from 1."""
    s = F.col(scene) * 1009 + F.col(position)
    return df.withColumns({"object_id": F.col(position) + 1, "px": uniform(s, 0) * 2 - 1, "py": uniform(s, 1) * 2 - 1, "turn": uniform(s, 2) * 6.283185307179586})


def sampled(df: DataFrame, group: str, item: str, least: int, most: int, seed: int, sub: int = 0) -> DataFrame:
    """Between least and most rows of each group, without replacement: how many depends on the group, which ones on the item and seed."""
    n = least + F.floor(uniform(F.col(group), sub) * (most - least + 1))
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.col(item).cast("string"), F.lit(str(seed)))), item)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def by_name(df: DataFrame, name: str, seq: str) -> DataFrame:
    """A total order by name, ties by their place: the same for every run, which a sort by name alone is not."""
    return df.orderBy(name, seq)


def epochal_order(df: DataFrame, key: str, passes: int, seed: int) -> DataFrame:
    """(pick, pass, key): pass 0 in key order, each later pass in an order of its own; a function of pass and key alone."""
    from ..sources.files import ensure_checkpoints

    # Buckets in order: ranges of the key in pass 0, the first three hex digits of the hash later. They are counted, then numbered each for itself.
    ensure_checkpoints(df.sparkSession)
    ranges = df.select(key).repartitionByRange(key).withColumn("range", F.spark_partition_id()).checkpoint()
    h = F.when(F.col("pass") > 0, F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("pass").cast("string"), F.lit(str(seed)))))
    out = ranges.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("h", h)
    out = out.withColumn("bucket", F.when(F.col("pass") == 0, F.col("range")).otherwise(F.conv(F.substring("h", 1, 3), 16, 10).cast("int")))
    sizes = out.groupBy("pass", "bucket").agg(F.count("*").alias("n"))
    line = Window.partitionBy("pass").orderBy("bucket")
    before = F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("pass", "bucket", before.alias("before"), F.sum("n").over(Window.partitionBy("pass")).alias("size"))
    own = F.row_number().over(Window.partitionBy("pass", "bucket").orderBy("h", key)) - 1
    out = out.withColumn("own", own).join(F.broadcast(sizes), ["pass", "bucket"])  # at most 4096 rows for each pass
    return out.select((F.col("own") + F.col("before") + F.col("pass") * F.col("size")).alias("pick"), "pass", key)


def messages(keys: DataFrame, catalog: DataFrame, locale: str, fallback: str = "en") -> DataFrame:
    """(key, text): a key's message in the locale, else in the fallback, else the key. catalog: (locale, key, text)."""
    own = catalog.where(F.col("locale") == locale).select("key", F.col("text").alias("a"))
    other = catalog.where(F.col("locale") == fallback).select("key", F.col("text").alias("b"))
    return keys.join(own, "key", "left").join(other, "key", "left").select("key", F.coalesce("a", "b", "key").alias("text"))
