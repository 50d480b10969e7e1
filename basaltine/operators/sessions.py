"""Upload sessions: listing, dedup, caps, expiry, chunks, rate limits and the changes of their tables.

State is tables in, tables out: an operation takes the present tables and the
incoming rows and returns what is accepted or what the tables become.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written

SESSIONS = "id string, created_at timestamp, finalized_at timestamp, name string, handle string, email string, notify_opt_in boolean, mode string, image_count int, focal_length float"
IMAGES = "id long, session_id string, server_filename string, original_mime string, size_bytes long, sha256 string, hash_source string, created_at timestamp"
DEDUP = "sha256 string, image_id long"
UPLOADS = "id string, session_id string, filename string, mime string, total_size long, received_size long, tmp_path string, created_at timestamp"
CONFIG = "id int, session_image_cap int, min_required_mixed int, min_required_same int, file_size_limit_mb int"
#: Ordered migrations: (version, table, schema). Applying one twice changes nothing.
MIGRATIONS = ((1, "sessions", SESSIONS), (1, "images", IMAGES), (1, "dedup_index", DEDUP), (2, "uploads", UPLOADS), (3, "config", CONFIG))
DEFAULT_CONFIG = (1, 20, 4, 3, 25)
MODES = ("MODE_UNSPECIFIED", "MIXED_UNIQUES", "SAME_TYPE")
SIZE_LIMIT_MB = 25


def listing(df: DataFrame, email: str = "", name: str = "", mode: str = "", status: str = "") -> DataFrame:
    """Rows that pass the filters that are set. ``%`` and ``_`` in name are wildcards; a status other than finalized or open filters nothing."""
    if email:
        df = df.where(F.lower("email") == email.lower())
    if name:
        df = df.where(F.lower("name").like(f"%{name.lower()}%"))
    if mode:
        df = df.where(F.col("mode") == mode)
    if status.lower() == "finalized":
        df = df.where(F.col("finalized_at").isNotNull())
    elif status.lower() == "open":
        df = df.where(F.col("finalized_at").isNull())
    return df


def page(df: DataFrame, order: list[str], number: int, size: int = 10) -> DataFrame:
    """A page from 0 of the rows in order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def pages_needed(n: Column, size: int = 10) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("long")


def summary(df: DataFrame) -> DataFrame:
    """Sessions with RFC 3339 times, absent ones empty."""
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return df.select("id", stamp("created_at").alias("created_at"), stamp("finalized_at").alias("finalized_at"), F.coalesce("name", F.lit("")).alias("name"), "email", F.coalesce("mode", F.lit("")).alias("mode"), "image_count")


def admissible(mime: Column, size: Column, prefix: str = "image/", limit_mb: int = SIZE_LIMIT_MB) -> Column:
    return mime.startswith(prefix) & (size <= limit_mb * 1024 * 1024)


def global_dedup(incoming: DataFrame, known: DataFrame | None, digest: str, order: list[str]) -> DataFrame:
    """Incoming rows with ``duplicate``: their digest is known, or an earlier incoming row has it."""
    first = incoming.groupBy(digest).agg(F.min(F.struct(*order)).alias("__first"))
    out = incoming.join(first, digest).withColumn("duplicate", F.struct(*order) != F.col("__first")).drop("__first")
    if known is not None:
        seen = known.select(digest).distinct().withColumn("__known", F.lit(True))
        out = out.join(seen, digest, "left").withColumn("duplicate", F.col("duplicate") | F.coalesce("__known", F.lit(False))).drop("__known")
    return out


def capped(df: DataFrame, key: str, order: list[str], cap: int, held: DataFrame | None = None) -> DataFrame:
    """The first rows of each key up to the cap; ``held`` (key, n) counts what it has already."""
    df = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    if held is None:
        return df.where(F.col("__n") <= cap).drop("__n")
    return df.join(held.select(key, F.col("n").alias("__held")), key, "left").where(F.col("__n") + F.coalesce("__held", F.lit(0)) <= cap).drop("__n", "__held")


def expired(df: DataFrame, now: Column, hours: int, created: str = "created_at", finalized: str | None = "finalized_at") -> DataFrame:
    """Rows older than the hours (strictly), and not finalized if they can be."""
    out = df.where(F.col(created) < now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return out.where(F.col(finalized).isNull()) if finalized else out


def life_cycle(finalized: Column, created: Column, now: Column, hours: int) -> Column:
    return F.when(finalized.isNotNull(), "finalized").when(created < now - F.make_dt_interval(F.lit(0), F.lit(hours)), "expired").otherwise("open")


def cascaded(children: DataFrame, foreign: str, removed: DataFrame, key: str) -> DataFrame:
    """Children whose parent stays."""
    return children.join(removed.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def deleted_by_email(sessions: DataFrame, email: str) -> DataFrame:
    return sessions.where(F.coalesce(F.lower("email") != email.lower(), F.lit(True)))


def assembled(chunks: DataFrame, upload: str, index: str, chunk: str, totals: DataFrame | None = None, total: str = "total_size") -> DataFrame:
    """(upload, n_chunks, received, content): chunks joined by index, the first of a repeated index; with totals only uploads that are complete."""
    once = chunks.groupBy(upload, index).agg(F.min(chunk).alias(chunk))
    got = once.groupBy(upload).agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length(chunk)).alias("received"), F.array_sort(F.collect_list(F.struct(index, chunk))).alias("__c"))
    if totals is not None:
        got = got.join(totals.select(upload, total), upload).where(F.col("received") == F.col(total))
    text = dict(chunks.dtypes)[chunk] == "string"
    parts = F.transform("__c", lambda x: x[chunk])
    joined = F.array_join(parts, "") if text else F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))
    return got.select(upload, "n_chunks", "received", joined.alias("content"))


def rate_limited(df: DataFrame, key: str, ts: str, order: list[str], limit: int, seconds: int = 60) -> DataFrame:
    """Rows with hit (number within its fixed window and key) and allowed."""
    start = F.window(ts, f"{seconds} seconds")["start"]
    w = Window.partitionBy(key, "window_start").orderBy(*order)
    return df.withColumn("window_start", start).withColumn("hit", F.row_number().over(w)).withColumn("allowed", F.col("hit") <= limit)


def _successors(times: DataFrame, span: int) -> DataFrame:
    """(t, next) of distinct times t: the first one more than ``span`` later, null where there is none.

    It stands in the bucket (of one span) after t's, or else begins the next bucket that holds anything. Within a bucket times
    are numbered on their own; only the list of buckets, one for each span of time at most, is in one line.
    """
    b = times.withColumn("b", F.floor(F.col("t") / span))
    line = Window.orderBy("b")
    of = b.groupBy("b").agg(F.min("t").alias("first")).withColumns({"b1": F.lead("b").over(line), "f1": F.lead("first").over(line), "f2": F.lead("first", 2).over(line)}).drop("first")
    asked = b.select((F.col("b") + 1).alias("b"), (F.col("t") + span).alias("at"), F.col("t"), F.lit(None).cast("long").alias("hit"))
    both = asked.unionByName(b.select("b", F.col("t").alias("at"), F.lit(None).cast("long").alias("t"), F.col("t").alias("hit")))
    # From the latest back; at equal times those who ask come first, so that they do not see what is not later.
    seen = F.min("hit").over(Window.partitionBy("b").orderBy(F.col("at").desc(), F.col("hit").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("inside", seen).where("t is not null").select("t", (F.col("b") - 1).alias("b"), "inside")
    after = F.when(F.col("b1") == F.col("b") + 1, F.col("f2")).otherwise(F.col("f1"))
    return found.join(of, "b").select("t", F.coalesce("inside", after).alias("next"))


def reset_limited(df: DataFrame, key: str, ts: str, order: list[str], limit: int, seconds: int = 60) -> DataFrame:
    """Rows with window_start, hit (number within the window and key) and allowed, as one limiter for all keys counts them.

    Its window begins with the first row, and anew, for all keys at once, with the first row more than ``seconds`` after its
    beginning. So the windows are a chain: from each time to the first one that is that much later. Which times are in
    the chain is found by pointer doubling, in as many joins as the logarithm of its length; then each row's window begins in
    its own span of time or the one before. Rows without a time are left out.
    """
    span = seconds * 1_000_000
    rows = df.where(F.col(ts).isNotNull()).withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    times = written(rows.select(F.col("__us").alias("t")).distinct())
    jump = written(_successors(times, span).where("next is not null"))
    chain = written(times.agg(F.min("t").alias("t")).where("t is not null"))
    while True:
        further = written(chain.join(jump, "t").select(F.col("next").alias("t")).join(chain, "t", "left_anti"))
        if further.isEmpty():
            break
        chain = written(chain.unionByName(further))
        # A jump now goes as far as two did.
        jump = written(jump.join(jump.select(F.col("t").alias("next"), F.col("next").alias("n2")), "next").select("t", F.col("n2").alias("next")))
    starts = chain.select(F.floor(F.col("t") / span).alias("__b"), F.col("t").alias("__own"))
    before = starts.select((F.col("__b") + 1).alias("__b"), F.col("__own").alias("__before"))
    got = rows.withColumn("__b", F.floor(F.col("__us") / span)).join(starts, "__b", "left").join(before, "__b", "left")
    start = F.when(F.col("__own") <= F.col("__us"), F.col("__own")).otherwise(F.col("__before"))
    got = got.withColumn("window_start", F.timestamp_micros(start)).drop("__us", "__b", "__own", "__before")
    hit = F.row_number().over(Window.partitionBy("window_start", key).orderBy(*order))
    return got.withColumn("hit", hit).withColumn("allowed", F.col("hit") <= limit)


def first_focal(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A session's focal length: the first that is known, never replaced."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def finalize(sessions: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Sessions with finalized_at set for the ids that are open."""
    return sessions.join(ids.select("id").distinct().withColumn("__f", F.lit(True)), "id", "left").withColumn("finalized_at", F.when(F.col("__f"), F.coalesce("finalized_at", now)).otherwise(F.col("finalized_at"))).drop("__f")


def with_default_config(config: DataFrame) -> DataFrame:
    """The one-row config; the default if there is none."""
    spark = config.sparkSession
    return config.unionByName(spark.createDataFrame([DEFAULT_CONFIG], CONFIG).join(config.select("id"), "id", "left_anti"))


def updated_config(config: DataFrame, **values: int) -> DataFrame:
    return with_default_config(config).withColumns({k: F.lit(v) for k, v in values.items()})


def migrated(tables: dict[str, DataFrame], spark, upto: int | None = None) -> dict[str, DataFrame]:
    """The tables with every missing one of the migrations, empty."""
    out = dict(tables)
    for version, name, schema in MIGRATIONS:
        if (upto is None or version <= upto) and name not in out:
            out[name] = spark.createDataFrame([], schema)
    return out


def next_key(key: str) -> Column:
    """One above the greatest key, as an aggregate; 1 for an empty table."""
    return F.coalesce(F.max(key), F.lit(0)) + 1


def next_id(df: DataFrame, key: str = "id") -> int:
    """One above the greatest key; 1 for an empty table."""
    return (df.agg(F.max(key)).first()[0] or 0) + 1


def accepted(incoming: DataFrame, images: DataFrame, dedup: DataFrame, cap: int) -> DataFrame:
    """Rows (session_id, seq, sha256, original_mime, size_bytes, ...) that an upload keeps: admissible, new anywhere, within the session's cap."""
    fit = incoming.where(admissible(F.col("original_mime"), F.col("size_bytes")))
    new = global_dedup(fit, dedup, "sha256", ["seq", "session_id"]).where("not duplicate").drop("duplicate")
    return capped(new, "session_id", ["seq"], cap, images.groupBy("session_id").agg(F.count("*").alias("n")))


def scan_uploads(uploads: DataFrame, scans: DataFrame, scan_id: int) -> DataFrame:
    """Uploads (scan_id, ...) of one scan with the scan's columns; the test on the id reaches both scans of tables."""
    return uploads.where(F.col("scan_id") == scan_id).join(scans.where(F.col("scan_id") == scan_id), "scan_id")


def scan_progress(uploads: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, n_uploads, done) of scans with uploads (scan_id, done): counted before they are joined."""
    return uploads.groupBy("scan_id").agg(F.count("*").alias("n_uploads"), F.bool_and("done").alias("done")).join(scans.select("scan_id"), "scan_id")


def trimmed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.trim(n) for n in names})


def owned(owner: Column, who: Column) -> Column:
    """Whether the owner is the one who asks; never for an unknown owner."""
    return F.coalesce(owner == who, F.lit(False))


def counted(items: DataFrame, key: str, name: str) -> DataFrame:
    return items.groupBy(key).agg(F.count("*").alias(name))


def elapsed(marks: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, seconds) between the first and the last mark."""
    return marks.groupBy(key).agg((F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))).alias("seconds"))


def partners(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(idx, partner): the other end of the pair (idx1, idx2) in which an item stands, 0 if in none."""
    both = pairs.select(F.col("idx1").alias("idx"), F.col("idx2").alias("partner")).unionByName(pairs.select(F.col("idx2").alias("idx"), F.col("idx1").alias("partner")))
    return items.join(both, "idx", "left").select("idx", F.coalesce("partner", F.lit(0)).alias("partner"))
