"""Stored tables: buckets, baselines, floors; session discovery and shape checks."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions import session as S
from tickerloom.schema import (
    BASKET_PROFILE,
    BUCKET_FILE,
    BUCKETS,
    FLOORS,
    OPEN_MINUTE,
    SESSION_MINUTES,
    TICKER_PROFILE,
    require_columns,
)

# File-name endings of session bucket files.
TRADES_ONLY_SUFFIX = ".trades-only.csv"
PARTIAL_SUFFIX = ".partial.csv"


def shared_dir(spark):
    """The folder all executors share; a single-process master without one gets a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    path = path or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder the whole cluster shares")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def read_columns(spark, path, schema):
    """Stored columns as `schema` has them; a file set without one of them is refused."""
    found = require_columns(spark.read.parquet(path), schema.names, str(path))
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_buckets(buckets, path, slice_minutes=30):
    """Replace the sessions present in `buckets`; rows sorted by (second, symbol) in each file.

    A session is spread over half-hour slices, so no task holds a whole session.
    """
    slot = F.floor(F.col("second") / (60 * slice_minutes))
    (
        buckets.select(*BUCKETS.names)
        .repartition("session_date", slot)
        .sortWithinPartitions("session_date", "second", "symbol")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("session_date")
        .parquet(path)
    )


def read_buckets(spark, path):
    """Stored buckets; a filter on session_date prunes partitions."""
    return read_columns(spark, path, BUCKETS)


def write_buckets_csv(buckets, path):
    """Buckets as CSV with a header, globally sorted by (second, symbol)."""
    out = buckets.select(*BUCKET_FILE.names).orderBy("second", "symbol")
    out.write.mode("overwrite").option("header", True).csv(path)


def read_buckets_csv(spark, path):
    """Bucket CSV, columns matched by name; extra ones ignored, bad or short rows fail."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    require_columns(raw, BUCKET_FILE.names, str(path))
    missing = F.raise_error(F.lit(f"{path}: short row or empty field"))
    cols = [
        F.coalesce(F.col(f.name), missing.cast("string")).cast(f.dataType).alias(f.name)
        for f in BUCKET_FILE.fields
    ]
    df = raw.select(*cols)
    return df.withColumn("session_date", S.et_date("second")).select(*BUCKETS.names)


def check_profile_shape(df, *keys, bar_minutes=1):
    """Rows of `keys` groups that are not the contiguous bars of one regular session."""
    want = SESSION_MINUTES // bar_minutes
    last = OPEN_MINUTE + SESSION_MINUTES - bar_minutes
    shape = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.min("minute_of_day").alias("first_minute"),
        F.max("minute_of_day").alias("last_minute"),
        F.count_distinct("minute_of_day").alias("minutes"),
    )
    bad = (
        (F.col("rows") != want)
        | (F.col("minutes") != want)
        | (F.col("first_minute") != OPEN_MINUTE)
        | (F.col("last_minute") != last)
    )
    return shape.withColumn("ok", ~bad)


def _assert_shape(df, keys, bar_minutes, path):
    worst = check_profile_shape(df, *keys, bar_minutes=bar_minutes).orderBy("ok").take(1)
    if not worst:
        raise ValueError(f"{path}: no rows")
    if not worst[0]["ok"]:
        raise ValueError(f"{path}: not the contiguous bars of a session: {worst[0].asDict()}")
    return df


def _target(spark, path):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark, path):
    """Remove a folder, wherever Spark keeps it."""
    target, files = _target(spark, path)
    return files.delete(target, True)


def exists(spark, path):
    target, files = _target(spark, path)
    return files.exists(target)


def _builds(spark, path):
    """(n, build) of the finished builds of a table, the newest first."""
    if not exists(spark, f"{path}/builds"):
        return []
    rows = spark.read.schema("n bigint, build string").parquet(f"{path}/builds").orderBy(F.desc("n")).take(2)
    return [(r["n"], r["build"]) for r in rows]


def write_table(df, path):
    """Replace a baseline table: a build counts once it is listed, so a failed one changes nothing.

    The build before the last is removed; readers of the last one are not disturbed.
    """
    import uuid

    spark, build = df.sparkSession, uuid.uuid4().hex[:12]
    df.write.parquet(f"{path}/data/build={build}")
    done = _builds(spark, path)
    n = done[0][0] + 1 if done else 0
    row = spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(build).alias("build"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/builds")
    for _, old in done[1:]:
        delete(spark, f"{path}/data/build={old}")


def table_path(spark, path):
    """Where the newest finished build of a table is."""
    done = _builds(spark, path)
    if not done:
        raise ValueError(f"{path}: no finished build")
    return f"{path}/data/build={done[0][1]}"


def read_ticker_profile(spark, path, bar_minutes=1):
    """Ticker baselines; every symbol must have exactly the session's bars."""
    df = read_columns(spark, table_path(spark, path), TICKER_PROFILE)
    return _assert_shape(df, ["symbol"], bar_minutes, path)


def stale_baskets(profile, members):
    """Baskets whose stored member list differs from the current one, on either side."""
    built = profile.groupBy("basket").agg(F.first("members").alias("built"))
    now = members.groupBy("basket").agg(F.array_sort(F.collect_set("symbol")).alias("current"))
    both = built.join(now, "basket", "full")
    return both.filter(~F.col("built").eqNullSafe(F.col("current")))


def read_basket_profile(spark, path, members, bar_minutes=1):
    """Basket baselines; a missing basket or a changed member list fails the read."""
    df = read_columns(spark, table_path(spark, path), BASKET_PROFILE)
    stale = stale_baskets(df, members).filter(F.col("current").isNotNull()).take(1)
    if stale:
        r = stale[0]
        raise ValueError(
            f"basket {r['basket']} is stale: built with {r['built']}, now {r['current']}; rebuild"
        )
    return _assert_shape(df, ["basket"], bar_minutes, path)


def write_floors(df, path, frac, inputs):
    """Floors with the fraction and inputs they came from."""
    write_table(df.withColumn("frac", F.lit(frac)).withColumn("inputs", F.lit(inputs)), path)


def read_floors(spark, path, bar_minutes=1):
    """Floors; exactly the session's bars."""
    df = spark.read.parquet(table_path(spark, path))
    require_columns(df, FLOORS.names, path)
    _assert_shape(df.withColumn("one", F.lit(1)), ["one"], bar_minutes, path)
    return df


def list_bucket_files(spark, path):
    """(path) of every file below a directory; file contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def bucket_catalog(files):
    """(session_date, rank, gz, path) of the files that may feed baselines."""
    name = F.element_at(F.split("path", "/"), -1)
    gz = name.endswith(".gz")
    base = F.when(gz, F.substring(name, F.lit(1), F.length(name) - 3)).otherwise(name)
    trades_only = base.endswith(TRADES_ONLY_SUFFIX)
    stem = (
        F.when(trades_only, F.regexp_replace(base, "[.]trades-only[.]csv$", ""))
        .when(base.endswith(PARTIAL_SUFFIX), F.lit(None))
        .when(base.endswith(".csv"), F.regexp_replace(base, "[.]csv$", ""))
    )
    date = F.when(stem.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), stem.try_cast("date"))
    return files.select(
        date.alias("session_date"),
        trades_only.cast("int").alias("rank"),
        gz.cast("int").alias("gz"),
        "path",
    ).filter(F.col("session_date").isNotNull())


def discover_sessions(catalog, n, through=None):
    """The best file of each of the latest n dates, ascending: full first, plain before gzip."""
    if through is not None:
        catalog = catalog.filter(F.col("session_date") <= F.lit(through).cast("date"))
    best = W.partitionBy("session_date").orderBy("rank", "gz", "path")
    picked = catalog.withColumn("pick", F.row_number().over(best)).filter("pick = 1")
    latest = picked.drop("pick").orderBy(F.desc("session_date")).limit(n)
    return latest.orderBy("session_date")


def check_discovered(sessions, path="", through=None):
    """Raise when discovery found nothing."""
    if not sessions.take(1):
        raise ValueError(f"no bucket files in {path} (through={through})")
    return sessions


