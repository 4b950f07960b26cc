"""Queries through the readers and writers, on files Spark writes from the given tables."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tickerloom.plans import sqltext as Q
from tickerloom.plans import stored, tapes
from tickerloom.plans.base import register, select, shape
from tickerloom.plans.bucket_queries import A1
from tickerloom.sources import capture, config, flat, store

EVENT = Q.TAPES["event"]
JOINED_IDS = "array_to_string(conditions, ',')"
FROM_NS, TO_NS = 1_704_200_000_000_000_000, 1_706_500_000_000_000_000
WINDOW = f"sip_ns >= {FROM_NS} AND sip_ns < {TO_NS}"
KNOWN = "symbol IN ('S0', 'S1', 'S2', 'S3', 'S4')"


def ids_text():
    return F.array_join(F.col("conditions").cast("array<string>"), ",")


def universe(spark):
    return tapes.symbols(spark).filter(KNOWN)


def _csv(spark, sf, kind):
    """The events tape as a vendor flat file: shuffled columns, odd header case, some bad cells."""

    def write(path):
        t = tapes.event_tape(spark, sf).filter(F.col("kind") == kind)
        bad = F.col("arrival") % 41 == 3
        text = lambda c: F.col(c).cast("string")
        if kind == "trade":
            t = t.select(
                text("price").alias("PRICE"),
                F.when(bad, "12x").otherwise(text("size")).alias("size"),
                F.col("symbol").alias(" Ticker "),
                ids_text().alias("conditions"),
                "exchange", "tape",
                F.col("part_ns").alias("participant_timestamp"),
                F.col("sip_ns").alias("sip_timestamp"),
                F.col("seq").alias("sequence_number"),
                F.lit("x").alias("trf_id"),
            )
        else:
            t = t.select(
                F.when(bad, F.lit("")).otherwise(text("ask_price")).alias("ask_price"),
                text("bid_price").alias("bid_price"),
                (F.col("ask_size") + 0.75).alias("ask_size"),
                F.col("bid_size").cast("double").alias("bid_size"),
                F.col("ask_exch").alias("ask_exchange"),
                F.col("bid_exch").alias("bid_exchange"),
                F.col("symbol").alias("ticker"),
                ids_text().alias("conditions"),
                F.col("sip_ns").alias("sip_timestamp"),
                F.col("seq").alias("sequence_number"),
            )
        t.write.option("header", True).option("compression", "gzip").mode("overwrite").csv(path)

    return stored._once(spark, sf, f"flat_{kind}", write)


S1 = "s:symbol f:price f:size i:sip_ns i:part_ns i:seq i:exchange i:tape s:ids"


@register("read_trades_flat", select([EVENT], S1, f"tape WHERE kind = 'trade' AND {WINDOW} AND {KNOWN}",
    size="CASE WHEN arrival % 41 = 3 THEN 0 ELSE size END", tape="tape_id", ids=JOINED_IDS))
def read_trades_flat(spark, sf):
    df = flat.read_trades_flat(spark, _csv(spark, sf, "trade"), universe(spark), FROM_NS, TO_NS)
    return shape(df.withColumn("ids", ids_text()), S1)


S2 = "s:symbol f:bid_price f:ask_price i:bid_size i:ask_size i:bid_exch i:ask_exch i:sip_ns i:seq s:ids"


@register("read_quotes_flat", select([EVENT], S2, "tape WHERE kind = 'quote'",
    ask_price="CASE WHEN arrival % 41 = 3 THEN 0 ELSE ask_price END", ids=JOINED_IDS))
def read_quotes_flat(spark, sf):
    df = flat.read_quotes_flat(spark, _csv(spark, sf, "quote"))
    return shape(df.withColumn("ids", ids_text()), S2)


S1S = "i:rows i:submitted i:filtered i:windowed i:malformed"


@register("flat_stats", select([EVENT], S1S, "tape WHERE kind = 'trade'", rows="count(*)",
    submitted=f"count(*) FILTER ({WINDOW} AND {KNOWN})",
    filtered=f"count(*) FILTER ({WINDOW} AND NOT {KNOWN})",
    windowed=f"count(*) FILTER (NOT ({WINDOW}))",
    malformed=f"count(*) FILTER ({WINDOW} AND {KNOWN} AND arrival % 41 = 3)"))
def flat_stats(spark, sf):
    rows = flat.read_flat_annotated(
        spark, _csv(spark, sf, "trade"), "trade", universe(spark), FROM_NS, TO_NS
    )
    return shape(flat.flat_stats(rows), S1S)


# Capture: four events to a frame, a status event in every frame of 11, two bad events in every one of
# seven, torn and blank lines between.
PER_FRAME = 4


def _event_json():
    ms = lambda c: F.expr(f"{c} div {capture.MS}")  # a double has not all digits of a nanosecond
    trade = F.to_json(
        F.struct(
            F.lit("T").alias("ev"), F.col("symbol").alias("sym"), F.col("exchange").alias("x"),
            F.col("price").alias("p"), F.col("size").alias("s"), F.col("conditions").alias("c"),
            ms("sip_ns").alias("t"), ms("part_ns").alias("pt"),
            F.col("seq").alias("q"), F.col("tape").alias("z"), F.lit(4).alias("trfi"),
        )
    )
    quote = lambda c: F.to_json(
        F.struct(
            F.lit("Q").alias("ev"), F.col("symbol").alias("sym"), F.col("bid_exch").alias("bx"),
            F.col("bid_price").alias("bp"), F.col("bid_size").alias("bs"),
            F.col("ask_exch").alias("ax"), F.col("ask_price").alias("ap"),
            F.col("ask_size").alias("as"), c.alias("c"),
            ms("sip_ns").alias("t"), F.col("seq").alias("q"), F.col("tape").alias("z"),
        )
    )
    bare = F.get(F.col("conditions"), F.lit(0))
    return (
        F.when(F.col("kind") == "trade", trade)
        .when(F.size("conditions") == 1, quote(bare))
        .otherwise(quote(F.col("conditions")))
    )


def _capture(spark, sf):
    def write(path):
        frame = F.expr(f"arrival div {PER_FRAME}")  # a double has not all digits of an id
        per = (
            tapes.event_tape(spark, sf)
            .select(frame.alias("frame"), "arrival", "recv_ns", _event_json().alias("j"))
            .groupBy("frame")
            .agg(
                F.max("recv_ns").alias("recv_ns"),
                F.array_sort(F.collect_list(F.struct("arrival", "j"))).alias("evs"),
            )
        )
        body = F.array_join(F.transform("evs", lambda e: e["j"]), ",")
        status = F.when(F.col("frame") % 11 == 0, ',{"ev":"status","message":"ok"}').otherwise("")
        bad = F.when(F.col("frame") % 7 == 0, ',{"ev":"T","sym":"S1","p":"x"},5').otherwise("")
        line = F.concat(F.col("recv_ns"), F.lit(" ["), body, status, bad, F.lit("]"))
        torn = F.when(F.col("frame") % 13 == 0, F.concat(F.col("recv_ns"), F.lit(' [{"ev":"T","sy')))
        lines = F.explode(F.array_compact(F.array(line, torn, F.when(F.col("frame") % 17 == 0, ""))))
        per.select(lines.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)

    return stored._once(spark, sf, "capture", write)


def decoded(spark, sf, names=None):
    records = capture.read_capture(spark, _capture(spark, sf))
    return capture.decode_events(capture.explode_frames(records), names)


MS = "sip_ns // 1000000 * 1000000"
FRAMES = "fr AS (SELECT *, max(recv_ns) OVER (PARTITION BY arrival // 4) AS frame_ns FROM tape)"
S4T = "s:symbol f:price f:size i:sip_ns i:part_ns i:seq i:exchange i:tape s:ids i:recv_ns"


@register("decode_trades", select([EVENT, FRAMES], S4T, f"fr WHERE kind = 'trade' AND {KNOWN}",
    sip_ns=MS, part_ns="part_ns // 1000000 * 1000000", tape="tape_id", ids=JOINED_IDS, recv_ns="frame_ns"))
def decode_trades(spark, sf):
    df = capture.capture_trades(decoded(spark, sf, universe(spark)))
    return shape(df.withColumn("ids", ids_text()), S4T)


S4Q = S2 + " i:recv_ns"


@register("decode_quotes", select([EVENT, FRAMES], S4Q, "fr WHERE kind = 'quote'", sip_ns=MS,
    ids=JOINED_IDS, recv_ns="frame_ns"))
def decode_quotes(spark, sf):
    df = capture.capture_quotes(decoded(spark, sf))
    return shape(df.withColumn("ids", ids_text()), S4Q)


S4S = "i:trades i:quotes i:status i:unknown i:decode_errs i:cond_overflow"


@register("capture_stats", select([EVENT, FRAMES], S4S, "fr",
    trades=f"count(*) FILTER (kind = 'trade' AND {KNOWN})",
    quotes=f"count(*) FILTER (kind = 'quote' AND {KNOWN})",
    status="count(DISTINCT arrival // 4) FILTER (arrival // 4 % 11 = 0)",
    unknown=f"count(*) FILTER (NOT {KNOWN})", decode_errs="2 * count(DISTINCT arrival // 4) FILTER (arrival // 4 % 7 = 0)", cond_overflow="0"))
def capture_stats(spark, sf):
    return shape(capture.capture_stats(decoded(spark, sf, universe(spark))), S4S)


S3 = "i:recv_ns i:events"


@register("read_capture", select([EVENT, FRAMES], S3, "fr", "GROUP BY arrival // 4",
    recv_ns="max(frame_ns)", events="count(*) + CASE WHEN arrival // 4 % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN arrival // 4 % 7 = 0 THEN 2 ELSE 0 END"))
def read_capture(spark, sf):
    records = capture.read_capture(spark, _capture(spark, sf))
    n = F.size(F.from_json("frame", "array<string>")).alias("events")
    return shape(records.select("recv_ns", n), S3)


S3L = "i:lines i:skipped i:records"


@register("capture_lines", select([EVENT, "f AS (SELECT DISTINCT arrival // 4 AS f FROM tape)"], S3L, "f",
    lines="count(*) + count(*) FILTER (f % 13 = 0) + count(*) FILTER (f % 17 = 0)",
    skipped="count(*) FILTER (f % 13 = 0) + count(*) FILTER (f % 17 = 0)", records="count(*)"))
def capture_lines(spark, sf):
    """Lines read and skipped, reported by the job that counts the records."""
    seen = Observation("capture")
    records = capture.read_capture(spark, _capture(spark, sf), seen).count()
    row = spark.range(1).select(F.lit(records).alias("records"), *(F.lit(v).alias(k) for k, v in seen.get.items()))
    stats = capture.line_stats(spark.read.text(_capture(spark, sf)))  # a scan of its own gives the same
    return shape(row.join(stats, ["lines", "skipped"]), S3L)


S15 = "i:recv_ns s:symbol i:seq"


@register("peek", select([EVENT, FRAMES], S15,
    "fr WHERE kind = 'trade' AND symbol = 'S2' AND len(conditions) > 0",
    "ORDER BY frame_ns, arrival LIMIT 25", recv_ns="frame_ns"))
def peek(spark, sf):
    df = capture.peek(decoded(spark, sf), 25, "S2", with_conditions=True)
    return shape(
        df.select(
            "recv_ns",
            F.get_json_object("event", "$.sym").alias("symbol"),
            F.get_json_object("event", "$.q").cast("bigint").alias("seq"),
        ),
        S15,
    )


# --- configuration ---------------------------------------------------------------------


def _config(spark, sf):
    """Nations as baskets of their customers; regions as benchmark groups of their nations.

    One JSON object per line, a thousand customer keys of one nation or one group in each.
    """

    def write(path):
        c = spark.read.parquet(f"{sf}/customer.parquet")
        n = spark.read.parquet(f"{sf}/nation.parquet")
        r = spark.read.parquet(f"{sf}/region.parquet")
        sym = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
        part = F.floor(F.col("c_custkey") / 1000)
        members = F.concat("m", F.slice("m", 1, 2)).alias("members")  # some of them twice
        baskets = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name", part).agg(F.collect_list(sym).alias("m"))
        baskets = baskets.select(F.create_map("n_name", F.struct(members)).alias("baskets"))
        group = F.when(F.col("r_regionkey") == 2, config.EXCLUDED_GROUP).otherwise(F.col("r_name"))
        groups = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(group.alias("k"))
        groups = groups.agg(F.collect_list("n_name").alias("v"))
        groups = groups.select(F.create_map("k", "v").alias("benchmarks"))
        baskets.unionByName(groups, allowMissingColumns=True).write.mode("overwrite").json(path)

    return stored._once(spark, sf, "config", write)


S12 = "s:basket s:symbol"


@register("load_baskets", """SELECT n_name AS basket, 'C' || c_custkey AS symbol
FROM customer JOIN nation ON c_nationkey = n_nationkey""")  # fmt: skip
def load_baskets(spark, sf):
    return shape(config.load_baskets(spark, _config(spark, sf), lines=True), S12)


@register("load_universe", """SELECT 'C' || c_custkey AS symbol FROM customer
JOIN nation ON c_nationkey = n_nationkey
UNION SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2""")  # fmt: skip
def load_universe(spark, sf):
    return shape(config.load_universe(spark, _config(spark, sf), lines=True), "s:symbol")


# --- stores ----------------------------------------------------------------------------


@register("bucket_store", select(Q.buckets("line"), A1, "b"))
def bucket_store(spark, sf):
    """bucket_1s as written by session and read back."""
    return shape(stored.buckets(spark, sf, "line"), A1)


@register("bucket_csv", select(Q.buckets("event"), A1, "b"))
def bucket_csv(spark, sf):
    """bucket_1s as CSV and back."""
    path = stored._once(
        spark,
        sf,
        "bucket_csv",
        lambda p: store.write_buckets_csv(stored.buckets(spark, sf, "event"), p),
    )
    return shape(store.read_buckets_csv(spark, path), A1)


S14 = "d:session_date i:rank i:gz s:path"
S14_SQL = """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events),
f AS (SELECT d, 0 AS rank, 0 AS gz, '/b/' || d || '.csv' AS path FROM d WHERE day(d) % 3 <> 0
UNION ALL SELECT d, 0, 1, '/b/' || d || '.csv.gz' FROM d WHERE day(d) % 2 = 0
UNION ALL SELECT d, 1, 0, '/b/' || d || '.trades-only.csv' FROM d WHERE day(d) % 5 <> 0)
SELECT CAST(d AS VARCHAR) AS session_date, CAST(rank AS BIGINT) AS rank, CAST(gz AS BIGINT) AS gz, path
FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY rank, gz) AS n FROM f
      WHERE d <= DATE '2024-01-28') WHERE n = 1 ORDER BY d DESC LIMIT 20"""


@register("discover_sessions", S14_SQL)
def discover_sessions(spark, sf):
    """The latest 20 sessions through 28 January, from file names made of the events' dates."""
    d = F.col("d").cast("string")
    day = F.dayofmonth("d")
    path = lambda cond, end: F.when(cond, F.concat(F.lit("/b/"), d, F.lit(end)))
    names = F.array_compact(
        F.array(
            path(day % 3 != 0, ".csv"),
            path(day % 2 == 0, ".csv.gz"),
            path(day % 5 != 0, store.TRADES_ONLY_SUFFIX),
            path(F.lit(True), store.PARTIAL_SUFFIX),
            path(F.lit(True), ".txt"),
        )
    )
    dates = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("date").alias("d"))
    files = dates.distinct().select(F.explode(names).alias("path"))
    return shape(store.discover_sessions(store.bucket_catalog(files), 20, "2024-01-28"), S14)
