"""Queries on prints, buckets and per-symbol state."""

from pyspark.sql import functions as F

from tickerloom.functions import conditions as C
from tickerloom.functions import session as S
from tickerloom.functions import slices
from tickerloom.functions.stats import zguard
from tickerloom.operators import book, prints
from tickerloom.operators import buckets as B
from tickerloom.operators.quality import exact_median
from tickerloom.plans import sqltext as Q
from tickerloom.plans import stored, tapes
from tickerloom.plans.base import register, select, shape
from tickerloom.schema import class_columns
from tickerloom.sources import flat, landed

EVENT, LINE = Q.TAPES["event"], Q.TAPES["line"]
TRADES = "tape WHERE kind = 'trade'"


def event_trades(spark, sf):
    return tapes.event_tape(spark, sf).filter("kind = 'trade'")


# --- projections -----------------------------------------------------------------------

P1 = "i:arrival s:ids i:overflow"
P1_SQL = select(
    [EVENT],
    P1,
    "tape",
    ids="array_to_string(array_slice(list_concat(conditions, [-1], conditions, conditions,"
    " conditions), 1, 8), ',')",
    overflow="CASE WHEN len(conditions) * 4 + 1 > 8 THEN 1 ELSE 0 END",
)


@register("parse_conditions", P1_SQL)
def parse_conditions(spark, sf):
    text = F.array_join(F.col("conditions").cast("array<string>"), ", ")
    text = F.concat(text, F.lit(";x,"), text, F.lit(" "), text, F.lit(",;"), text)
    ids = C.parse_conditions(text)
    df = tapes.event_tape(spark, sf).select(
        "arrival",
        F.concat_ws(",", C.cap_conditions(ids).cast("array<string>")).alias("ids"),
        C.overflowed(ids).alias("overflow"),
    )
    return shape(df, P1)


P2 = "s:symbol s:kind i:messages"


@register("universe_filter", select([LINE, Q.MEMBERS], P2,
    "tape WHERE symbol IN (SELECT symbol FROM mem)", "GROUP BY symbol, kind", messages="count(*)"))
def universe_filter(spark, sf):
    kept = flat.in_universe(tapes.line_tape(spark, sf), tapes.members(spark).select("symbol").distinct())
    return shape(kept.groupBy("symbol", "kind").agg(F.count("*").alias("messages")), P2)


P3 = "i:arrival s:symbol s:kind i:sip_ns"
P3_FROM, P3_TO = 1_705_000_000_000_000_000, 1_706_000_000_000_000_000


@register("time_window", select([EVENT], P3,
    f"tape WHERE sip_ns >= {P3_FROM} AND sip_ns < {P3_TO}"))
def time_window(spark, sf):
    return shape(flat.time_window(tapes.event_tape(spark, sf), P3_FROM, P3_TO), P3)


@register("landed_window", select([EVENT, Q.MEMBERS], P3,
    f"tape WHERE sip_ns >= {P3_FROM} AND sip_ns < {P3_TO} AND symbol IN (SELECT symbol FROM mem)"))
def landed_window(spark, sf):
    """A window and a universe of the landed tape: both are filters of the scan."""
    path = stored._once(spark, sf, "event_landed", lambda p: landed.land_tape(tapes.event_tape(spark, sf), p))
    return shape(landed.read_landed(spark, path, tapes.members(spark), P3_FROM, P3_TO), P3)


P12 = (
    "i:arrival s:symbol d:et_date i:minute_of_day i:minute_start i:in_regular"
    " i:bucket_start i:open_ns"
)
P12_SQL = select(
    [LINE],
    P12,
    "(SELECT *, sip_ns // 1000000000 AS sec FROM tape)",
    et_date=f"CAST(timezone({Q.NY}, to_timestamp(sec)) AS DATE)",
    minute_of_day=Q.minute("sec"),
    minute_start="sec - sec % 60",
    in_regular=f"CASE WHEN {Q.minute('sec')} BETWEEN 570 AND 959 THEN 1 ELSE 0 END",
    bucket_start=Q.wall("session_date", Q.minute("sec")),
    open_ns=f"{Q.clock('session_date', '09:30:00')} * 1000000000",
)


@register("session_clock_fields", P12_SQL)
def session_clock_fields(spark, sf):
    sec = "sec"
    minute = S.minute_of_day_sql(sec)
    df = tapes.line_tape(spark, sf).withColumn("sec", S.second_of("sip_ns"))
    df = df.select(
        "arrival",
        "symbol",
        S.et_date(sec).alias("et_date"),
        S.minute_of_day(sec).alias("minute_of_day"),
        S.minute_start(sec).alias("minute_start"),
        S.in_regular(minute).cast("int").alias("in_regular"),
        S.bucket_start("session_date", minute).alias("bucket_start"),
        S.et_ns("session_date", "'09:30:00'").alias("open_ns"),
    )
    return shape(df, P12)


P5 = "i:arrival i:class_rank s:class_name s:unknown i:late f:notional"
P5_SQL = select(
    Q.ranked("event"),
    P5,
    "cls WHERE kind = 'trade'",
    class_rank="rank",
    class_name=Q.CLASS_NAME,
    unknown=f"array_to_string(list_filter(conditions, lambda x: NOT list_contains({Q.KNOWN_IDS}, x)), ',')",
    late="CASE WHEN rank = 3 OR (rank = 8 AND list_has_any(conditions, [30, 31])) THEN 1 ELSE 0 END",
    notional="price * size",
)


@register("classify_prints", P5_SQL)
def classify_prints(spark, sf):
    df = prints.with_class(event_trades(spark, sf)).select(
        "arrival",
        "class_rank",
        "class_name",
        F.concat_ws(",", C.unknown_ids("conditions").cast("array<string>")).alias("unknown"),
        C.monitor_lateness("class_rank", "conditions").cast("int").alias("late"),
        slices.notional("price", "size").alias("notional"),
    )
    return shape(df, P5)


P7 = "i:sip_ns s:symbol s:class_name s:ids i:lateness_ns f:size f:notional i:second"
P7_SQL = select(
    Q.ranked("event"),
    P7,
    "cls WHERE kind = 'trade' AND (rank = 3 OR (rank = 8 AND list_has_any(conditions, [30, 31])))",
    class_name=Q.CLASS_NAME,
    ids="array_to_string(conditions, ',')",
    lateness_ns="sip_ns - part_ns",
    notional="price * size",
    second="sip_ns // 1000000000",
)


@register("lateness_log", P7_SQL)
def lateness_log(spark, sf):
    df = prints.lateness_log(event_trades(spark, sf))
    ids = F.concat_ws(",", F.col("conditions").cast("array<string>"))
    return shape(df.withColumn("ids", ids), P7)


P9 = "d:session_date i:second s:symbol f:c_shares f:c_dollars f:a_shares f:a_dollars f:x_shares f:x_dollars"


@register("print_slices", select(Q.buckets("line"), P9, "bs"))
def print_slices(spark, sf):
    b = stored.buckets(spark, sf, "line")
    c, a, x = slices.counted(), slices.counted_with_auctions(), slices.extended_hours()
    df = b.select(
        "session_date", "second", "symbol",
        c[0].alias("c_shares"), c[1].alias("c_dollars"), a[0].alias("a_shares"),
        a[1].alias("a_dollars"), x[0].alias("x_shares"), x[1].alias("x_dollars"),
    )
    return shape(df, P9)


P16 = "d:session_date i:second s:symbol f:z"
P16_SQL = select(
    [*Q.buckets("line"), "mid AS (SELECT symbol, median(c_dollars) AS m, 1.4826 * mad(c_dollars) AS s FROM bs GROUP BY symbol)"],
    P16,
    "bs JOIN mid USING (symbol)",
    z="CASE WHEN greatest(s, CASE WHEN symbol = 'S5' THEN 0 ELSE 25.0 END) > 0"
    " THEN (c_dollars - m) / greatest(s, CASE WHEN symbol = 'S5' THEN 0 ELSE 25.0 END) END",
)


@register("zguard", P16_SQL)
def zguard_buckets(spark, sf):
    """Counted dollars of every bucket against its symbol's own median; S5 has no floor."""
    b = stored.buckets(spark, sf, "line").select(
        "session_date", "second", "symbol", slices.counted()[1].alias("d")
    )
    med = exact_median(b, "d", ["symbol"]).withColumnRenamed("median", "m")
    dev = b.join(med, "symbol").withColumn("dev", F.abs(F.col("d") - F.col("m")))
    sig = exact_median(dev, "dev", ["symbol"]).select("symbol", (F.col("median") * 1.4826).alias("s"))
    sig = sig.join(med, "symbol")
    floor = F.when(F.col("symbol") == "S5", 0.0).otherwise(25.0)
    return shape(b.join(sig, "symbol").withColumn("z", zguard("d", "m", "s", floor)), P16)


# --- buckets ---------------------------------------------------------------------------

A1 = (
    "d:session_date i:second s:symbol i:trades f:shares f:dollars p:last_price i:last_sip_ns i:quotes "
    + " ".join(("i:" if c.endswith("_trades") else "f:") + c for c in class_columns())
)


@register("bucket_1s", select(Q.buckets("event"), A1, "b"))
def bucket_1s(spark, sf):
    return shape(B.bucketize(tapes.event_tape(spark, sf)), A1)


@register("bucket_1s_lines", select(Q.buckets("line"), A1, "b"))
def bucket_1s_lines(spark, sf):
    return shape(B.bucketize(tapes.line_tape(spark, sf)), A1)


A2 = "s:symbol i:second p:last_price i:last_sip_ns"
A2_SQL = select(
    [EVENT],
    A2,
    """(SELECT symbol, sip_ns // 1000000000 AS second, price AS last_price, sip_ns AS last_sip_ns,
        row_number() OVER (PARTITION BY symbol, sip_ns // 1000000000
                           ORDER BY sip_ns DESC, arrival DESC) AS n
       FROM tape WHERE kind = 'trade') WHERE n = 1""",
)


@register("last_price", A2_SQL)
def last_price(spark, sf):
    return shape(B.bucketize(tapes.event_tape(spark, sf)).filter("trades > 0"), A2)


A3 = "d:session_date s:symbol i:minute i:trades f:shares f:dollars p:last_price i:last_sip_ns i:quotes f:continuous_dollars f:block_dollars"


@register("minute_buckets", select(Q.buckets("line"), A3, "b", "GROUP BY session_date, symbol, second // 60",
    minute="second // 60 * 60", trades="sum(trades)", shares="sum(shares)", dollars="sum(dollars)",
    last_price="arg_max(last_price, last_sip_ns)", last_sip_ns="max(last_sip_ns)", quotes="sum(quotes)",
    continuous_dollars="sum(continuous_dollars)", block_dollars="sum(block_dollars)"))
def minute_buckets(spark, sf):
    return shape(B.minute_buckets(stored.buckets(spark, sf, "line")), A3)


A4_FROM, A4_TO = 1_709_600_000, 1_710_700_000
A4 = "s:symbol i:trades f:shares f:dollars p:last_price i:quotes"


@register("window_sum", select(Q.buckets("line"), A4, f"b WHERE second >= {A4_FROM} AND second < {A4_TO}",
    "GROUP BY symbol", trades="sum(trades)", shares="sum(shares)", dollars="sum(dollars)",
    last_price="arg_max(last_price, last_sip_ns)", quotes="sum(quotes)"))
def window_sum(spark, sf):
    return shape(B.window_sum(stored.buckets(spark, sf, "line"), A4_FROM, A4_TO), A4)


A6 = "d:session_date s:symbol p:first_price p:last_price"


@register("first_last_trade_price", select(Q.buckets("line"), A6, "b WHERE trades > 0",
    "GROUP BY session_date, symbol", first_price="arg_min(last_price, second)",
    last_price="arg_max(last_price, second)"))
def first_last_trade_price(spark, sf):
    b = stored.buckets(spark, sf, "line")
    return shape(B.trade_price_ends(b, "session_date", "symbol"), A6)


A8 = "d:session_date i:min_sec i:max_sec i:rows i:symbols i:trades i:quotes d:date i:spans s:coverage"
A8_SQL = select(
    [*Q.buckets("line"), "t AS (SELECT session_date, min(second) AS min_sec, max(second) AS max_sec,"
     " count(*) AS rows, count(DISTINCT symbol) AS symbols, sum(trades) AS trades,"
     " sum(quotes) AS quotes FROM b GROUP BY session_date)",
     f"t2 AS (SELECT *, min_sec <= {Q.wall('session_date', 570)}"
     f" AND max_sec >= {Q.wall('session_date', 960)} AS spans FROM t)"],
    A8,
    "t2",
    date="session_date",
    spans="CASE WHEN spans THEN 1 ELSE 0 END",
    coverage="CASE WHEN spans AND trades > 0 AND quotes > 0 THEN 'full' ELSE 'partial' END",
)


@register("session_coverage", A8_SQL)
def session_coverage(spark, sf):
    df = B.coverage(B.session_bounds(stored.buckets(spark, sf, "line")))
    return shape(df.withColumn("spans", F.col("spans").cast("int")), A8)


T1 = "i:pos i:second s:symbol i:trades"


@register("bucket_order", select(Q.buckets("line"), T1,
    "(SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY second, symbol) AS pos FROM b)"))
def bucket_order(spark, sf):
    """Position of each bucket in its session's file order."""
    return shape(B.bucket_positions(stored.buckets(spark, sf, "line")), T1)


# --- prints ----------------------------------------------------------------------------

A11 = "i:condition_id i:prints"


@register("unknown_condition_ids", select(
    [EVENT, f"ids AS (SELECT unnest(conditions) AS condition_id FROM {TRADES})"], A11,
    f"ids WHERE NOT list_contains({Q.KNOWN_IDS}, condition_id)", "GROUP BY condition_id",
    prints="count(*)"))
def unknown_condition_ids(spark, sf):
    return shape(prints.unknown_condition_ids(event_trades(spark, sf)), A11)


@register("unknown_condition_prints", select(Q.ranked("event"), "i:prints", "cls WHERE rank = 0",
    prints="count(*)"))
def unknown_condition_prints(spark, sf):
    return shape(prints.unknown_condition_prints(event_trades(spark, sf)), "i:prints")


@register("condition_histogram", select(
    [EVENT, f"ids AS (SELECT unnest(conditions) AS condition_id FROM {TRADES})"], A11, "ids",
    "GROUP BY condition_id", prints="count(*)"))
def condition_histogram(spark, sf):
    return shape(prints.condition_histogram(event_trades(spark, sf)), A11)


A12 = "i:class_rank s:class_name i:prints f:dollars"


@register("class_distribution", select(Q.ranked("line"), A12, "cls WHERE kind = 'trade'",
    "GROUP BY rank", class_rank="rank", class_name=Q.CLASS_NAME, prints="count(*)",
    dollars="sum(price * size)"))
def class_distribution(spark, sf):
    trades = tapes.line_tape(spark, sf).filter("kind = 'trade'")
    return shape(prints.class_distribution(trades), A12)


T5 = "s:symbol i:sip_ns f:size"


@register("condition_samples", select([EVENT], T5,
    f"{TRADES} AND list_contains(conditions, 55)", "ORDER BY sip_ns, arrival LIMIT 20"))
def condition_samples(spark, sf):
    return shape(prints.condition_samples(event_trades(spark, sf)), T5)


# --- book ------------------------------------------------------------------------------

A5 = "s:symbol f:bid_price f:ask_price i:bid_size i:ask_size i:bid_exch i:ask_exch i:sip_ns i:seq"
A5_TO = 1_705_600_000_000_000_000
A5_ROWS = "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY arrival DESC) AS n FROM tape WHERE kind = 'quote'{})"


def event_quotes(spark, sf):
    return tapes.event_tape(spark, sf).filter("kind = 'quote'")


@register("nbbo", select([EVENT], A5, A5_ROWS.format("") + " WHERE n = 1"))
def nbbo(spark, sf):
    return shape(book.nbbo(event_quotes(spark, sf)), A5)


@register("nbbo_as_of", select([EVENT], A5, A5_ROWS.format(f" AND sip_ns < {A5_TO}") + " WHERE n = 1"))
def nbbo_as_of(spark, sf):
    return shape(book.nbbo(event_quotes(spark, sf), to_ns=A5_TO), A5)


W1 = "d:session_date s:symbol s:kind i:messages i:regressions"
W1_SQL = select(
    [EVENT, """run AS (SELECT *, max(seq) OVER (PARTITION BY session_date, symbol, kind ORDER BY arrival
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM tape)"""],
    W1,
    "run",
    "GROUP BY session_date, symbol, kind",
    messages="count(*)",
    regressions="count(*) FILTER (seq < greatest(coalesce(top, 0), 0))",
)


@register("sequence_regressions", W1_SQL)
def sequence_regressions(spark, sf):
    return shape(book.sequence_regressions(tapes.event_tape(spark, sf), block_width=1024), W1)


T2 = "s:symbol i:trades i:quotes i:messages"


@register("busiest_symbols", select([LINE], T2, "tape", "GROUP BY symbol ORDER BY messages DESC, symbol LIMIT 10",
    trades="count(*) FILTER (kind = 'trade')", quotes="count(*) FILTER (kind = 'quote')",
    messages="count(*)"))
def busiest_symbols(spark, sf):
    return shape(book.busiest_symbols(tapes.line_tape(spark, sf)), T2)


U1 = "i:arrival s:kind s:symbol f:price f:size f:bid_price f:ask_price i:sip_ns"


@register("union_tape", select([EVENT], U1, "tape",
    price="CASE WHEN kind = 'trade' THEN price END", size="CASE WHEN kind = 'trade' THEN size END",
    bid_price="CASE WHEN kind = 'quote' THEN bid_price END",
    ask_price="CASE WHEN kind = 'quote' THEN ask_price END"))
def union_tape(spark, sf):
    t = tapes.event_tape(spark, sf)
    trades = t.filter("kind = 'trade'").select("symbol", "price", "size", "sip_ns", "arrival")
    quotes = t.filter("kind = 'quote'").select("symbol", "bid_price", "ask_price", "sip_ns", "arrival")
    return shape(flat.union_tape(trades, quotes), U1)


