"""One-second buckets per symbol, and every read on them."""

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions import conditions as C
from tickerloom.functions import session as S
from tickerloom.schema import BUCKETS, CLASSES, CLOSE_MINUTE, OPEN_MINUTE, ZONE, class_columns


def tape_order():
    """Sort key inside one second: SIP nanosecond, then arrival (any BIGINT or DECIMAL(28,0)).

    Both fit one DECIMAL(38,0), which aggregate buffers hold in place: the bucket aggregate stays
    a hash aggregate. An arrival is less than 10^28 either way, a nanosecond step is 10^29.
    """
    step = "cast('1" + "0" * 29 + "' as decimal(30,0))"
    return f"cast(pmod(sip_ns, 1000000000) as decimal(9,0)) * {step} + cast(arrival as decimal(28,0))"


def _flags(tape, *more):
    """Narrow input of the bucket aggregate: one fixed-width row per message."""
    if "kind" not in tape.columns:
        tape = tape.withColumn("kind", F.lit("trade"))
    when = lambda value, other="NULL": f"CASE WHEN kind = 'trade' THEN {value} ELSE {other} END"
    return tape.selectExpr(
        "symbol",
        f"{S.second_of_sql('sip_ns')} AS second",
        "kind = 'trade' AS is_trade",
        when(C.classify_sql("conditions")) + " AS rank",
        when("price") + " AS price",
        when("size", "0D") + " AS size",
        when("price * size", "0D") + " AS notional",
        when("sip_ns") + " AS trade_ns",
        when(tape_order()) + " AS ord",
        *more,
    )


def _bucket_aggregates():
    out = [
        "sum(if(is_trade, 1, 0)) AS trades",
        "sum(size) AS shares",
        "sum(notional) AS dollars",
        "coalesce(max_by(price, ord), 0D) AS last_price",
        "coalesce(max(trade_ns), 0) AS last_sip_ns",
        "sum(if(is_trade, 0, 1)) AS quotes",
    ]
    for rank, name in enumerate(CLASSES):
        out += [
            f"sum(if(rank = {rank}, 1, 0)) AS {name}_trades",
            f"sum(if(rank = {rank}, size, 0D)) AS {name}_shares",
            f"sum(if(rank = {rank}, notional, 0D)) AS {name}_dollars",
        ]
    return [F.expr(e) for e in out]


def bucketize(tape):
    """bucket_1s: one row per (symbol, SIP second) that saw a message.

    Event time alone decides the bucket, so late prints land in their own second.
    One shuffle of narrow rows on (symbol, second), so a symbol holding most of the tape still
    spreads by second. It comes before the aggregate: a scan task that combined would hold a wide
    row for nearly every message of its split, a task after the shuffle holds its own buckets.
    """
    rows = _flags(tape).repartition("symbol", "second")
    out = rows.groupBy("symbol", "second").agg(*_bucket_aggregates())
    return out.withColumn("session_date", S.et_date("second")).select(*BUCKETS.names)


def merge_buckets(buckets, *keys):
    """Bucket columns summed over groups of rows; the last price follows the latest SIP time."""
    sums = ["trades", "shares", "dollars", "quotes"] + class_columns()
    return buckets.groupBy(*keys).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in sums],
        F.max_by("last_price", "last_sip_ns").alias("last_price"),
        F.max("last_sip_ns").alias("last_sip_ns"),
    )


def minute_buckets(buckets):
    """bucket_1s summed to whole minutes."""
    m = buckets.withColumn("minute", S.minute_start("second"))
    return merge_buckets(m, "session_date", "symbol", "minute")


def derive_minute(buckets, minute_sec):
    """The sixty seconds from minute_sec, per symbol; minute_sec must start a minute."""
    if minute_sec % 60:
        raise ValueError(f"{minute_sec} does not start a minute")
    return window_sum(buckets, minute_sec, minute_sec + 60)


def in_window(buckets, from_sec, to_sec):
    """Buckets of [from_sec, to_sec); only the sessions of that time are read."""
    day = lambda sec: dt.datetime.fromtimestamp(sec, ZoneInfo(ZONE)).date()
    days = F.col("session_date").between(day(from_sec), day(max(from_sec, to_sec - 1)))
    return buckets.filter(days & (F.col("second") >= from_sec) & (F.col("second") < to_sec))


def window_sum(buckets, from_sec, to_sec):
    """Bucket columns summed over [from_sec, to_sec), per symbol."""
    return merge_buckets(in_window(buckets, from_sec, to_sec), "symbol")


def first_trade_price(buckets, *keys):
    """Last price of the earliest traded second of each group."""
    traded = buckets.filter("trades > 0")
    return traded.groupBy(*keys).agg(F.min_by("last_price", "second").alias("first_price"))


def last_trade_price(buckets, *keys):
    """Last price of the latest traded second of each group."""
    traded = buckets.filter("trades > 0")
    return traded.groupBy(*keys).agg(F.max_by("last_price", "second").alias("last_price"))


def trade_price_ends(buckets, *keys):
    """First and last trade price of each group, from one pass."""
    traded = buckets.filter("trades > 0")
    return traded.groupBy(*keys).agg(
        F.min_by("last_price", "second").alias("first_price"),
        F.max_by("last_price", "second").alias("last_price"),
    )


def bucket_positions(buckets):
    """`pos`: the row number of each bucket in its session's (second, symbol) order.

    Minutes are counted first, so only the buckets of one minute are sorted in one task.
    """
    rows = buckets.withColumn("minute", S.minute_start("second"))
    sizes = rows.groupBy("session_date", "minute").agg(F.count("*").alias("n"))
    earlier = (
        W.partitionBy("session_date").orderBy("minute").rowsBetween(W.unboundedPreceding, -1)
    )
    starts = sizes.select(
        "session_date", "minute", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = W.partitionBy("session_date", "minute").orderBy("second", "symbol")
    rows = rows.withColumn("pos", F.row_number().over(inside))
    rows = rows.join(starts, ["session_date", "minute"])
    return rows.withColumn("pos", F.col("pos") + F.col("before")).drop("before", "minute")


def session_bounds(buckets, *keys):
    """First and last second, rows, symbols, trades and quotes, per session by default."""
    keys = keys or ("session_date",)
    per_symbol = buckets.groupBy(*keys, "symbol").agg(
        F.min("second").alias("lo"),
        F.max("second").alias("hi"),
        F.count("*").alias("n"),
        F.sum("trades").alias("t"),
        F.sum("quotes").alias("q"),
    )
    return per_symbol.groupBy(*keys).agg(
        F.min("lo").alias("min_sec"),
        F.max("hi").alias("max_sec"),
        F.sum("n").alias("rows"),
        F.count("*").alias("symbols"),
        F.sum("t").alias("trades"),
        F.sum("q").alias("quotes"),
    )


def spans_regular_session(bounds):
    """bounds with `date` (of the first second) and `spans`: data from open to close."""
    spans = (F.col("min_sec") <= S.bucket_start("date", OPEN_MINUTE)) & (
        F.col("max_sec") >= S.bucket_start("date", CLOSE_MINUTE)
    )
    return bounds.withColumn("date", S.et_date("min_sec")).withColumn("spans", spans)


def coverage(bounds, trades_only=False):
    """session_bounds with its coverage label: full, trades-only or partial."""
    labelled = spans_regular_session(bounds)
    if trades_only:
        label = F.when(F.col("spans") & (F.col("trades") > 0), "trades-only")
    else:
        both = (F.col("trades") > 0) & (F.col("quotes") > 0)
        label = F.when(F.col("spans") & both, "full")
    return labelled.withColumn("coverage", label.otherwise("partial"))
