"""Data-quality and load reports."""

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions import session as S
from tickerloom.functions import slices
from tickerloom.functions.stats import ratio
from tickerloom.operators.grid import each
from tickerloom.schema import OPEN_MINUTE

# The hours of the load report, in minutes of the New York day.
LOAD_FROM_MINUTE, LOAD_TO_MINUTE = 240, 1200
RVOL_PROBS = (0.10, 0.25, 0.50, 0.75, 0.90)
LATENCY_PROBS = (0.50, 0.95, 0.99, 1.0)


def floor_index_quantiles(df, value, probs, keys=()):
    """Exact quantiles by rank floor(p * (n - 1)), without sorting a group in one task.

    Values are counted first, then put into logarithmic value bins; bin counts give the bin
    that holds each rank, and only the distinct values of that bin are ordered.
    """
    keys = list(keys)
    v = F.col(value)
    counts = df.filter(v.isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count("*").alias("n"))
    sign = F.when(F.col("v") < 0, -1).otherwise(1)
    bin_ = sign * F.floor(F.log1p(F.abs(F.col("v").cast("double"))) * 64)
    counts = counts.withColumn("bin", bin_)
    bins = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("in_bin"))
    up_to = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("total", F.sum("in_bin").over(W.partitionBy(*keys)))
    bins = bins.withColumn("below", F.sum("in_bin").over(up_to) - F.col("in_bin"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    ranks = bins.select("*", wanted)
    rank = F.floor(F.col("p") * (F.col("total") - 1))
    ranks = ranks.withColumn("rank", rank).filter(
        (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("in_bin"))
    )
    ranks = ranks.select(*keys, "bin", "p", "rank", "below", "total")
    touched = ranks.select(*keys, "bin").distinct()
    inner = (
        W.partitionBy(*keys, "bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    )
    inside = counts.join(touched, [*keys, "bin"], "left_semi").withColumn(
        "through", F.sum("n").over(inner)
    )
    hit = (F.col("rank") < F.col("below") + F.col("through")) & (
        F.col("rank") >= F.col("below") + F.col("through") - F.col("n")
    )
    out = inside.join(ranks, [*keys, "bin"]).filter(hit)
    return out.select(*keys, "p", F.col("v").alias("value"), F.col("total").alias("samples"))


def exact_median(df, value, keys):
    """(keys, median): the mean of the two middle ranks, found without sorting a group in one task."""
    up = floor_index_quantiles(df, value, [0.5], keys).select(*keys, F.col("value").alias("low"))
    flipped = df.withColumn(value, -F.col(value))  # the rank from above is that from below here
    down = floor_index_quantiles(flipped, value, [0.5], keys).select(*keys, (-F.col("value")).alias("high"))
    return up.join(down, keys).select(*keys, ((F.col("low") + F.col("high")) / 2).alias("median"))


def rvol_check(buckets, profile, minute, bar_minutes=1, counted=None):
    """Per session: quantiles over symbols of counted shares in one bar / its median.

    Symbols with a zero median are counted as thin, not compared; a session whose data does
    not reach the bar gives no row.
    """
    if not (OPEN_MINUTE <= minute < 960):
        raise ValueError(f"minute {minute} is outside the regular session")
    shares, _ = counted or slices.counted()
    start = S.bucket_start("session_date", minute)
    end = start + 60 * bar_minutes
    span = buckets.groupBy("session_date").agg(
        F.min("second").alias("lo"), F.max("second").alias("hi")
    )
    span = span.filter((F.col("hi") >= start) & (F.col("lo") < end)).select("session_date")
    sec = F.col("second")
    volume = (
        buckets.filter((sec >= start) & (sec < end))
        .groupBy("session_date", "symbol")
        .agg(F.sum(shares).alias("shares"))
    )
    base = profile.filter(F.col("minute_of_day") == minute).select("symbol", "median_shares")
    rvol = each(span, base, "symbol").join(volume, ["session_date", "symbol"], "left").select(
        "session_date", ratio(F.coalesce("shares", F.lit(0.0)), "median_shares").alias("rvol")
    )
    q = floor_index_quantiles(rvol, "rvol", RVOL_PROBS, ["session_date"])
    quantiles = q.groupBy("session_date").agg(
        *[
            F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{int(p * 100)}")
            for p in RVOL_PROBS
        ]
    )
    counts = rvol.groupBy("session_date").agg(
        F.count("rvol").alias("compared"),
        F.count_if(F.col("rvol").isNull()).alias("thin"),
        F.count_if(F.col("rvol").between(0.5, 2.0)).alias("within"),
    )
    return counts.join(quantiles, "session_date", "left")


def feed_latency(events, keys=()):
    """p50, p95, p99 and max of receive time minus SIP time, in whole milliseconds."""
    ms = F.expr("recv_ns div 1000000 - sip_ns div 1000000")
    timed = events.filter(F.col("sip_ns") > 0).withColumn("latency_ms", ms)
    q = floor_index_quantiles(timed, "latency_ms", LATENCY_PROBS, keys)
    pick = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    return q.groupBy(*keys).agg(
        pick(0.50).alias("p50"),
        pick(0.95).alias("p95"),
        pick(0.99).alias("p99"),
        pick(1.0).alias("max"),
        F.max("samples").alias("samples"),
    )


def second_load(tape, dates):
    """Trades, quotes and all messages of every second 04:00-20:00, silent ones included."""
    first = S.bucket_start("session_date", LOAD_FROM_MINUTE)
    last = S.bucket_start("session_date", LOAD_TO_MINUTE) - 1
    grid = dates.select("session_date", F.explode(F.sequence(first, last)).alias("second"))
    trade = F.col("kind") == "trade"
    counts = (
        tape.select(S.second_of("sip_ns").alias("second"), "kind")
        .groupBy("second")
        .agg(F.count_if(trade).alias("trades"), F.count_if(~trade).alias("quotes"))
    )
    full = grid.join(counts, "second", "left").fillna(0, ["trades", "quotes"])
    return full.select(
        "session_date", "second", "trades", "quotes", (F.col("trades") + F.col("quotes")).alias("total")
    )


def rolling_peak(load, column="total", widths=(1,)):
    """Per session and width: the highest mean rate over so many seconds and where it starts first.

    All widths come from one sort of each session's seconds.
    """
    widths = [widths] if isinstance(widths, int) else widths
    order = W.partitionBy("session_date").orderBy("second")
    ahead = lambda k: order.rowsBetween(0, k - 1)
    full = lambda k: F.when(F.count("*").over(ahead(k)) == k, F.sum(column).over(ahead(k)))
    spans = load.select("session_date", "second", *[full(k).alias(f"n{k}") for k in widths])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("width"), F.col(f"n{k}").alias("n")) for k in widths]))
    spans = spans.select("session_date", "second", each.alias("w")).select("session_date", "second", "w.*")
    best = spans.filter("n IS NOT NULL").groupBy("session_date", "width", "n").agg(F.min("second").alias("start"))
    top = best.groupBy("session_date", "width").agg(F.max("n").alias("n"), F.max_by("start", "n").alias("start"))
    rate = (F.col("n") / F.col("width")).alias("rate")
    return top.select("session_date", "width", rate, F.col("start").alias("at_sec"))


def sustained_rate(load, column="total", minutes=60):
    """Per session: mean messages per second over the first hour."""
    opened = S.bucket_start("session_date", OPEN_MINUTE)
    sec = F.col("second")
    hour = load.filter((sec >= opened) & (sec < opened + 60 * minutes))
    return hour.groupBy("session_date").agg((F.sum(column) / (60 * minutes)).alias("rate"))


def open_histogram(load):
    """The seconds 09:29:55-09:35:00."""
    opened = S.bucket_start("session_date", OPEN_MINUTE)
    return load.filter((F.col("second") >= opened - 5) & (F.col("second") < opened + 300))


def symbol_load(tape, universe):
    """Per symbol: messages all day and 09:30-10:30, with quote-to-trade ratios."""
    trade = F.col("kind") == "trade"
    rows = tape.select("symbol", "kind", S.second_of("sip_ns").alias("second"))
    minute = S.minute_of_day("second")
    hour = (minute >= OPEN_MINUTE) & (minute < OPEN_MINUTE + 60)
    counts = rows.groupBy("symbol").agg(
        F.count_if(trade).alias("trades"),
        F.count_if(~trade).alias("quotes"),
        F.count_if(trade & hour).alias("trades_open_hour"),
        F.count_if(~trade & hour).alias("quotes_open_hour"),
    )
    names = ["trades", "quotes", "trades_open_hour", "quotes_open_hour"]
    full = universe.select("symbol").join(counts, "symbol", "left").fillna(0, names)
    return full.select(
        "symbol",
        *names,
        ratio(F.col("quotes").cast("double"), F.col("trades").cast("double")).alias("qt_ratio"),
        ratio(
            F.col("quotes_open_hour").cast("double"), F.col("trades_open_hour").cast("double")
        ).alias("qt_ratio_open_hour"),
    ).orderBy(F.desc(F.col("trades") + F.col("quotes")), "symbol")


def reconcile(capture, flat, universe, from_ns, to_ns):
    """Per symbol and feed: messages of two sources inside [from_ns, to_ns).

    Both sides have (symbol, kind, sip_ns). `exact` marks symbols that agree.
    """

    def counted(df, name):
        inside = df.filter((F.col("sip_ns") >= from_ns) & (F.col("sip_ns") < to_ns))
        return inside.groupBy("symbol", "kind").agg(F.count("*").alias(name))

    kinds = F.explode(F.array(F.lit("trade"), F.lit("quote"))).alias("kind")
    grid = universe.select("symbol", kinds)
    both = counted(capture, "capture").join(counted(flat, "flat"), ["symbol", "kind"], "full")
    full = grid.join(both, ["symbol", "kind"], "left").fillna(0, ["capture", "flat"])
    delta = F.col("flat") - F.col("capture")
    return full.withColumn("delta", delta).withColumn("exact", (delta == 0).cast("int"))


def reconcile_summary(report):
    """Totals per feed: counts, delta, delta in percent of the flat file, exact symbols."""
    out = report.groupBy("kind").agg(
        F.sum("capture").alias("capture"),
        F.sum("flat").alias("flat"),
        F.sum("delta").alias("delta"),
        F.sum("exact").cast("bigint").alias("exact"),
        F.count("*").alias("symbols"),
    )
    pct = ratio(F.col("delta").cast("double") * 100, F.col("flat").cast("double"))
    return out.withColumn("delta_pct", F.coalesce(pct, F.lit(0.0)))


# How far two recomputations may differ, and the digits that are compared.
RVOL_TOLERANCE, DOLLAR_TOLERANCE, TOLERANCE_SLACK = 0.01, 0.005, 1e-12
PRINTED_DIGITS = {"cum_share": 4, "cum_share_typ": 4, "cum_share_z": 1}


def compare_metrics(view, check, keys=("session_date", "at_sec", "basket")):
    """Two recomputations side by side, with a verdict for each of three metrics.

    Baselines must agree exactly, relative volume to 0.01, dollars to 0.5%; a missing value
    must be missing on both sides.
    """
    keys = list(keys)
    names = ["last_minute_dollar_vol", "baseline_20d_dollar_vol", "relative_vol"]
    a = view.select(*keys, *[F.col(n).alias(f"v_{n}") for n in names], F.lit(1).alias("in_v"))
    b = check.select(*keys, *[F.col(n).alias(f"c_{n}") for n in names], F.lit(1).alias("in_c"))
    both = a.join(b, keys, "full")
    v = lambda n: F.col(f"v_{n}")
    c = lambda n: F.col(f"c_{n}")
    base_ok = v(names[1]).eqNullSafe(c(names[1]))
    gap = v(names[2]).isNull() | c(names[2]).isNull()
    rvol_ok = F.when(gap, v(names[2]).isNull() & c(names[2]).isNull()).otherwise(
        F.abs(v(names[2]) - c(names[2])) <= RVOL_TOLERANCE + TOLERANCE_SLACK
    )
    dv, dc = F.coalesce(v(names[0]), F.lit(0.0)), F.coalesce(c(names[0]), F.lit(0.0))
    rel = F.when(dc != 0, (dv - dc) / F.when(dc != 0, dc)).when(dv == 0, 0.0)
    present = F.col("in_v").isNotNull() & F.col("in_c").isNotNull()
    return both.select(
        *keys,
        rel.alias("rel_delta"),
        (present & base_ok).cast("int").alias("base_pass"),
        (present & rvol_ok).cast("int").alias("rvol_pass"),
        (present & F.coalesce(F.abs(rel) <= DOLLAR_TOLERANCE, F.lit(False))).cast("int").alias("last_pass"),
    )


def compare_cumulative(view, check, keys=("session_date", "at_sec", "basket")):
    """Since-open share, its typical value and z of two recomputations, to the printed digit.

    Both shares must agree to a hundredth of a percent, z to a tenth; a missing value must be
    missing on both sides, and so must a row. z_delta is signed: view less check.
    """
    keys = list(keys)
    digits = PRINTED_DIGITS
    a = view.select(*keys, *[F.col(n).alias(f"v_{n}") for n in digits], F.lit(1).alias("in_v"))
    b = check.select(*keys, *[F.col(n).alias(f"c_{n}") for n in digits], F.lit(1).alias("in_c"))
    both = a.join(b, keys, "full")
    present = F.col("in_v").isNotNull() & F.col("in_c").isNotNull()
    same = lambda n: F.round(f"v_{n}", digits[n]).eqNullSafe(F.round(f"c_{n}", digits[n]))
    verdicts = [(present & same(n)).cast("int").alias(f"{n}_pass") for n in digits]
    return both.select(*keys, *verdicts, (F.col("v_cum_share_z") - F.col("c_cum_share_z")).alias("z_delta"))


def compare_summary(compared):
    """One row: checks, passes per metric, worst (by size, with its sign) and mean dollar difference."""
    return compared.agg(
        F.count("*").alias("checks"),
        F.sum("base_pass").alias("base_pass"),
        F.sum("rvol_pass").alias("rvol_pass"),
        F.sum("last_pass").alias("last_pass"),
        F.when(F.max("rel_delta") >= -F.min("rel_delta"), F.max("rel_delta"))
        .otherwise(F.min("rel_delta"))
        .alias("worst_rel_delta"),
        F.avg("rel_delta").alias("mean_rel_delta"),
    )


def _clock_pieces(day_ns):
    """sip_ns of messages in order -> [(low, high, value)]: where a clock ends up that starts in [low, high).

    Elsewhere it stays. A message moves a clock at most a day forward, so what a row of messages
    does is a step function; functions of rows that follow each other compose.
    """

    def near(times):
        # All within a day of each other: the first one that is taken brings every later one.
        least = np.minimum.accumulate(times)
        at = np.flatnonzero(np.append(True, times[1:] < least[:-1]))
        values = np.maximum.accumulate(times[::-1])[::-1][at]
        lows = times[at] - day_ns
        return list(zip(lows.tolist(), [int(values[0]), *lows[:-1].tolist()], values.tolist()))

    def far(times):
        lows, highs, values = [], [], []
        for s in reversed(times.tolist()):  # what the messages after s do is known: put s before them
            k = bisect.bisect_right(lows, s) - 1
            value = values[k] if k >= 0 and s < highs[k] else s
            low = s - day_ns
            a = bisect.bisect_right(highs, low)
            b = bisect.bisect_left(lows, s)
            new = [(low, s, value)]
            if a < b:
                if lows[a] < low:
                    new.insert(0, (lows[a], low, values[a]))
                if highs[b - 1] > s:
                    new.append((s, highs[b - 1], values[b - 1]))
            lows[a:b], highs[a:b], values[a:b] = zip(*new)
        return list(zip(lows, highs, values))

    return lambda times: near(times) if times.max() - times.min() <= day_ns else far(times)


def session_clock(tape, chunk=65_536):
    """Latest believable SIP time of each session.

    Messages are received in `arrival` order (any number). A clock that stands at zero takes any
    time; after that a message moves it forward by 24 hours at most, else it is corrupt and ignored.
    Rows of messages are summed up as step functions where they lie, spread by arrival, so a session
    is never sorted in one task; a session's functions are then applied one after the other. That
    is the same number of stages for any chain of jumps.
    """
    pieces = _clock_pieces(24 * 3600 * 1_000_000_000)
    rows = tape.select("session_date", "arrival", "sip_ns").filter("sip_ns > 0")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    n = int(tape.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "session_date", "arrival").sortWithinPartitions("session_date", "arrival")
    names = ["session_date", "arrival", "run", "first_ns", "low", "high", "value"]

    def steps(batches):
        run = 0
        for batch in batches:
            days, times = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.append(True, days[1:] != days[:-1])).tolist() if len(days) else []
            cuts = sorted({c for a, b in zip(cuts, [*cuts[1:], len(days)]) for c in range(a, b, chunk)})
            for a, b in zip(cuts, [*cuts[1:], len(days)]):
                low, high, value = zip(*pieces(times[a:b]))
                run += 1
                head = [batch.column(0).take(pa.array([a] * len(low))), batch.column(1).take(pa.array([a] * len(low)))]
                more = [pa.array(x, pa.int64()) for x in ([run] * len(low), [int(times[a])] * len(low), low, high, value)]
                yield pa.RecordBatch.from_arrays([*head, *more], names)

    schema = f"session_date {kind['session_date']}, arrival {kind['arrival']}, run bigint, first_ns bigint"
    found = rows.mapInArrow(steps, f"{schema}, low bigint, high bigint, value bigint")

    def run(table):
        _, arrival, run, first, low, high, value = (c.to_pylist() for c in table.columns)
        at = list(zip(arrival, run))
        order = sorted(range(len(at)), key=at.__getitem__)
        clock, moved = first[order[0]], None
        for k in order:
            if at[k] != moved and low[k] <= clock < high[k]:
                clock, moved = value[k], at[k]  # one piece of a function at most
        return pa.Table.from_arrays([table.column(0)[:1], pa.array([clock], pa.int64())], ["session_date", "clock_ns"])

    return found.groupBy("session_date").applyInArrow(run, f"session_date {kind['session_date']}, clock_ns bigint")


def tape_stats(tape):
    """One row of counters over a tape."""
    trade = F.col("kind") == "trade"
    return tape.agg(
        F.count("*").alias("messages"),
        F.count_if(trade).alias("trades"),
        F.count_if(~trade).alias("quotes"),
        F.min("sip_ns").alias("first_ns"),
        F.max("sip_ns").alias("last_ns"),
    )


