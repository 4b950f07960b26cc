"""Time-of-day-matched baselines over a list of sessions.

Bars stay sparse until the end: a silent bar is a zero sample that is counted, not stored,
so no symbol x minute x day grid is shuffled.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions import session as S
from tickerloom.functions import slices
from tickerloom.functions.stats import padded, ratio, with_robust
from tickerloom.schema import (
    BASKET_PROFILE,
    CLOSE_MINUTE,
    FLOOR_FRACTION,
    LOOKBACK_SESSIONS,
    OPEN_MINUTE,
    TICKER_PROFILE,
)

UNION = ""  # reserved basket name: every member once


def regular_dates(buckets, n=LOOKBACK_SESSIONS, through=None):
    """The latest n session dates with data in their own regular session, ascending.

    The list is bounded by n and becomes the partition filter of every baseline scan.
    """
    regular = buckets.filter(S.in_regular(S.minute_of_day_sql("second")))
    if through is not None:
        regular = regular.filter(F.col("session_date") <= F.lit(through))
    latest = regular.select("session_date").distinct().orderBy(F.desc("session_date")).limit(n)
    return sorted(r["session_date"] for r in latest.collect())


def check_dates(dates):
    """Baselines need at least one session, each once."""
    dates = list(dates)
    if not dates:
        raise ValueError("no input sessions")
    if len(set(dates)) != len(dates):
        raise ValueError(f"duplicate session date in {dates}")
    return dates


def check_sessions_have_data(buckets, dates):
    """Raise for a date without a single bucket in its own regular session."""
    found = set(regular_dates(of_dates(buckets, dates), n=len(dates)))
    empty = [str(d) for d in dates if d not in found]
    if empty:
        raise ValueError(f"no data in the regular session of {empty}")
    return dates


def of_dates(buckets, dates):
    """Buckets of the given sessions (partition filter)."""
    return buckets.filter(F.col("session_date").isin(*check_dates(dates)))


def session_bars(buckets, bar_minutes=1, counted=None, auctions=None):
    """Per session, symbol and regular-session bar: the slices, and all prints."""
    S.check_bar(bar_minutes)
    shares, dollars = counted or slices.counted()
    _, auction_dollars = auctions or slices.counted_with_auctions()
    minute = S.minute_of_day_sql("second")
    rows = buckets.select(
        "session_date",
        "symbol",
        S.bar_minute(minute, bar_minutes).alias("minute_of_day"),
        S.minute_of_day("second").alias("minute"),
        shares.alias("shares"),
        dollars.alias("dollars"),
        auction_dollars.alias("auction_dollars"),
        F.col("trades").alias("prints"),
    ).filter(S.in_regular("minute"))
    return rows.groupBy("session_date", "symbol", "minute_of_day").agg(
        *[F.sum(c).alias(c) for c in ("shares", "dollars", "auction_dollars", "prints")]
    )


def _bar_array(bar_minutes):
    first, last = F.lit(OPEN_MINUTE), F.lit(CLOSE_MINUTE - bar_minutes)
    return F.sequence(first, last, F.lit(bar_minutes))


def with_bars(df, bar_minutes=1):
    """df with one row per regular-session bar."""
    S.check_bar(bar_minutes)
    return df.select("*", F.explode(_bar_array(bar_minutes)).alias("minute_of_day"))


def minute_grid(buckets, symbols, dates, bar_minutes=1):
    """Dense bars: every symbol, session and bar, zeros where the tape was silent."""
    day_array = F.array(*[F.lit(d) for d in check_dates(dates)])
    grid = with_bars(
        symbols.select("symbol", F.explode(day_array).alias("session_date")), bar_minutes
    )
    bars = session_bars(of_dates(buckets, dates), bar_minutes)
    keys = ["session_date", "symbol", "minute_of_day"]
    return grid.join(bars, keys, "left").fillna(0, ["shares", "dollars", "auction_dollars", "prints"])


def ticker_profile(buckets, symbols, dates, bar_minutes=1, counted=None):
    """Median and sigma of counted shares and dollars per symbol and bar.

    Every symbol x bar has len(dates) samples; silence counts as zero.
    """
    n = len(check_sessions_have_data(buckets, check_dates(dates)))
    bars = session_bars(of_dates(buckets, dates), bar_minutes, counted)
    return ticker_profile_of(bars, symbols, n, bar_minutes)


def ticker_profile_of(bars, symbols, n, bar_minutes=1):
    """ticker_profile of the bars of n sessions."""
    samples = bars.groupBy("symbol", "minute_of_day").agg(
        F.collect_list("shares").alias("s"), F.collect_list("dollars").alias("d")
    )
    full = with_bars(symbols.select("symbol").distinct(), bar_minutes).join(
        samples, ["symbol", "minute_of_day"], "left"
    )
    full = full.select(
        "symbol",
        "minute_of_day",
        F.lit(n).alias("days"),
        padded("s", F.lit(n)).alias("s"),
        padded("d", F.lit(n)).alias("d"),
    )
    out = with_robust(
        full, s=("median_shares", "sigma_shares"), d=("median_dollars", "sigma_dollars")
    )
    return out.select(*TICKER_PROFILE.names)


def uncovered_members(bars, members, dates):
    """(session_date, symbol): union members without a single regular-session print."""
    day_array = F.array(*[F.lit(d) for d in check_dates(dates)])
    union = members.select("symbol").distinct()
    wanted = union.select(F.explode(day_array).alias("session_date"), "symbol")
    active = bars.filter("prints > 0").select("session_date", "symbol").distinct()
    return wanted.join(active, ["session_date", "symbol"], "left_anti")


def skipped_days(buckets, members, dates, bar_minutes=1):
    """Sessions left out of every basket baseline, with the members that caused it."""
    bars = session_bars(of_dates(buckets, dates), bar_minutes)
    gone = uncovered_members(bars, members, dates)
    return gone.groupBy("session_date").agg(
        F.array_sort(F.collect_set("symbol")).alias("uncovered")
    )


def with_union(members):
    """basket members and, under the reserved name, every member once."""
    union = members.select(F.lit(UNION).alias("basket"), "symbol").distinct()
    return members.select("basket", "symbol").unionByName(union)


def _basket_days(bars, members, dates, bar_minutes):
    """Per covered session, basket and bar: the basket's share, alone and since the open."""
    keys = ["session_date", "minute_of_day"]
    sums = (
        bars.join(with_union(members), "symbol")
        .groupBy(*keys, "basket")
        .agg(F.sum("dollars").alias("d"), F.sum("auction_dollars").alias("a"))
    )
    bad = uncovered_members(bars, members, dates).select("session_date").distinct()
    day_array = F.array(*[F.lit(d) for d in dates])
    names = with_union(members).select("basket").distinct()
    grid = with_bars(names.select("basket", F.explode(day_array).alias("session_date")), bar_minutes)
    full = (
        grid.join(sums, [*keys, "basket"], "left")
        .fillna(0.0, ["d", "a"])
        .join(bad, "session_date", "left_anti")
    )
    since_open = (
        W.partitionBy("session_date", "basket")
        .orderBy("minute_of_day")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    full = full.withColumn("ca", F.sum("a").over(since_open))
    same_bar = W.partitionBy(*keys)
    is_union = F.col("basket") == UNION
    full = full.withColumn("ud", F.max(F.when(is_union, F.col("d"))).over(same_bar))
    full = full.withColumn("uca", F.max(F.when(is_union, F.col("ca"))).over(same_bar))
    return full.filter(~is_union).select(
        *keys,
        "basket",
        ratio("d", "ud").alias("share"),
        ratio("ca", "uca").alias("cum_share"),
    )


def basket_day_shares(buckets, members, dates, bar_minutes=1):
    """The daily samples of basket_profile."""
    bars = session_bars(of_dates(buckets, dates), bar_minutes)
    return _basket_days(bars, members, list(dates), bar_minutes)


def basket_profile(buckets, members, dates, bar_minutes=1):
    """Median and sigma of each basket's share per bar and of its share since the open.

    A session on which some member never printed is left out for every basket. A bar in
    which no member traded gives no sample.
    """
    check_sessions_have_data(buckets, check_dates(dates))
    bars = session_bars(of_dates(buckets, dates), bar_minutes)
    return basket_profile_of(bars, members, dates, bar_minutes)


def basket_profile_of(bars, members, dates, bar_minutes=1):
    """basket_profile of the bars of these sessions."""
    days = _basket_days(bars, members, list(dates), bar_minutes)
    samples = days.groupBy("basket", "minute_of_day").agg(
        F.collect_list("share").alias("s"), F.collect_list("cum_share").alias("c")
    )
    lists = members.groupBy("basket").agg(F.array_sort(F.collect_set("symbol")).alias("members"))
    full = with_bars(lists, bar_minutes).join(samples, ["basket", "minute_of_day"], "left")
    none = F.array().cast("array<double>")
    full = full.withColumn("s", F.coalesce("s", none)).withColumn("c", F.coalesce("c", none))
    full = full.withColumn("days", F.size("s")).withColumn("cum_days", F.size("c"))
    out = with_robust(
        full, s=("median_share", "sigma_share"), c=("median_cum_share", "sigma_cum_share")
    )
    return out.select(*BASKET_PROFILE.names)


def check_fraction(frac):
    """The floor fraction must be a finite number >= 0."""
    if not (0 <= frac < float("inf")):
        raise ValueError(f"floor fraction must be finite and not negative, got {frac}")
    return frac


def volume_floors(profile, frac=FLOOR_FRACTION, bar_minutes=1):
    """frac x the median over symbols of each volume sigma, per bar.

    An empty profile, or a symbol without one of the session's bars, fails the job.
    """
    check_fraction(frac)
    found = profile.groupBy("minute_of_day").agg(
        (F.median("sigma_shares") * frac).alias("sigma_floor_shares"),
        (F.median("sigma_dollars") * frac).alias("sigma_floor_dollars"),
        F.count("*").alias("symbols"),
    )
    bars = with_bars(profile.sparkSession.range(1), bar_minutes).select("minute_of_day")
    every = W.partitionBy(F.lit(1))  # the bars of one session
    full = bars.join(found, "minute_of_day", "left").withColumn("most", F.max("symbols").over(every))
    text = F.concat(F.lit("ticker baselines without bar "), F.col("minute_of_day").cast("string"))
    short = F.when(F.coalesce(F.col("symbols") < F.col("most"), F.lit(True)), F.raise_error(text).cast("double"))
    return full.select(
        "minute_of_day",
        F.coalesce(short, F.col("sigma_floor_shares")).alias("sigma_floor_shares"),
        F.coalesce(short, F.col("sigma_floor_dollars")).alias("sigma_floor_dollars"),
    )


def share_floors(profile, frac=FLOOR_FRACTION):
    """frac x the median over baskets with at least one sample, per bar; 0 without one."""
    check_fraction(frac)
    floor = lambda sigma, n: F.coalesce(
        F.median(F.when(F.col(n) >= 1, F.col(sigma))) * frac, F.lit(0.0)
    )
    return profile.groupBy("minute_of_day").agg(
        floor("sigma_share", "days").alias("sigma_floor_flowshare"),
        floor("sigma_cum_share", "cum_days").alias("sigma_floor_cumshare"),
    )


def floors(tickers, baskets, frac=FLOOR_FRACTION, bar_minutes=1):
    """All four floor families per bar."""
    return volume_floors(tickers, frac, bar_minutes).join(share_floors(baskets, frac), "minute_of_day", "full")
