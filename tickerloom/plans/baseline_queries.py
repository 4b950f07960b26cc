"""Queries on baselines: grids, profiles, coverage, floors."""

from pyspark.sql import functions as F

from tickerloom.functions.stats import with_robust
from tickerloom.operators import baselines as BL
from tickerloom.operators import rolling
from tickerloom.plans import sqltext as Q
from tickerloom.plans import stored, tapes
from tickerloom.plans.base import register, select, shape
from tickerloom.sources import store

HALF_HOUR = 30


def line_inputs(spark, sf):
    return (
        stored.buckets(spark, sf, "line"),
        tapes.symbols(spark),
        stored.dates(spark, sf, "line"),
    )


J5 = "d:session_date s:symbol i:minute_of_day f:shares f:dollars f:auction_dollars i:prints"


@register("minute_grid", select(Q.bars("line"), J5, "bar"))
def minute_grid(spark, sf):
    return shape(BL.minute_grid(*line_inputs(spark, sf)), J5)


W2 = "d:session_date s:symbol i:minute_of_day f:since_open"


@register("since_open_sums", select(Q.bars("line", HALF_HOUR), W2, "bar",
    since_open="sum(auction_dollars) OVER (PARTITION BY session_date, symbol ORDER BY minute_of_day"
    " ROWS UNBOUNDED PRECEDING)"))  # fmt: skip
def since_open_sums(spark, sf):
    from pyspark.sql import Window as W

    run = (
        W.partitionBy("session_date", "symbol")
        .orderBy("minute_of_day")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    grid = BL.minute_grid(*line_inputs(spark, sf), bar_minutes=HALF_HOUR)
    return shape(grid.withColumn("since_open", F.sum("auction_dollars").over(run)), W2)


A13 = "s:symbol i:n f:med f:sigma"
A13_SQL = select(
    Q.buckets("event"),
    A13,
    "(SELECT session_date, symbol, sum(c_dollars) AS d FROM bs GROUP BY ALL)",
    "GROUP BY symbol",
    n="count(*)",
    med="median(d)",
    sigma="mad(d) * 1.4826",
)


@register("robust", A13_SQL)
def robust_daily(spark, sf):
    """Centre and spread of each symbol's daily counted dollars."""
    from tickerloom.functions import slices

    daily = (
        stored.buckets(spark, sf, "event")
        .groupBy("session_date", "symbol")
        .agg(F.sum(slices.counted()[1]).alias("d"))
    )
    per_symbol = daily.groupBy("symbol").agg(F.collect_list("d").alias("a"))
    per_symbol = per_symbol.withColumn("n", F.size("a"))
    return shape(with_robust(per_symbol, a=("med", "sigma")), A13)


A14 = "s:symbol i:minute_of_day i:days f:median_shares f:sigma_shares f:median_dollars f:sigma_dollars"


@register("ticker_profile", select(Q.profiles("line"), A14, "tp"))
def ticker_profile(spark, sf):
    return shape(BL.ticker_profile(*line_inputs(spark, sf)), A14)


@register("ticker_profile_half_hour", select(Q.profiles("event", HALF_HOUR), A14, "tp"))
def ticker_profile_half_hour(spark, sf):
    df = BL.ticker_profile(
        stored.buckets(spark, sf, "event"),
        tapes.symbols(spark),
        stored.dates(spark, sf, "event"),
        HALF_HOUR,
    )
    return shape(df, A14)


ROLL = 10


def _rolling(profiles):
    """profiles(...) over the latest ROLL sessions only."""
    days = "days AS (SELECT DISTINCT session_date FROM bs WHERE minute_of_day BETWEEN 570 AND 959"
    return [c.replace(days, f"{days} ORDER BY session_date DESC LIMIT {ROLL}") for c in profiles]


def rolled(spark, sf):
    """The sample store after a nightly roll for every session of the tape, one after the other."""

    def write(path):
        samples = rolling.SampleStore(path, ROLL)
        for date in stored.dates(spark, sf, "line"):
            samples.roll(stored.buckets(spark, sf, "line"), date)

    return rolling.SampleStore(stored._once(spark, sf, "line_samples", write), ROLL)


@register("rolling_ticker_profile", select(_rolling(Q.profiles("line")), A14, "tp"))
def rolling_ticker_profile(spark, sf):
    """Ticker baselines of the latest sessions, from a store that is rolled session by session."""
    return shape(rolled(spark, sf).ticker_profile(spark, tapes.symbols(spark)), A14)


A15 = "d:session_date s:uncovered"


@register("skipped_days", select(Q.profiles("wide", HALF_HOUR), A15, "gone", "GROUP BY session_date",
    uncovered="string_agg(symbol, ' ' ORDER BY symbol)"))
def skipped_days(spark, sf):
    df = BL.skipped_days(
        stored.buckets(spark, sf, "wide"),
        tapes.members(spark),
        stored.dates(spark, sf, "wide"),
        HALF_HOUR,
    )
    return shape(df.withColumn("uncovered", F.array_join("uncovered", " ")), A15)


A16 = (
    "s:basket i:minute_of_day i:days f:median_share f:sigma_share"
    " i:cum_days f:median_cum_share f:sigma_cum_share"
)


@register("basket_profile", select(Q.profiles("line"), A16, "bp"))
def basket_profile(spark, sf):
    buckets, _, dates = line_inputs(spark, sf)
    return shape(BL.basket_profile(buckets, tapes.members(spark), dates), A16)


@register("rolling_basket_profile", select(_rolling(Q.profiles("line")), A16, "bp"))
def rolling_basket_profile(spark, sf):
    """Basket baselines of the latest sessions, from a store that is rolled session by session."""
    return shape(rolled(spark, sf).basket_profile(spark, tapes.members(spark)), A16)


@register("basket_profile_half_hour", select(Q.profiles("wide", HALF_HOUR), A16, "bp"))
def basket_profile_half_hour(spark, sf):
    df = BL.basket_profile(
        stored.buckets(spark, sf, "wide"),
        tapes.members(spark),
        stored.dates(spark, sf, "wide"),
        HALF_HOUR,
    )
    return shape(df, A16)


DAYS = "d:session_date s:basket i:minute_of_day f:share f:cum_share"


@register("basket_day_shares", select(Q.profiles("line"), DAYS, "samples"))
def basket_day_shares(spark, sf):
    buckets, _, dates = line_inputs(spark, sf)
    return shape(BL.basket_day_shares(buckets, tapes.members(spark), dates), DAYS)


A17 = "i:minute_of_day x:sigma_floor_shares x:sigma_floor_dollars"


@register("volume_floors", select(Q.profiles("line"), A17, "fl"))
def volume_floors(spark, sf):
    return shape(BL.volume_floors(stored.ticker_profile(spark, sf, "line")), A17)


A18 = "i:minute_of_day f:sigma_floor_flowshare f:sigma_floor_cumshare"


@register("share_floors", select(Q.profiles("line"), A18, "fl"))
def share_floors(spark, sf):
    return shape(BL.share_floors(stored.basket_profile(spark, sf, "line")), A18)


A10 = "s:symbol i:rows i:first_minute i:last_minute i:minutes i:ok"
A10_SQL = select(
    Q.profiles("line"),
    A10,
    "tp",
    "GROUP BY symbol",
    rows="count(*)",
    first_minute="min(minute_of_day)",
    last_minute="max(minute_of_day)",
    minutes="count(DISTINCT minute_of_day)",
    ok="CASE WHEN count(*) = 390 AND min(minute_of_day) = 570 AND max(minute_of_day) = 959"
    " AND count(DISTINCT minute_of_day) = 390 THEN 1 ELSE 0 END",
)


@register("profile_shape", A10_SQL)
def profile_shape(spark, sf):
    df = store.check_profile_shape(stored.ticker_profile(spark, sf, "line"), "symbol")
    return shape(df.withColumn("ok", F.col("ok").cast("int")), A10)


J8 = "s:basket s:built s:current"
J8_SQL = """WITH m AS (SELECT n_name AS basket, n_regionkey AS region, c_custkey AS k, 'C' || c_custkey AS symbol
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
built AS (SELECT basket, string_agg(symbol, ' ' ORDER BY symbol) AS built FROM m
          WHERE k % 7 <> 3 OR region = 4 GROUP BY basket),
now AS (SELECT CASE WHEN region = 2 THEN basket || ' NEW' ELSE basket END AS basket,
               string_agg(symbol, ' ' ORDER BY symbol) AS current FROM m GROUP BY ALL)
SELECT basket, built, current FROM built FULL JOIN now USING (basket)
WHERE built IS DISTINCT FROM current"""


@register("stale_baskets", J8_SQL)
def stale_baskets(spark, sf):
    """Nations' customers: baselines built before some joined, and before a region's were renamed."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    n = spark.read.parquet(f"{sf}/nation.parquet")
    m = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("basket"), "n_regionkey", "c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol")
    )
    built = m.filter("c_custkey % 7 <> 3 OR n_regionkey = 4").groupBy("basket")
    built = built.agg(F.array_sort(F.collect_set("symbol")).alias("members"))
    renamed = F.when(F.col("n_regionkey") == 2, F.concat("basket", F.lit(" NEW"))).otherwise(F.col("basket"))
    df = store.stale_baskets(built, m.withColumn("basket", renamed))
    return shape(
        df.withColumn("built", F.array_join("built", " ")).withColumn(
            "current", F.array_join("current", " ")
        ),
        J8,
    )


@register("ticker_profile_store", select(Q.profiles("line"), A14, "tp"))
def ticker_profile_store(spark, sf):
    """Ticker baselines as written and read back."""
    return shape(stored.ticker_profile(spark, sf, "line"), A14)


S10 = A16 + " s:members"


@register("basket_profile_store", select(
    [*Q.profiles("line"), "names AS (SELECT basket, string_agg(symbol, ' ' ORDER BY symbol) AS members FROM mem GROUP BY basket)"],
    S10, "bp JOIN names USING (basket)"))
def basket_profile_store(spark, sf):
    """Basket baselines as written and read back, with their member stamp."""
    df = stored.basket_profile(spark, sf, "line")
    return shape(df.withColumn("members", F.array_join("members", " ")), S10)


S11 = (
    "i:minute_of_day x:sigma_floor_shares x:sigma_floor_dollars f:sigma_floor_flowshare"
    " f:sigma_floor_cumshare f:frac"
)


@register("floors_store", select(Q.profiles("line"), S11, "fl", frac="0.25"))
def floors_store(spark, sf):
    """Sigma floors as written and read back."""
    return shape(stored.floors(spark, sf, "line"), S11)
