"""The basket table along a clock, by events: its work goes with prints and bars, not members x seconds.

What a row shows either changes with completed bars only (shares and baselines of the last bar,
breadth, volume states), or grows with prints (dollars since the open, of the running bar and
before the open). The first part is made once per basket and bar. The second enters as events: a
member's sums of one clock step join its baskets' running sums, and since a member's dollars since
the open only grow, the largest member is a running minimum over all events of (-dollars, name).
Bars, events and the clock of a basket lie in one order, so rows are carried forward by window
functions over that order and no member is repeated for a second in which it did not trade.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions import session as S
from tickerloom.operators import metrics as M
from tickerloom.operators.grid import each
from tickerloom.schema import CLOSE_MINUTE, OPEN_MINUTE, PERSIST_BARS, PRE_OPEN_MINUTE

# What decides which windows a bar shows.
EDGES = ["open_sec", "close_sec", "pre_sec", "cum_end", "bars_done", "prev_regular", "key_minute"]
BAR, EVENT, TICK = 0, 1, 2


def _own(inp, *windows):
    """Columns of registered metrics' sums over these windows."""
    return [c for c, _, w in M.own_sums(inp) if w in windows]


def session_days(dates, from_minute, to_minute):
    """dates (session_date) with the seconds of its session and of the clock."""
    wall = lambda m: S.bucket_start("session_date", m)
    return dates.select(
        "session_date",
        wall(OPEN_MINUTE).alias("open_sec"),
        wall(CLOSE_MINUTE).alias("close_sec"),
        wall(PRE_OPEN_MINUTE).alias("pre_sec"),
        wall(from_minute).alias("clock_from"),
        wall(to_minute).alias("clock_to"),
    )


def _prints(inp, days):
    """Buckets of the configuration up to the end of the clock, with the dollars that count."""
    counted, auctions, extended = M._slices(inp)
    sec, opened = F.col("second"), F.col("open_sec")
    regular = (sec >= opened) & (sec < F.col("close_sec"))
    early = (sec >= F.col("pre_sec")) & (sec < opened)
    inside = {"since_open": regular, "completed": regular, "pre_market": early}
    own = [
        (F.when(inside[w], what).otherwise(0.0) if w in inside else what).alias(c)
        for c, what, w in M.own_sums(inp)
    ]
    rows = M.config_rows(inp).join(days, "session_date").filter(sec <= F.col("clock_to"))
    return rows.select(
        "session_date",
        "symbol",
        "second",
        "clock_from",
        S.bar_start("second", "open_sec", inp.bar_minutes).alias("bar_sec"),
        counted.alias("counted"),
        F.when(regular, auctions).otherwise(0.0).alias("auctions"),
        F.when(early, extended).otherwise(0.0).alias("extended"),
        F.when((F.col("trades") > 0) & regular, F.col("last_price")).alias("price"),
        *own,
    )


def bar_windows(inp, prints, days):
    """(session_date, at_sec: a bar's start, symbol) with the windows of the bars before it.

    One row for every bar of the clock and configured symbol, silent ones too: a baseline or the
    benchmark changes a member's state in a bar without prints.
    """
    bar = 60 * inp.bar_minutes
    first = F.least("clock_from", "open_sec") - (PERSIST_BARS + 1) * bar
    every = F.sequence(first, F.greatest("clock_to", "close_sec"), F.lit(bar).cast("bigint"))
    zero = F.lit(0.0)
    silent = each(days, M.config_symbols(inp), "symbol").select(
        "session_date", "symbol", F.explode(every).alias("bar_sec"),
        F.lit(None).cast("bigint").alias("second"), zero.alias("counted"), zero.alias("auctions"),
        F.lit(None).cast("double").alias("price"),
        *(zero.alias(c) for c in _own(inp, "previous_bar", "completed")),
    )
    rows = prints.select(*(f"`{c}`" for c in silent.columns)).unionByName(silent)
    traded = F.when(F.col("price").isNotNull(), F.col("second"))
    bars = rows.groupBy("session_date", "symbol", "bar_sec").agg(
        F.sum("counted").alias("counted"),
        F.sum("auctions").alias("auctions"),
        F.min_by("price", traded).alias("first_price"),
        F.max_by("price", traded).alias("last_price"),
        *(F.sum(f"`{c}`").alias(f"{c}__bar") for c in _own(inp, "previous_bar", "completed")),
    )
    order = W.partitionBy("session_date", "symbol").orderBy("bar_sec")
    before, through = (order.rowsBetween(W.unboundedPreceding, k) for k in (-1, 0))
    here = F.last("last_price", ignorenulls=True).over(through)
    bars = bars.join(days.select("session_date", "close_sec", "clock_from", "clock_to"), "session_date")
    bars = bars.withColumn("last_to_here", here)
    cols = {
        "cum_d": F.coalesce(F.sum("auctions").over(before), zero),
        **{c: F.coalesce(F.sum(f"`{c}__bar`").over(before), zero) for c in _own(inp, "completed")},
        "anchor": F.first("first_price", ignorenulls=True).over(before),
        **{f"bar{j}_d": F.lag("counted", j).over(order) for j in M._BARS},
        **{f"last{j}": F.lag("last_to_here", j).over(order) for j in M._BARS},
    }
    last = {"prev_d": F.lag("counted", 1).over(order)}
    last |= {c: F.lag(f"`{c}__bar`", 1).over(order) for c in _own(inp, "previous_bar")}
    bars = bars.select("*", *(e.alias(c) for c, e in (last | cols).items()))
    # After the close the completed windows stay those of the last session bar. A value that
    # is missing at a bar is missing at every earlier one, so carrying it forward is exact.
    in_session = F.col("bar_sec") <= F.col("close_sec")
    frozen = [F.last(F.when(in_session, F.col(f"`{c}`")), ignorenulls=True).over(through).alias(c) for c in cols]
    own = ["session_date", F.col("bar_sec").alias("at_sec"), "symbol", *(f"`{c}`" for c in last), *frozen, "clock_from", "clock_to"]
    return bars.select(*own).filter("at_sec BETWEEN clock_from AND clock_to").drop("clock_from", "clock_to")


def bar_part(inp, prints, days):
    """Per session, bar start (`bar_sec`) and basket, UNION too: all that completed bars decide."""
    windows = bar_windows(inp, prints, days)
    clock = days.select(
        "session_date",
        F.explode(F.sequence("clock_from", "clock_to", F.lit(60 * inp.bar_minutes).cast("bigint"))).alias("at_sec"),
    )
    rows = windows.join(M.clocks(clock, inp.bar_minutes), M.KEYS)
    rows = rows.join(M.config_table(inp.members, inp.benchmark), "symbol")
    rows = M._with_volume_state(M._with_sides(rows), inp)
    df = rows.groupBy(*M.KEYS, "basket").agg(
        *(F.sum(f"`{c}`").alias(c) for c in ("prev_d", "cum_d", *_own(inp, "previous_bar", "completed"))),
        M._top("prev_d"),
        *(F.first(c).alias(c) for c in EDGES),
        *(F.expr(e) for e in M.COUNTS),
    )
    df = M._with_baselines(df.filter(F.col("basket") != M.MARK), inp)
    return df.withColumnRenamed("at_sec", "bar_sec")


def events(inp, prints, step):
    """Per session, basket, bar and clock step with prints: dollars that enter, and the largest member
    so far among those that traded.
    """
    own = _own(inp, "since_open", "pre_market", "current_bar")
    tick = F.col("clock_from") + F.ceil((F.col("second") - F.col("clock_from")) / step) * step
    tick = F.greatest(tick.cast("bigint"), F.col("clock_from")).alias("at_sec")
    steps = prints.groupBy("session_date", "symbol", "bar_sec", tick).agg(
        *(F.sum(f"`{c}`").alias(c) for c in ("counted", "auctions", "extended", *own))
    )
    so_far = W.partitionBy("session_date", "symbol").orderBy("at_sec", "bar_sec")
    so_far = so_far.rowsBetween(W.unboundedPreceding, 0)
    steps = steps.withColumn("live", F.sum("auctions").over(so_far)).withColumn("pre", F.sum("extended").over(so_far))
    rows = steps.join(M.config_table(inp.members), "symbol")
    top = lambda c: F.expr(f"min(if({c} > 0, struct(-{c} AS d, symbol), NULL)) AS {c}_d_top")
    return rows.groupBy("session_date", "basket", "bar_sec", "at_sec").agg(
        F.sum("auctions").alias("live_d"),
        F.sum("extended").alias("pre_d"),
        F.sum("counted").alias("cur_d"),
        *(F.sum(f"`{c}`").alias(c) for c in own),
        top("live"),
        top("pre"),
    )


def series_frame(inp, step, from_minute=OPEN_MINUTE, to_minute=CLOSE_MINUTE):
    """basket_frame with all families at every step of the sessions of inp.asof, and `outside`."""
    bar = 60 * inp.bar_minutes
    if bar % step or (OPEN_MINUTE - from_minute) % inp.bar_minutes:
        raise ValueError("step must divide the bar, and the clock must start on a bar")
    spark = inp.buckets.sparkSession
    dates = inp.asof.select("session_date").distinct()
    days = session_days(dates, from_minute, to_minute)
    prints = _prints(inp, days)

    whole = inp.buckets if inp.whole is None else inp.whole
    span = whole.groupBy("session_date").agg(F.min("second").alias("lo"), F.max("second").alias("hi"))
    names = M.config_table(inp.members).select("basket").distinct()
    clock = each(days.join(span, "session_date", "left"), names, "basket")
    # Sessions and baskets are few and their rows many: deal them before they become seconds.
    clock = clock.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session_date", "basket")
    ticks = clock.select(
        "session_date",
        "basket",
        "open_sec",
        F.struct("lo", "hi").alias("span"),
        F.explode(F.sequence("clock_from", "clock_to", F.lit(step).cast("bigint"))).alias("at_sec"),
        F.lit(TICK).alias("kind"),
    )
    ticks = ticks.withColumn("bar_sec", S.bar_start("at_sec", "open_sec", inp.bar_minutes)).drop("open_sec")
    bars = bar_part(inp, prints, days)
    keys = ["session_date", "basket", "bar_sec"]
    bars = bars.select(*keys, F.struct(*(f"`{c}`" for c in bars.columns if c not in keys)).alias("bar"))
    bars = bars.withColumn("at_sec", F.col("bar_sec")).withColumn("kind", F.lit(BAR))
    rows = ticks.unionByName(bars, True).unionByName(
        events(inp, prints, step).withColumn("kind", F.lit(EVENT)), True
    )

    part = W.partitionBy("session_date", "basket")
    along = part.orderBy("bar_sec", "at_sec", "kind").rowsBetween(W.unboundedPreceding, 0)
    in_bar = W.partitionBy(*keys).orderBy("at_sec", "kind").rowsBetween(W.unboundedPreceding, 0)
    zero = F.lit(0.0)
    rows = rows.select(
        *M.KEYS,
        "basket",
        "bar_sec",
        "kind",
        "span",
        F.coalesce(F.sum("live_d").over(along), zero).alias("live_d"),
        F.coalesce(F.sum("pre_d").over(along), zero).alias("pre_d"),
        F.min("live_d_top").over(along).alias("live_d_top"),
        F.min("pre_d_top").over(along).alias("pre_d_top"),
        F.coalesce(F.sum("cur_d").over(in_bar), zero).alias("cur_d"),
        *(F.coalesce(F.sum(f"`{c}`").over(along), zero).alias(c) for c in _own(inp, "since_open", "pre_market")),
        *(F.coalesce(F.sum(f"`{c}`").over(in_bar), zero).alias(c) for c in _own(inp, "current_bar")),
        F.first("bar", ignorenulls=True).over(in_bar).alias("bar"),
    ).filter(F.col("kind") == TICK)
    df = rows.select("*", "bar.*", "span.*").drop("bar", "span", "kind")
    df = df.selectExpr(
        "*",
        "least(at_sec + 1, close_sec) AS live_end",
        "least(at_sec + 1, open_sec) AS pre_end",
        "cast(lo IS NULL OR at_sec < lo OR at_sec > hi AS int) AS outside",
    )
    return M.finished(df, inp, shares=True, baseline=True, breadth=True, volume=True)


def changes(df, keys, columns):
    """Rows of a series (session_date, at_sec, *keys, *columns) that differ from the one before.

    Together with the clock they hold the whole series: each row stands until the next one.
    """
    order = W.partitionBy("session_date", *keys).orderBy("at_sec")
    now = F.struct(*columns)
    before = F.lag(now).over(order)
    new = F.row_number().over(order) == 1
    df = df.withColumn("_changed", new | ~now.eqNullSafe(before))
    return df.filter("_changed").drop("_changed")
