"""Basket metrics as of a second.

All metrics come from one member-level frame: per (session_date, at_sec, symbol) the
dollars and prices of every window a metric looks at, from a single pass over bucket_1s.
Baskets, the union of members and the benchmark are then small joins and one group-by on
(session_date, at_sec).

Where `at_sec` is the as-of second and bars are `bar_minutes` long:
  previous bar  = the last completed bar        current bar = the running one through at_sec
  since open    = from 09:30, clamped at 16:00  pre-market  = from 04:00, clamped at 09:30
"""

import datetime as dt
from dataclasses import dataclass, field, replace
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions import session as S
from tickerloom.functions import slices
from tickerloom.functions.stats import zguard
from tickerloom.operators import registry
from tickerloom.operators.baselines import UNION
from tickerloom.schema import (
    BENCHMARK,
    CLOSE_MINUTE,
    DEAD_BAND,
    MIN_SAMPLED_DAYS,
    OPEN_MINUTE,
    PERSIST_BARS,
    PRE_OPEN_MINUTE,
    VOLUME_MULTIPLE,
    ZONE,
)

KEYS = ["session_date", "at_sec"]
MARK = "\u0001"  # reserved basket name of the benchmark row

_BARS = tuple(range(1, PERSIST_BARS + 1))
GRID_BLOCKS = 32
COUNTS = [
    "count(*) AS members",
    "count_if(side > 0) AS up",
    "count_if(side < 0) AS down",
    "count_if(measured) AS n_measured",
    "count_if(vol = 1) AS n_unusual",
    "count_if(vol = -1) AS n_unmeasured",
    "count_if(side > 0 AND vol = 1) AS n_up_on_vol",
]
SUMS = ["prev_d", "cur_d", "live_d", "cum_d", "pre_d"]
DOLLARS = ["prev_d", "cur_d", "live_d", "cum_d", "pre_d"] + [f"bar{j}_d" for j in _BARS]
PRICES = ["anchor"] + [f"last{j}" for j in _BARS]


@dataclass
class Inputs:
    """What the metric functions read. Baselines are only needed by metrics that compare."""

    buckets: DataFrame
    members: DataFrame
    asof: DataFrame
    tickers: DataFrame | None = None
    baskets: DataFrame | None = None
    floors: DataFrame | None = None
    benchmark: str = BENCHMARK
    bar_minutes: int = 1
    counted: tuple[Column, Column] | None = None
    auctions: tuple[Column, Column] | None = None
    extended: tuple[Column, Column] | None = None
    whole: DataFrame | None = None  # the sessions' buckets where `buckets` is cut; default: buckets
    universe: DataFrame | None = None  # the symbols of the tape, to check the configuration by
    windows: Any = None  # builds the member frame; default: member_windows
    own: dict = field(default_factory=dict)  # {name: WindowMetric} to compute in the same pass
    checked: bool = False  # the configuration has been checked against baselines and universe

    def with_(self, **changes):
        """A copy with some fields changed."""
        same = not {"members", "tickers", "universe", "benchmark"} & changes.keys()
        return replace(self, **{"checked": self.checked and same, **changes})

    def at(self, at_sec):
        """A copy for one second: the scan is cut to that session and to what came before."""
        day = dt.datetime.fromtimestamp(at_sec, ZoneInfo(ZONE)).date()
        only = F.col("session_date").between(day, day) & (F.col("second") <= at_sec)
        asof = asof_literal(self.buckets.sparkSession, at_sec)
        whole = self.buckets.filter(F.col("session_date").between(day, day))
        return replace(self, buckets=self.buckets.filter(only), whole=whole, asof=asof)


def asof_literal(spark, at_sec):
    """One as-of second."""
    one = spark.range(at_sec, at_sec + 1).withColumnRenamed("id", "at_sec")
    return one.select(S.et_date("at_sec").alias("session_date"), "at_sec")


def asof_clock(dates, *hms):
    """The same wall-clock seconds on every session of `dates` (session_date)."""
    at = F.expr("ns div 1000000000")
    times = F.explode(F.array(*[F.lit(t) for t in hms])).alias("hms")
    ns = S.et_ns("session_date", "hms").alias("ns")
    return dates.select("session_date", times).select("session_date", ns).select(
        "session_date", at.alias("at_sec")
    )


def outside_span(buckets, asof):
    """as-of rows with `outside`: 1 where the session has no data around that second."""
    span = buckets.groupBy("session_date").agg(
        F.min("second").alias("lo"), F.max("second").alias("hi")
    )
    at = F.col("at_sec")
    gone = F.col("lo").isNull() | (at < F.col("lo")) | (at > F.col("hi"))
    return asof.join(span, "session_date", "left").select(*KEYS, gone.cast("int").alias("outside"))


def clocks(asof, bar_minutes=1):
    """as-of rows with every window edge."""
    S.check_bar(bar_minutes)
    bar = 60 * bar_minutes
    key = S.bar_minute_sql(S.minute_of_day_sql(f"cum_end - {bar}"), bar_minutes)
    return (
        asof.selectExpr(
            *KEYS,
            f"{S.bucket_start_sql('session_date', OPEN_MINUTE)} AS open_sec",
            f"{S.bucket_start_sql('session_date', CLOSE_MINUTE)} AS close_sec",
            f"{S.bucket_start_sql('session_date', PRE_OPEN_MINUTE)} AS pre_sec",
        )
        .selectExpr("*", f"{S.bar_start_sql('at_sec', 'open_sec', bar_minutes)} AS bar_sec")
        .selectExpr(
            "*",
            f"bar_sec - {bar} AS prev_sec",
            "least(at_sec + 1, close_sec) AS live_end",
            "greatest(least(bar_sec, close_sec), open_sec) AS cum_end",
            "least(at_sec + 1, open_sec) AS pre_end",
            f"(least(bar_sec, close_sec) - open_sec) div {bar} AS bars_done",
        )
        .selectExpr(
            "*",
            "prev_sec >= open_sec AND prev_sec < close_sec AS prev_regular",
            f"CASE WHEN cum_end > open_sec THEN {key} END AS key_minute",
        )
    )


def config_table(members, benchmark=None):
    """(basket, symbol): the members, every member once under UNION, the benchmark under MARK."""
    rows = members.select("basket", "symbol")
    rows = rows.unionByName(members.select(F.lit(UNION).alias("basket"), "symbol")).distinct()
    if benchmark is None:
        return rows
    mark = members.sparkSession.range(1).select(F.lit(MARK).alias("basket"), F.lit(benchmark).alias("symbol"))
    return rows.unionByName(mark)


def config_symbols(inp):
    """Every basket member and the benchmark once."""
    mark = inp.members.sparkSession.range(1).select(F.lit(inp.benchmark).alias("symbol"))
    return inp.members.select("symbol").unionByName(mark).distinct()


def config_rows(inp):
    """Buckets of the configuration's symbols only."""
    return inp.buckets.join(config_symbols(inp), "symbol", "left_semi")


def _slices(inp):
    return (
        (inp.counted or slices.counted())[1],
        (inp.auctions or slices.counted_with_auctions())[1],
        (inp.extended or slices.extended_hours())[1],
    )


def own_sums(inp):
    """(column, what is summed, window) of every sum that registered metrics add to the pass."""
    return [
        (_own(name, part), what.cast("double"), window)
        for name, metric in inp.own.items()
        for part, (what, window) in metric.sums.items()
    ]


def _own(name, part):
    return f"own__{name}__{part}"


def _own_names(inp):
    return [c for c, _, _ in own_sums(inp)]


def member_windows(inp):
    """Per as-of second and symbol: dollars and prices of every window (one pass)."""
    bar = 60 * inp.bar_minutes
    counted, auctions, extended = _slices(inp)
    rows = config_rows(inp).select(
        "session_date",
        "symbol",
        "second",
        counted.alias("counted"),
        auctions.alias("auctions"),
        extended.alias("extended"),
        F.when(F.col("trades") > 0, F.col("last_price")).alias("price"),
        *[what.alias(c) for c, what, _ in own_sums(inp)],
    ).join(clocks(inp.asof, inp.bar_minutes), "session_date")
    rows = rows.filter("second <= at_sec")

    def within(lo, hi):
        return f"second >= {lo} AND second < {hi}"

    def dollars(what, lo, hi, name):
        return f"sum(if({within(lo, hi)}, {what}, 0D)) AS {name}"

    end = [f"cum_end - {j * bar}" for j in range(PERSIST_BARS + 1)]
    when = lambda hi: f"if(price IS NOT NULL AND {within('open_sec', hi)}, second, NULL)"
    aggs = [
        dollars("counted", "prev_sec", "bar_sec", "prev_d"),
        dollars("counted", "bar_sec", "at_sec + 1", "cur_d"),
        dollars("auctions", "open_sec", "live_end", "live_d"),
        dollars("auctions", "open_sec", "cum_end", "cum_d"),
        dollars("extended", "pre_sec", "pre_end", "pre_d"),
        *[dollars("counted", end[j], end[j - 1], f"bar{j}_d") for j in _BARS],
        f"min_by(price, {when(end[0])}) AS anchor",
        *[f"max_by(price, {when(end[j - 1])}) AS last{j}" for j in _BARS],
        *[dollars(f"`{c}`", *registry.WINDOWS[w], f"`{c}`") for c, _, w in own_sums(inp)],
    ]
    return rows.groupBy(*KEYS, "symbol").agg(*[F.expr(a) for a in aggs])


def _grid(inp):
    """Every as-of second with every (basket, symbol) of the configuration.

    The result has a row for each of them, silent members too; neither side is tape. The
    configuration is dealt to blocks by symbol, and the clock meets every block.
    """
    times = clocks(inp.asof, inp.bar_minutes)
    block = F.explode(F.sequence(F.lit(0), F.lit(GRID_BLOCKS - 1))).alias("block")
    config = config_table(inp.members, inp.benchmark)
    config = config.withColumn("block", F.pmod(F.hash("symbol"), F.lit(GRID_BLOCKS)))
    return times.select("*", block).join(config, "block").drop("block")


def member_frame(inp, breadth=False, volume=False):
    """The grid with each member's windows; price side and volume state when asked for."""
    if inp.windows and inp.own:
        raise ValueError("kept windows have no sums of registered metrics")
    build = inp.windows or member_windows
    df = _grid(inp).join(build(inp), [*KEYS, "symbol"], "left")
    df = df.fillna(0.0, [*DOLLARS, *_own_names(inp)])
    if breadth:
        df = _with_sides(df)
    if volume:
        df = _with_volume_state(df, inp)
    return df


def _with_sides(df):
    """`ret{j}`, `bench{j}`, `measured` and the persistent `side` of every row."""
    rets = [f"if(anchor > 0 AND last{j} > 0, last{j} / anchor - 1, NULL) AS ret{j}" for j in _BARS]
    df = df.selectExpr("*", *rets)
    at = f"OVER (PARTITION BY {', '.join(KEYS)})"
    df = df.selectExpr(
        "*", *[f"max(if(basket = '{MARK}', ret{j}, NULL)) {at} AS bench{j}" for j in _BARS]
    )

    def state(j):
        d = f"(ret{j} - bench{j})"
        return (
            f"CASE WHEN {d} > {DEAD_BAND} THEN 1 WHEN {d} < -{DEAD_BAND} THEN -1"
            f" WHEN {d} IS NOT NULL THEN 0 END AS state{j}"
        )

    df = df.selectExpr("*", *[state(j) for j in _BARS])
    known = " AND ".join(f"state{j} IS NOT NULL" for j in _BARS)
    same = " AND ".join(f"state{j} = state1" for j in _BARS)
    measured = f"(coalesce(bars_done >= {PERSIST_BARS}, false) AND {known})"
    return df.selectExpr(
        "*",
        f"{measured} AS measured",
        f"if({measured} AND coalesce({same}, false), state1, 0) AS side",
    )


def _with_volume_state(df, inp):
    """`vol`: 1 unusual, 0 normal, -1 unmeasured; the newest bar without a pass decides."""
    by_minute = W.partitionBy("symbol").orderBy("minute_of_day")
    meds = inp.tickers.select(
        "symbol",
        F.col("minute_of_day").alias("key_minute"),
        F.col("median_dollars").alias("med1"),
        *[F.lag("median_dollars", j - 1).over(by_minute).alias(f"med{j}") for j in _BARS[1:]],
    )
    df = df.join(meds, ["symbol", "key_minute"], "left")
    verdict = "1"
    for j in reversed(_BARS):
        verdict = (
            f"CASE WHEN coalesce(med{j}, 0) = 0 THEN -1"
            f" WHEN bar{j}_d <= {VOLUME_MULTIPLE} * med{j} THEN 0 ELSE {verdict} END"
        )
    return df.selectExpr("*", f"if(bars_done >= {PERSIST_BARS}, {verdict}, NULL) AS vol")


def _top(dollars):
    """(-dollars, symbol) of the largest member; ties go to the first name."""
    pair = f"struct(-{dollars} AS d, symbol)"
    return F.expr(f"min(if({dollars} > 0, {pair}, NULL)) AS {dollars}_top")


def basket_frame(inp, shares=True, baseline=False, breadth=False, volume=False):
    """One row per as-of second and basket with every metric of the families asked for."""
    rows = member_frame(inp, breadth or volume, volume)
    aggs = [*COUNTS[:1], *[f"sum(`{c}`) AS `{c}`" for c in (*SUMS, *_own_names(inp))]]
    edges = [
        "open_sec", "bar_sec", "pre_end", "pre_sec", "live_end", "cum_end",
        "bars_done", "prev_regular", "key_minute",
    ]
    aggs += [f"first({c}) AS {c}" for c in edges]
    if breadth or volume:
        aggs += COUNTS[1:4]
    if volume:
        aggs += COUNTS[4:]
    aggs = [F.expr(a) for a in aggs]
    if shares:
        aggs += [_top(c) for c in ("prev_d", "live_d", "pre_d")]
    df = rows.groupBy(*KEYS, "basket").agg(*aggs)
    if baseline:
        df = _with_baselines(df, inp)
    return finished(df, inp, shares, baseline, breadth, volume)


def finished(df, inp, shares, baseline, breadth, volume):
    """Metrics of rows that hold sums, edges, counts and baselines of baskets and of UNION."""
    at = f"OVER (PARTITION BY {', '.join(KEYS)})"
    sums = [*SUMS, *_own_names(inp)]
    union = [f"max(if(basket = '{UNION}', `{c}`, NULL)) {at} AS `uni_{c}`" for c in sums]
    df = df.selectExpr("*", *union).filter(f"basket NOT IN ('{UNION}', '{MARK}')")
    df = _with_metrics(df, shares, baseline, breadth, volume)
    for name, metric in inp.own.items():
        place = lambda part: _own(name, part) if part in metric.sums else part  # noqa: B023
        of = lambda part: F.col(f"`{place(part)}`")  # noqa: B023
        of_union = lambda part: F.col(f"`uni_{place(part)}`")  # noqa: B023
        df = df.withColumn(name, metric.value(of, of_union))
    return df


def _with_baselines(df, inp):
    """The matched bar's baselines: member medians, the basket's shares, the floors."""
    member_medians = (
        inp.members.join(inp.tickers, "symbol")
        .groupBy("basket", F.col("minute_of_day").alias("key_minute"))
        .agg(F.sum("median_dollars").alias("base_d"))
    )
    df = df.join(member_medians, ["basket", "key_minute"], "left")
    if inp.baskets is None:
        return df
    profile = inp.baskets.select(
        "basket",
        F.col("minute_of_day").alias("key_minute"),
        "days", "median_share", "sigma_share",
        "cum_days", "median_cum_share", "sigma_cum_share",
    )
    level = inp.floors.select(
        F.col("minute_of_day").alias("key_minute"), "sigma_floor_flowshare", "sigma_floor_cumshare"
    )
    return df.join(profile, ["basket", "key_minute"], "left").join(level, "key_minute", "left")


def _with_metrics(df, shares, baseline, breadth, volume):
    after_open, completed = "live_end > open_sec", "cum_end > open_sec"
    pre = "pre_end > pre_sec"
    part = lambda a, b: f"{a} / nullif({b}, 0D)"
    when = lambda cond, value: f"CASE WHEN {cond} THEN {value} END"
    add = {
        "member_count": "members",
        "last_minute_dollar_vol": "prev_d",
        "current_minute_dollar_vol": "cur_d",
        "flow_share": part("cur_d", "uni_cur_d"),
        "prev_share": part("prev_d", "uni_prev_d"),
        "cum_share": when(after_open, part("live_d", "uni_live_d")),
        "cum_share_completed": when(completed, part("cum_d", "uni_cum_d")),
        "pre_vol": when(pre, "pre_d"),
        "pre_share": when(pre, part("pre_d", "uni_pre_d")),
    }
    if shares:
        for name, col, ok in (
            ("concentration", "prev_d", "true"),
            ("concentration_day", "live_d", after_open),
            ("pre_conc", "pre_d", pre),
        ):
            add[f"{name}_symbol"] = when(ok, f"{col}_top.symbol")
            add[name] = when(ok, part(f"-{col}_top.d", col))
    steps = [add]
    if baseline:
        steps.append({"baseline_20d_dollar_vol": when("prev_regular", "base_d")})
        steps.append({"relative_vol": part("prev_d", "baseline_20d_dollar_vol")})
    with_shares = baseline and "median_share" in df.columns
    if breadth or volume:
        shown = "n_measured > 0"
        steps.append(
            {
                "breadth_up": when(shown, "up"),
                "breadth_down": when(shown, "down"),
                "breadth_inline": when(shown, "members - up - down"),
                "breadth": when(shown, "up / members"),
            }
        )
    if volume:
        known = f"bars_done >= {PERSIST_BARS} AND n_unmeasured < members"
        steps.append(
            {
                "vol_unusual": when(known, "n_unusual"),
                "vol_unmeasured": when(known, "n_unmeasured"),
                "up_on_vol": when(f"{known} AND n_measured > 0", "n_up_on_vol"),
            }
        )
    for step in steps:
        df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in step.items()])
    if not with_shares:
        return df
    z = zguard("prev_share", "median_share", "sigma_share", "sigma_floor_flowshare")
    cum_z = zguard(
        "cum_share_completed", "median_cum_share", "sigma_cum_share", "sigma_floor_cumshare"
    )
    typical = when("cum_share_completed IS NOT NULL AND cum_days > 0", "median_cum_share")
    return df.select(
        "*",
        F.when(F.expr(f"prev_regular AND days >= {MIN_SAMPLED_DAYS}"), z).alias("flow_share_z"),
        F.expr(f"{typical} AS cum_share_typ"),
        F.when(F.expr(f"cum_days >= {MIN_SAMPLED_DAYS}"), cum_z).alias("cum_share_z"),
    ).selectExpr(
        "*", "CASE WHEN bar_sec <= open_sec THEN pre_share ELSE cum_share_z END AS rank_key"
    )


def benchmark_status(inp):
    """The benchmark's return since the open through the last completed bar."""
    mark = inp.buckets.filter(F.col("symbol") == inp.benchmark)
    one = inp.with_(buckets=mark)
    w = (inp.windows or member_windows)(one)
    ok = (F.col("bars_done") >= 1) & (F.col("anchor") > 0) & (F.col("last1") > 0)
    ret = F.when(ok, F.col("last1") / F.col("anchor") - 1)
    times = clocks(inp.asof, inp.bar_minutes)
    return times.join(w, KEYS, "left").select(*KEYS, ret.alias("benchmark_return"))


def member_returns(inp):
    """Since-open return and difference to the benchmark of every member (newest window)."""
    rows = _with_sides(member_frame(inp)).filter(F.col("basket") == UNION)
    return rows.select(
        *KEYS,
        "symbol",
        F.when(F.col("bars_done") >= 1, F.col("ret1")).alias("ret"),
        F.when(F.col("bars_done") >= 1, F.col("ret1") - F.col("bench1")).alias("diff"),
        "side",
        F.col("measured").cast("int").alias("measured"),
    )


def member_volume_states(inp):
    """Volume state of every member: unusual, normal or unmeasured; NULL before three bars."""
    rows = member_frame(inp, volume=True).filter(F.col("basket") == UNION)
    name = F.when(F.col("vol") == 1, "unusual").when(F.col("vol") == 0, "normal")
    return rows.select(*KEYS, "symbol", name.when(F.col("vol") == -1, "unmeasured").alias("vol_state"))


def ranked(df, key="rank_key"):
    """df with `row_rank` per as-of second: key descending, NULL keys last, ties by name."""
    order = W.partitionBy(*KEYS).orderBy(F.desc_nulls_last(key), F.asc("basket"))
    return df.withColumn("row_rank", F.row_number().over(order))
