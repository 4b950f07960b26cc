"""Queries on basket metrics: one as-of clock on every session, and a whole series."""

from pyspark.sql import functions as F

from tickerloom.functions import display, slices
from tickerloom.operators import metrics as M
from tickerloom.operators import registry, table
from tickerloom.plans import sqltext as Q
from tickerloom.plans import stored
from tickerloom.plans.base import cols, pick, register, select, shape

# As-of wall times: before the open, first session minute, mid-session, after the close.
TIMES = ("08:45:30", "09:30:20", "09:33:00", "13:01:07", "15:59:59", "16:20:00")
KEY = "d:session_date i:at_sec s:basket "


def asof(spark, sf, tape="line"):
    return M.asof_clock(stored.session_dates(spark, sf, tape), *TIMES)


def inputs(spark, sf, baselines=True):
    return stored.inputs(spark, sf, asof(spark, sf), "line", baselines)


def _share_metric(name, spec):
    """A metric that needs no baseline."""

    def run(spark, sf):
        return shape(M.basket_frame(inputs(spark, sf, baselines=False)), KEY + spec)

    register(name, select(Q.share_ctes("line", TIMES), KEY + spec, "m1"))(run)


_share_metric("member_count", "i:member_count")
_share_metric("last_minute_dollar_vol", "f:last_minute_dollar_vol")
_share_metric("current_minute_dollar_vol", "f:current_minute_dollar_vol")
_share_metric("flow_share", "f:flow_share")
_share_metric("concentration", "s:concentration_symbol f:concentration")
_share_metric("cum_share", "f:cum_share")
_share_metric("cum_share_completed", "f:cum_share_completed")
_share_metric("concentration_day", "s:concentration_day_symbol f:concentration_day")
_share_metric("pre_vol", "f:pre_vol")
_share_metric("pre_share", "f:pre_share")
_share_metric("pre_conc", "s:pre_conc_symbol f:pre_conc")


def _baseline_metric(name, spec):
    """A metric against the matched minute's baseline."""

    def run(spark, sf):
        return shape(M.basket_frame(inputs(spark, sf), baseline=True), KEY + spec)

    ctes = [*Q.profiles("line"), *Q.asof(TIMES)] + [
        Q.WINDOWS, Q.GRID, Q.UNION, Q.BASKET, Q.SHARES, Q.BASELINES,
    ]
    register(name, select(ctes, KEY + spec, "m2"))(run)


_baseline_metric("baseline_20d_dollar_vol", "f:baseline_20d_dollar_vol")
_baseline_metric("relative_vol", "f:relative_vol")
_baseline_metric("flow_share_z", "f:flow_share_z")
_baseline_metric("cum_share_typ", "f:cum_share_typ")
_baseline_metric("cum_share_z", "f:cum_share_z")

WINDOW_CTES = [*Q.buckets("line"), Q.MEMBERS, *Q.asof(TIMES), Q.WINDOWS]
SIDE_CTES = [*WINDOW_CTES, Q.GRID, Q.BREADTH]

M14 = "d:session_date i:at_sec s:symbol f:ret f:diff f:side i:measured"
M14_SQL = select(
    SIDE_CTES,
    M14,
    "(SELECT DISTINCT ON (session_date, at_sec, symbol) * FROM side)",
    ret="CASE WHEN bars_done >= 1 THEN ret1 END",
    diff="CASE WHEN bars_done >= 1 THEN ret1 - bench1 END",
    measured="CASE WHEN measured THEN 1 ELSE 0 END",
)


@register("member_returns", M14_SQL)
def member_returns(spark, sf):
    return shape(M.member_returns(inputs(spark, sf, baselines=False)), M14)


M17 = KEY + "f:breadth_up f:breadth_inline f:breadth_down f:breadth"


@register("breadth", select(SIDE_CTES, M17, "br",
    breadth="breadth_up / (breadth_up + breadth_inline + breadth_down)"))
def breadth(spark, sf):
    return shape(M.basket_frame(inputs(spark, sf, baselines=False), breadth=True), M17)


M18 = "d:session_date i:at_sec f:benchmark_return s:flag"


@register("benchmark_status", select(SIDE_CTES, M18,
    "(SELECT session_date, at_sec, CASE WHEN bars_done >= 1 THEN ret1 END AS r FROM x JOIN clk USING (session_date, at_sec))",
    benchmark_return="r",
    flag="CASE WHEN r > 0.0010 THEN 'green' WHEN r < -0.0010 THEN 'red' WHEN r IS NOT NULL THEN 'yellow' END"))
def benchmark_status(spark, sf):
    df = M.benchmark_status(inputs(spark, sf, baselines=False))
    return shape(df.withColumn("flag", display.benchmark_flag("benchmark_return")), M18)


FULL_CTES = Q.metric_ctes("line", TIMES)
M19 = "d:session_date i:at_sec s:symbol s:vol_state"


@register("member_volume_state", select(FULL_CTES[:-1], M19,
    "(SELECT DISTINCT ON (session_date, at_sec, symbol) * FROM vs)"))
def member_volume_state(spark, sf):
    return shape(M.member_volume_states(inputs(spark, sf)), M19)


M20 = KEY + "f:vol_unusual f:vol_unmeasured"
M21 = KEY + "f:up_on_vol f:breadth_up"


@register("vol_detail", select(FULL_CTES, M20, "full_table"))
def vol_detail(spark, sf):
    return shape(M.basket_frame(inputs(spark, sf), volume=True), M20)


@register("up_on_vol", select(FULL_CTES, M21, "full_table"))
def up_on_vol(spark, sf):
    return shape(M.basket_frame(inputs(spark, sf), volume=True), M21)


M25 = KEY + "f:rank_key i:row_rank"


@register("row_rank", select(FULL_CTES, M25, "ranked_table"))
def row_rank(spark, sf):
    return shape(M.ranked(M.basket_frame(inputs(spark, sf), baseline=True)), M25)


_INTS = {"member_count", "row_rank", "outside"}


def _spec(columns):
    kind = lambda c: "s" if c.endswith("_symbol") else "i" if c in _INTS else "f"
    return KEY + " ".join(f"{kind(c)}:{c}" for c in columns)


DEV = _spec((*table.DEV_COLUMNS, "outside"))
TRADER = _spec((*table.TRADER_COLUMNS, "row_rank", "outside"))


@register("basket_table_dev", select(FULL_CTES, DEV, "full_table"))
def basket_table_dev(spark, sf):
    return shape(table.basket_table(inputs(spark, sf)), DEV)


@register("basket_table_trader", select(FULL_CTES, TRADER, "ranked_table"))
def basket_table_trader(spark, sf):
    return shape(table.basket_table(inputs(spark, sf), "trader"), TRADER)


P21 = KEY + "s:cum_share_z_flag s:breadth_flag"


@register("highlight_flags", select(FULL_CTES, P21, "full_table",
    cum_share_z_flag="CASE WHEN cum_share_z >= 2 THEN 'green' WHEN cum_share_z <= -2 THEN 'red' END",
    breadth_flag="CASE WHEN breadth_up / member_count > 0.70 THEN 'green'"
    " WHEN breadth_down / member_count > 0.70 THEN 'red' END"))  # fmt: skip
def highlight_flags(spark, sf):
    return shape(table.basket_table(inputs(spark, sf), flags=True), P21)


SERIES_SECONDS = f"""times AS (
  SELECT session_date, {Q.wall("session_date", 240)} + CAST(range AS BIGINT) * 60 AS at_sec
  FROM days_all CROSS JOIN range(0, 736))"""
SERIES_CTES = [
    *Q.profiles("line"),
    "days_all AS (SELECT DISTINCT session_date FROM bs)",
    SERIES_SECONDS,
    *Q.CLK,
    *Q.METRIC_TAIL,
]


@register("basket_series", select(SERIES_CTES, TRADER, "ranked_table"))
def basket_series(spark, sf):
    """The trader table at every minute 04:00-16:15 of every session."""
    inp = stored.inputs(spark, sf, stored.session_dates(spark, sf, "line"))
    df = table.basket_series(inp, step=60, mode="trader", from_minute=240, to_minute=975)
    return shape(df, TRADER)


# The table at every second: what bars decide comes from full_table at the bar's start, the rest
# from running sums over a row per second and member.
SECOND_CTES = [
    *SERIES_CTES,
    f"""edge AS (
  SELECT session_date, {Q.wall("session_date", 570)} AS open_s, {Q.wall("session_date", 960)} AS close_s,
         {Q.wall("session_date", 240)} AS pre_s FROM days_all)""",
    "secs AS (SELECT *, pre_s + CAST(range AS BIGINT) AS at_sec FROM edge CROSS JOIN range(0, 44101))",
    """put AS (
  SELECT session_date, symbol, second AS at_sec,
         CASE WHEN second >= open_s AND second < close_s THEN a_dollars ELSE 0 END AS a,
         CASE WHEN second >= pre_s AND second < open_s THEN x_dollars ELSE 0 END AS x
  FROM bs JOIN edge USING (session_date))""",
    """run AS (
  SELECT session_date, at_sec, symbol, sum(coalesce(a, 0)) OVER w AS live, sum(coalesce(x, 0)) OVER w AS pre
  FROM secs CROSS JOIN (SELECT DISTINCT symbol FROM mem) LEFT JOIN put USING (session_date, at_sec, symbol)
  WINDOW w AS (PARTITION BY session_date, symbol ORDER BY at_sec ROWS UNBOUNDED PRECEDING))""",
    "all_run AS (SELECT session_date, at_sec, sum(live) AS u_live, sum(pre) AS u_pre FROM run GROUP BY ALL)",
    """bask AS (
  SELECT session_date, at_sec, basket, sum(live) AS live, sum(pre) AS pre,
         min(struct_pack(d := -live, s := symbol)) AS live_top, min(struct_pack(d := -pre, s := symbol)) AS pre_top
  FROM run JOIN mem USING (symbol) GROUP BY ALL)""",
    """every AS (
  SELECT secs.session_date, secs.at_sec, bask.basket, ft.cum_share_typ, ft.cum_share_z, ft.relative_vol,
         ft.breadth_up, ft.member_count, ft.up_on_vol, ft.concentration_symbol, ft.concentration,
         CASE WHEN secs.at_sec >= open_s THEN live / nullif(u_live, 0) END AS cum_share,
         CASE WHEN secs.at_sec >= open_s AND live > 0 THEN live_top.s END AS concentration_day_symbol,
         CASE WHEN secs.at_sec >= open_s THEN -live_top.d / nullif(live, 0) END AS concentration_day,
         pre AS pre_vol, pre / nullif(u_pre, 0) AS pre_share,
         CASE WHEN pre > 0 THEN pre_top.s END AS pre_conc_symbol,
         -pre_top.d / nullif(pre, 0) AS pre_conc,
         CASE WHEN secs.at_sec < open_s + 60 THEN pre / nullif(u_pre, 0) ELSE ft.cum_share_z END AS rank_key,
         CASE WHEN lo IS NULL OR secs.at_sec < lo OR secs.at_sec > hi THEN 1 ELSE 0 END AS outside
  FROM secs JOIN bask USING (session_date, at_sec) JOIN all_run USING (session_date, at_sec)
  JOIN full_table ft ON ft.session_date = secs.session_date AND ft.basket = bask.basket
    AND ft.at_sec = secs.at_sec - secs.at_sec % 60
  LEFT JOIN (SELECT session_date, min(second) AS lo, max(second) AS hi FROM b GROUP BY session_date) sp
    ON sp.session_date = secs.session_date)""",
    f"""shown AS (
  SELECT {pick(TRADER)} FROM (
    SELECT *, row_number() OVER (PARTITION BY session_date, at_sec ORDER BY rank_key DESC NULLS LAST, basket) AS row_rank
    FROM every))""",
]
_SHOWN = ", ".join(name for _, name in cols(TRADER)[3:])
SECOND_SQL = f"""WITH {", ".join(SECOND_CTES)}
SELECT * EXCLUDE (before, nth) FROM (
  SELECT *, lag(row({_SHOWN})) OVER w AS before, row_number() OVER w AS nth FROM shown
  WINDOW w AS (PARTITION BY session_date, basket ORDER BY at_sec))
WHERE nth = 1 OR row({_SHOWN}) IS DISTINCT FROM before"""


@register("basket_series_every_second", SECOND_SQL)
def basket_series_every_second(spark, sf):
    """The trader table at every second 04:00-16:15 of every session: the rows that differ from the one before."""
    inp = stored.inputs(spark, sf, stored.session_dates(spark, sf, "line"))
    return table.basket_changes(inp, 1, "trader", 240, 975, shaped=lambda df: shape(df, TRADER))


OUT = "d:session_date i:at_sec i:outside"


@register("as_of_outside_span", select(
    [*Q.buckets("line"), *Q.asof(TIMES),
     "span AS (SELECT session_date, min(second) AS lo, max(second) AS hi FROM b GROUP BY session_date)"],
    OUT, "times JOIN span USING (session_date)",
    outside="CASE WHEN at_sec < lo OR at_sec > hi THEN 1 ELSE 0 END"))
def as_of_outside_span(spark, sf):
    buckets = stored.buckets(spark, sf, "line")
    return shape(M.outside_span(buckets, asof(spark, sf)), OUT)


UX2 = KEY + "f:flow_share"
UX2_CTES = [
    c.replace("block_dollars + non_price_forming_dollars AS c_dollars", "0 AS c_dollars")
    for c in Q.share_ctes("line", TIMES)
]


@register("custom_slice", select(UX2_CTES, UX2, "m1"))
def custom_slice(spark, sf):
    """flow_share on a slice of the caller's: continuous prints only."""
    inp = inputs(spark, sf, baselines=False).with_(counted=slices.class_slice(["continuous"]))
    return shape(M.basket_frame(inp), UX2)


def _block_dollars(inp):
    """A user metric: block dollars since the open."""
    rows = inp.buckets.join(M.clocks(inp.asof, inp.bar_minutes), "session_date")
    sec = F.col("second")
    rows = rows.filter((sec >= F.col("open_sec")) & (sec < F.col("live_end")))
    return (
        rows.join(inp.members, "symbol")
        .groupBy(*M.KEYS, "basket")
        .agg(F.sum("block_dollars").alias("block_dollars_day"))
    )


UX1 = KEY + "f:flow_share f:block_dollars_day"
UX1_SQL = select(
    [*FULL_CTES, """blk AS (SELECT session_date, at_sec, basket, sum(block_dollars) AS block_dollars_day
      FROM bs JOIN clk USING (session_date) JOIN mem USING (symbol)
      WHERE second >= open_sec AND second < live_end GROUP BY ALL)"""],
    UX1,
    "full_table LEFT JOIN blk USING (session_date, at_sec, basket)",
)


@register("registered_metric", UX1_SQL)
def registered_metric(spark, sf):
    """The dev table with a metric of the user's own."""
    registry.unregister_metric("block_dollars_day")
    registry.register_metric("block_dollars_day", _block_dollars)
    df = table.basket_table(inputs(spark, sf), extra=["block_dollars_day"])
    return shape(df, UX1)


def _block_share():
    """A metric in the shared pass: a basket's block dollars since the open against all members'."""
    sums = {"block": (F.col("block_dollars"), "since_open")}
    return registry.WindowMetric(sums, lambda basket, union: basket("block") / F.nullif(union("block"), F.lit(0.0)))


def _block_sql(clock, table):
    """The SQL of block_share over a clock (session_date, at_sec, open_sec, close_sec)."""
    return [
        f"""own_one AS (
  SELECT session_date, at_sec, symbol, sum(block_dollars) AS block FROM bs JOIN {clock} USING (session_date)
  WHERE second >= open_sec AND second < least(at_sec + 1, close_sec) GROUP BY ALL)""",
        """own_uni AS (SELECT session_date, at_sec, sum(block) AS whole FROM own_one
  WHERE symbol IN (SELECT symbol FROM mem) GROUP BY ALL)""",
        "own_sum AS (SELECT session_date, at_sec, basket, sum(block) AS part FROM own_one JOIN mem USING (symbol) GROUP BY ALL)",
        f"""shared AS (
  SELECT {table}.*, coalesce(part, 0) / nullif(whole, 0) AS block_share
  FROM {table} LEFT JOIN own_sum USING (session_date, at_sec, basket) LEFT JOIN own_uni USING (session_date, at_sec))""",
    ]


OWN = KEY + "f:flow_share p:block_share"


@register("window_metric", select([*FULL_CTES, *_block_sql("clk", "full_table")], OWN, "shared"))
def window_metric(spark, sf):
    """The dev table with a metric of the user's own that the shared pass computes."""
    registry.unregister_metric("block_share")
    registry.register_metric("block_share", _block_share())
    return shape(table.basket_table(inputs(spark, sf), extra=["block_share"]), OWN)


@register("window_metric_series", select([*SERIES_CTES, *_block_sql("clk", "full_table")], OWN, "shared"))
def window_metric_series(spark, sf):
    """The same metric at every minute 04:00-16:15 of every session, from running sums."""
    registry.unregister_metric("block_share")
    registry.register_metric("block_share", _block_share())
    inp = stored.inputs(spark, sf, stored.session_dates(spark, sf, "line"))
    return shape(table.basket_series(inp, 60, "dev", 240, 975, ["block_share"]), OWN)


# Display forms: values are shown to six decimals at most, halves round up.
def _figures(scale):
    x = f"CAST(v / {scale} AS DECIMAL(30, 6))"
    return (
        f"CASE WHEN v / {scale} < 10 THEN CAST(CAST(round({x}, 2) AS DECIMAL(30, 2)) AS VARCHAR)"
        f" WHEN v / {scale} < 100 THEN CAST(CAST(round({x}, 1) AS DECIMAL(30, 1)) AS VARCHAR)"
        f" ELSE CAST(CAST(round({x}, 0) AS DECIMAL(30, 0)) AS VARCHAR) END"
    )


def _fixed(scale, digits):
    x = f"CAST(v / {scale} AS DECIMAL(30, 6))"
    return f"CAST(CAST(round({x}, {digits}) AS DECIMAL(30, {digits})) AS VARCHAR)"


P19 = "d:session_date s:symbol s:dollars_text s:usd_text"
P19_SQL = select(
    [*Q.buckets("line"), "t AS (SELECT session_date, symbol, round(sum(dollars), 2) AS v FROM b GROUP BY ALL"
     " UNION ALL SELECT session_date, symbol || '/s', round(sum(shares), 2) FROM b GROUP BY ALL"
     " UNION ALL SELECT session_date, symbol || '/t', CAST(sum(trades) AS DOUBLE) FROM b GROUP BY ALL)"],
    P19,
    "t",
    dollars_text=f"CASE WHEN v >= 1e9 THEN {_figures(1e9)} || 'B' WHEN v >= 1e6 THEN {_figures(1e6)} || 'M'"
    f" WHEN v >= 1e3 THEN {_figures(1e3)} || 'k' ELSE {_fixed(1, 0)} END",
    usd_text=f"'$' || CASE WHEN v >= 1e9 THEN {_fixed(1e9, 1)} || 'B' WHEN v >= 1e6 THEN {_fixed(1e6, 1)} || 'M'"
    f" WHEN v >= 1e3 THEN {_fixed(1e3, 0)} || 'K' ELSE {_fixed(1, 0)} END",
)


@register("display_amounts", P19_SQL)
def display_amounts(spark, sf):
    per = stored.buckets(spark, sf, "line").groupBy("session_date", "symbol").agg(
        F.round(F.sum("dollars"), 2).alias("a"),
        F.round(F.sum("shares"), 2).alias("b"),
        F.sum("trades").cast("double").alias("c"),
    )
    parts = F.explode(
        F.array(
            F.struct(F.col("symbol").alias("s"), F.col("a").alias("v")),
            F.struct(F.concat("symbol", F.lit("/s")).alias("s"), F.col("b").alias("v")),
            F.struct(F.concat("symbol", F.lit("/t")).alias("s"), F.col("c").alias("v")),
        )
    ).alias("x")
    df = per.select("session_date", parts).select(
        "session_date",
        F.col("x.s").alias("symbol"),
        display.fmt_dollars("x.v").alias("dollars_text"),
        display.fmt_usd("x.v").alias("usd_text"),
    )
    return shape(df, P19)


