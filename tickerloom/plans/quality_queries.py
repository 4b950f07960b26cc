"""Queries on data quality, load and agreement of two sources."""

import re

from pyspark.sql import functions as F

from tickerloom.operators import baselines as BL
from tickerloom.operators import buckets as B
from tickerloom.operators import metrics as M
from tickerloom.operators import quality as QL
from tickerloom.plans import sqltext as Q
from tickerloom.plans import stored, tapes
from tickerloom.plans.base import register, select, shape
from tickerloom.sources import config

EVENT, LINE = Q.TAPES["event"], Q.TAPES["line"]

A9 = "i:messages i:trades i:quotes i:first_ns i:last_ns"


@register("tape_stats", select([LINE], A9, "tape", messages="count(*)",
    trades="count(*) FILTER (kind = 'trade')", quotes="count(*) FILTER (kind = 'quote')",
    first_ns="min(sip_ns)", last_ns="max(sip_ns)"))
def tape_stats(spark, sf):
    return shape(QL.tape_stats(tapes.line_tape(spark, sf)), A9)


A19 = "d:session_date i:compared i:thin i:within f:p10 f:p25 f:p50 f:p75 f:p90"
A19_SQL = select(
    [*Q.profiles("line", 30),
     """v AS (SELECT days.session_date, tp.symbol, coalesce(s.shares, 0) / nullif(median_shares, 0) AS r
        FROM tp CROSS JOIN days LEFT JOIN sparse s ON s.symbol = tp.symbol
          AND s.session_date = days.session_date AND s.minute_of_day = 600
        WHERE tp.minute_of_day = 600)""",
     "o AS (SELECT session_date, count(r) AS n, count(*) - count(r) AS thin,"
     " count(*) FILTER (r BETWEEN 0.5 AND 2.0) AS within,"
     " list(r ORDER BY r) FILTER (r IS NOT NULL) AS l FROM v GROUP BY session_date)"],
    A19,
    "o",
    compared="n",
    **{f"p{int(p * 100)}": f"l[CAST(floor({p} * (n - 1)) AS BIGINT) + 1]" for p in QL.RVOL_PROBS},
)


@register("rvol_check", A19_SQL)
def rvol_check(spark, sf):
    """10:00-10:30 of every session against its half-hour baseline."""
    df = QL.rvol_check(
        stored.buckets(spark, sf, "line"),
        stored.ticker_profile(spark, sf, "line", 30),
        minute=600,
        bar_minutes=30,
    )
    return shape(df, A19)


A20 = "d:session_date i:second i:trades i:quotes i:total"
LOAD = [
    LINE,
    "days AS (SELECT DISTINCT session_date FROM tape)",
    f"""load AS (
  SELECT session_date, s.second, coalesce(t.trades, 0) AS trades, coalesce(t.quotes, 0) AS quotes,
         coalesce(t.trades, 0) + coalesce(t.quotes, 0) AS total
  FROM (SELECT session_date, {Q.wall("session_date", 240)} + CAST(range AS BIGINT) AS second
        FROM days CROSS JOIN range(0, 57600)) s
  LEFT JOIN (SELECT sip_ns // 1000000000 AS second, count(*) FILTER (kind = 'trade') AS trades,
                    count(*) FILTER (kind = 'quote') AS quotes FROM tape GROUP BY ALL) t
  USING (second))""",
]


def line_load(spark, sf):
    dates = stored.session_dates(spark, sf, "line")
    return QL.second_load(tapes.line_tape(spark, sf), dates)


@register("second_load", select(LOAD, A20, "load"))
def second_load(spark, sf):
    return shape(line_load(spark, sf), A20)


@register("open_histogram", select(LOAD, A20,
    f"load WHERE second >= {Q.wall('session_date', 570)} - 5 AND second < {Q.wall('session_date', 570)} + 300"))
def open_histogram(spark, sf):
    return shape(QL.open_histogram(line_load(spark, sf)), A20)


HOUR = "d:session_date f:rate"


@register("sustained_rate", select(LOAD, HOUR,
    f"load WHERE second >= {Q.wall('session_date', 570)} AND second < {Q.wall('session_date', 630)}",
    "GROUP BY session_date", rate="sum(total) / 3600"))
def sustained_rate(spark, sf):
    return shape(QL.sustained_rate(line_load(spark, sf)), HOUR)


SYM = "s:symbol i:trades i:quotes i:trades_open_hour i:quotes_open_hour f:qt_ratio f:qt_ratio_open_hour"
SYM_SQL = select(
    [LINE, Q.SYMBOL_TABLE, f"t AS (SELECT *, {Q.minute('sip_ns // 1000000000')} AS m FROM tape)",
     """c AS (SELECT symbol, count(*) FILTER (kind = 'trade') AS trades,
              count(*) FILTER (kind = 'quote') AS quotes,
              count(*) FILTER (kind = 'trade' AND m BETWEEN 570 AND 629) AS trades_open_hour,
              count(*) FILTER (kind = 'quote' AND m BETWEEN 570 AND 629) AS quotes_open_hour
       FROM t GROUP BY symbol)"""],
    SYM,
    "sym LEFT JOIN c USING (symbol)",
    qt_ratio="quotes / nullif(trades, 0)",
    qt_ratio_open_hour="quotes_open_hour / nullif(trades_open_hour, 0)",
)


@register("symbol_load", SYM_SQL)
def symbol_load(spark, sf):
    return shape(QL.symbol_load(tapes.line_tape(spark, sf), tapes.symbols(spark)), SYM)


W5 = "i:width d:session_date f:rate i:at_sec"


def _peak_sql(k):
    return f"""SELECT {k} AS width, session_date, max(n) / {k} AS rate,
       min(second) FILTER (n = top) AS at_sec
FROM (SELECT *, max(n) OVER (PARTITION BY session_date) AS top FROM (
        SELECT session_date, second,
               sum(total) OVER (PARTITION BY session_date ORDER BY second
                                ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS n,
               row_number() OVER (PARTITION BY session_date ORDER BY second DESC) AS left_over
        FROM load) WHERE left_over >= {k})
GROUP BY session_date"""


@register("rolling_peak", select(
    [*LOAD, "peaks AS (" + " UNION ALL ".join(_peak_sql(k) for k in (1, 10, 60)) + ")"], W5, "peaks"))
def rolling_peak(spark, sf):
    return shape(QL.rolling_peak(line_load(spark, sf), "total", (1, 10, 60)), W5)


A21 = "s:symbol i:p50 i:p95 i:p99 i:max i:samples"
A21_SQL = select(
    [EVENT, "o AS (SELECT symbol, list(recv_ns // 1000000 - sip_ns // 1000000 ORDER BY"
     " recv_ns // 1000000 - sip_ns // 1000000) AS l, count(*) AS samples FROM tape GROUP BY symbol)"],
    A21,
    "o",
    **{
        name: f"l[CAST(floor({p} * (samples - 1)) AS BIGINT) + 1]"
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("max", 1.0))
    },
)


@register("feed_latency", A21_SQL)
def feed_latency(spark, sf):
    return shape(QL.feed_latency(tapes.event_tape(spark, sf), ["symbol"]), A21)


W6 = "d:session_date i:clock_ns"
# Clocks at zero, jumps of 20 hours, jumps of 40 hours (believable after one of 20), and corrupt
# messages four days ahead.
W6_JUMPS = ((89, 3, 0), (97, 5, 345_600), (101, 7, 72_000), (103, 9, 144_000))
W6_NS = "CASE WHEN arrival % 89 = 3 THEN 0 " + " ".join(
    f"WHEN arrival % {m} = {k} THEN sip_ns + {sec}000000000" for m, k, sec in W6_JUMPS[1:]
) + " ELSE sip_ns END"
W6_SQL = "WITH RECURSIVE " + select(
    [EVENT, f"""bad AS (SELECT session_date, {W6_NS} AS sip_ns,
         row_number() OVER (PARTITION BY session_date ORDER BY arrival) AS n FROM tape),
       clock AS (
         SELECT session_date, n, greatest(sip_ns, 0) AS clock_ns FROM bad WHERE n = 1
         UNION ALL
         SELECT c.session_date, b.n,
           CASE WHEN b.sip_ns <= c.clock_ns THEN c.clock_ns
                WHEN c.clock_ns <> 0 AND b.sip_ns - c.clock_ns > 86400000000000 THEN c.clock_ns
                ELSE b.sip_ns END
         FROM clock c JOIN bad b ON b.session_date = c.session_date AND b.n = c.n + 1)"""],
    W6,
    "clock",
    "GROUP BY session_date",
    clock_ns="max(clock_ns)",
).removeprefix("WITH ")


@register("session_clock", W6_SQL)
def session_clock(spark, sf):
    tape = tapes.event_tape(spark, sf)
    return shape(QL.session_clock(tape.withColumn("sip_ns", F.expr(W6_NS))), W6)


J9_FROM, J9_TO = 1_704_500_000_000_000_000, 1_706_200_000_000_000_000
J9 = "s:symbol s:kind i:capture i:flat i:delta i:exact"
J9_CTES = [
    EVENT,
    Q.SYMBOL_TABLE,
    f"inside AS (SELECT * FROM tape WHERE sip_ns >= {J9_FROM} AND sip_ns < {J9_TO})",
    """rep AS (
  SELECT sym.symbol, k.kind, coalesce(c.n, 0) AS capture, coalesce(f.n, 0) AS flat
  FROM sym CROSS JOIN (VALUES ('trade'), ('quote')) k(kind)
  LEFT JOIN (SELECT symbol, kind, count(*) AS n FROM inside
             WHERE NOT (symbol = 'S4' AND price > 60) GROUP BY ALL) c
    ON c.symbol = sym.symbol AND c.kind = k.kind
  LEFT JOIN (SELECT symbol, kind, count(*) AS n FROM inside GROUP BY ALL) f
    ON f.symbol = sym.symbol AND f.kind = k.kind)""",
]


def event_reconcile(spark, sf):
    """The events tape against a copy that lost some S4 messages."""
    flat = tapes.event_tape(spark, sf)
    capture = flat.filter("NOT (symbol = 'S4' AND price > 60)")
    return QL.reconcile(capture, flat, tapes.symbols(spark), J9_FROM, J9_TO)


@register("reconcile", select(J9_CTES, J9, "rep", delta="flat - capture",
    exact="CASE WHEN flat = capture THEN 1 ELSE 0 END"))
def reconcile(spark, sf):
    return shape(event_reconcile(spark, sf), J9)


J9S = "s:kind i:capture i:flat i:delta f:delta_pct i:exact i:symbols"


@register("reconcile_summary", select(J9_CTES, J9S, "rep", "GROUP BY kind", capture="sum(capture)",
    flat="sum(flat)", delta="sum(flat - capture)",
    delta_pct="coalesce(100 * sum(flat - capture) / nullif(sum(flat), 0), 0)",
    exact="count(*) FILTER (flat = capture)", symbols="count(*)"))
def reconcile_summary(spark, sf):
    return shape(QL.reconcile_summary(event_reconcile(spark, sf)), J9S)


J10_TIMES = ("09:45:00", "12:31:00", "15:30:00")
J10 = "d:session_date i:at_sec s:basket f:rel_delta i:base_pass i:rvol_pass i:last_pass"


def _pair(spark, sf):
    """Metrics of the full tape and of a tape that lost its one-share messages."""
    asof = M.asof_clock(stored.session_dates(spark, sf, "line"), *J10_TIMES)
    inp = stored.inputs(spark, sf, asof)
    thinner = B.bucketize(tapes.line_tape(spark, sf).filter("size <> 1"))
    frame = lambda i: M.basket_frame(i, shares=False, baseline=True)
    return frame(inp.with_(buckets=thinner)), frame(inp)


LOST = "lost_tape AS (SELECT * FROM tape WHERE size <> 1)"


def _renamed(ctes, suffix, tape):
    """The metric CTEs once more, under other names and over another tape."""
    names = ["cls", "b", "bs", "w", "g", "un", "k", "m1", "m2", "base"]
    out = []
    for c in ctes:
        for n in names:
            c = re.sub(rf"(?m)^{n} AS \(", f"{n}{suffix} AS (", c)
            c = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {n}{suffix}", c)
        c = re.sub(r"\bFROM tape\b", f"FROM {tape}", c)
        c = re.sub(r"\b(m1|k)\.", rf"\1{suffix}.", c)
        out.append(c)
    return out


CHAIN = [Q.WINDOWS, Q.GRID, Q.UNION, Q.BASKET, Q.SHARES, Q.BASELINES]
J10_CTES = [
    *Q.profiles("line"),
    *Q.asof(J10_TIMES),
    *CHAIN,
    LOST,
    *_renamed([*Q.buckets("line")[1:], *CHAIN], "_v", "lost_tape"),
    """cmp AS (
  SELECT session_date, at_sec, basket,
         CASE WHEN c.prev_d <> 0 THEN (v.prev_d - c.prev_d) / c.prev_d WHEN v.prev_d = 0 THEN 0 END
           AS rel_delta,
         v.baseline_20d_dollar_vol IS NOT DISTINCT FROM c.baseline_20d_dollar_vol AS base_ok,
         CASE WHEN v.relative_vol IS NULL OR c.relative_vol IS NULL
              THEN v.relative_vol IS NULL AND c.relative_vol IS NULL
              ELSE abs(v.relative_vol - c.relative_vol) <= 0.01 + 1e-12 END AS rvol_ok
  FROM m2_v v FULL JOIN m2 c USING (session_date, at_sec, basket))""",
]


@register("compare_metrics", select(J10_CTES, J10, "cmp", base_pass="CAST(base_ok AS INTEGER)",
    rvol_pass="CAST(rvol_ok AS INTEGER)",
    last_pass="CASE WHEN abs(rel_delta) <= 0.005 THEN 1 ELSE 0 END"))
def compare_metrics(spark, sf):
    return shape(QL.compare_metrics(*_pair(spark, sf)), J10)


J10C = "d:session_date i:at_sec s:basket i:cum_share_pass i:cum_share_typ_pass i:cum_share_z_pass f:z_delta"
_SAME = "CASE WHEN round(v.{0}, {1}) IS NOT DISTINCT FROM round(c.{0}, {1}) THEN 1 ELSE 0 END"


@register("compare_cumulative", select(
    [*J10_CTES, "both_sides AS (SELECT session_date, at_sec, basket, "
     + ", ".join(f"{_SAME.format(n, k)} AS {n}_pass" for n, k in (("cum_share", 4), ("cum_share_typ", 4), ("cum_share_z", 1)))
     + ", v.cum_share_z - c.cum_share_z AS z_delta"
     " FROM m2_v v FULL JOIN m2 c USING (session_date, at_sec, basket))"], J10C, "both_sides"))  # fmt: skip
def compare_cumulative(spark, sf):
    """Since-open shares of the full tape against those of the tape that lost messages."""
    return shape(QL.compare_cumulative(*_pair(spark, sf)), J10C)


J10S = "i:checks i:base_pass i:rvol_pass i:last_pass f:mean_rel_delta f:worst"


@register("compare_summary", select(J10_CTES, J10S, "cmp", checks="count(*)",
    base_pass="count(*) FILTER (base_ok)", rvol_pass="count(*) FILTER (rvol_ok)",
    last_pass="count(*) FILTER (abs(rel_delta) <= 0.005)", mean_rel_delta="avg(rel_delta)",
    worst="CASE WHEN max(rel_delta) >= -min(rel_delta) THEN max(rel_delta) ELSE min(rel_delta) END"))
def compare_summary(spark, sf):
    df = QL.compare_summary(QL.compare_metrics(*_pair(spark, sf)))
    return shape(df.withColumnRenamed("worst_rel_delta", "worst"), J10S)


J11 = "s:symbol s:problem"
J11_SQL = """WITH u AS (SELECT DISTINCT 'C' || c_custkey AS symbol, c_custkey FROM customer),
r AS (SELECT 'C' || o_custkey AS symbol,
             CASE WHEN o_custkey % 11 = 0 THEN 'otc' ELSE 'stocks' END AS market,
             max(o_orderdate) >= TIMESTAMP '1998-01-01' AS active
      FROM orders GROUP BY o_custkey)
SELECT symbol, 'missing' AS problem FROM u WHERE symbol NOT IN (SELECT symbol FROM r)
UNION ALL SELECT symbol, 'market' FROM u JOIN r USING (symbol) WHERE market <> 'stocks'
UNION ALL SELECT symbol, 'inactive' FROM u JOIN r USING (symbol) WHERE NOT active"""


@register("unlisted_symbols", J11_SQL)
def unlisted_symbols(spark, sf):
    """Customers as the universe, their orders as the reference table."""
    universe = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol")
    )
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    key = F.col("o_custkey")
    listed = orders.groupBy(F.concat(F.lit("C"), key.cast("string")).alias("symbol"), key).agg(
        (F.max("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("active")
    )
    market = F.when(F.col("o_custkey") % 11 == 0, "otc").otherwise("stocks")
    return shape(config.unlisted_symbols(universe, listed.withColumn("market", market)), J11)


U3 = "s:symbol"


@register("symbols_without_baseline", select([EVENT, Q.MEMBERS], U3,
    "(SELECT DISTINCT symbol FROM tape WHERE symbol NOT IN (SELECT symbol FROM mem))"))
def symbols_without_baseline(spark, sf):
    """Symbols on the tape that belong to no basket."""
    seen = tapes.event_tape(spark, sf).select("symbol").distinct()
    return shape(seen.join(config.member_union(tapes.members(spark)), "symbol", "left_anti"), U3)


J2 = "s:basket i:days m:dollars"


@register("basket_members_join", select(Q.bars("line"), J2, "bar JOIN mem USING (symbol)",
    "GROUP BY basket", days="count(DISTINCT session_date)", dollars="sum(dollars)"))
def basket_members_join(spark, sf):
    """Counted dollars per basket; a symbol of two baskets counts in both."""
    bars = BL.session_bars(stored.buckets(spark, sf, "line"))
    per = bars.join(tapes.members(spark), "symbol").groupBy("basket", "session_date").agg(
        F.sum("dollars").alias("dollars")
    )
    return shape(per.groupBy("basket").agg(F.count("*").alias("days"), F.sum("dollars").alias("dollars")), J2)
