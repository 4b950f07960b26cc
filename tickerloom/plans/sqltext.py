"""Common table expressions of the checking SQL."""

from tickerloom.plans.tapes import (
    BASKETS,
    EVENT_TAPE_SQL,
    LINE_TAPE_SQL,
    SYMBOLS,
    WIDE_SYMBOLS,
)

NY = "'America/New_York'"
TAPES = {
    "event": EVENT_TAPE_SQL,
    "line": LINE_TAPE_SQL,
    "wide": EVENT_TAPE_SQL.replace("(user_id % 6)", f"(user_id % {WIDE_SYMBOLS})"),
}


COUNTED = ("continuous", "block", "non_price_forming")
AUCTIONS = ("continuous", "block", "non_price_forming", "cross_open", "cross_reopen", "cross_close")
EXTENDED = ("non_flow",)

# Fixed values, written out here and not taken from the code that they check.
CLASS_LISTS = """
non_flow            7 12 13 15 16 20 29 38
duplicate           2
non_price_forming   5 10 21 22 32 33 52 53
cross_reopen        18 28
cross_open          17 25 55
cross_close         8 19
block               9 24
"""
CONTINUOUS = "1 3 4 6 11 14 23 27 30 31 34 35 36 37"
NEUTRAL = "41 57 58 59 60 62 63 64 65 66 67 68 69 70 71"
CLASSES = ("unknown", *(line.split()[0] for line in CLASS_LISTS.strip().splitlines()), "continuous")


def _ids(text):
    return "[" + ", ".join(text.split()) + "]"


IDS = {line.split()[0]: line.split(maxsplit=1)[1] for line in CLASS_LISTS.strip().splitlines()}
KNOWN_IDS = _ids(" ".join([*IDS.values(), CONTINUOUS, NEUTRAL]))


def class_case(conditions="conditions"):
    """Class rank of a list of condition ids."""
    whens = [
        f"WHEN len(list_filter({conditions}, lambda x: NOT list_contains({KNOWN_IDS}, x))) > 0 THEN 0"
    ]
    for rank, ids in enumerate(IDS.values(), 1):
        whens.append(f"WHEN list_has_any({conditions}, {_ids(ids)}) THEN {rank}")
    return "CASE " + " ".join(whens) + " ELSE 8 END"


CLASS_NAME = "[" + ", ".join(f"'{c.upper()}'" for c in CLASSES) + "][rank + 1]"


def minute(sec):
    """New York minute of the day of an epoch second."""
    local = f"timezone({NY}, to_timestamp({sec}))"
    return f"(hour({local}) * 60 + minute({local}))"


def wall(date, minute_of_day):
    """Epoch second of a New York date and minute."""
    return (
        f"CAST(epoch(timezone({NY}, CAST({date} AS TIMESTAMP) + to_minutes({minute_of_day})))"
        " AS BIGINT)"
    )


def clock(date, hms):
    """Epoch second of a New York date and wall time."""
    return f"CAST(epoch(timezone({NY}, CAST({date} AS TIMESTAMP) + INTERVAL '{hms}')) AS BIGINT)"


def ranked(tape):
    """tape with the class rank of every trade."""
    return [
        TAPES[tape],
        f"cls AS (SELECT *, CASE WHEN kind = 'trade' THEN {class_case()} END AS rank FROM tape)",
    ]


def _sum(classes, part):
    return " + ".join(f"{c}_{part}" for c in classes)


def buckets(tape):
    """b: bucket_1s; bs: with slices and the minute of the day."""
    per_class = []
    for rank, name in enumerate(CLASSES):
        per_class.append(f"count(*) FILTER (rank = {rank}) AS {name}_trades")
        per_class.append(f"coalesce(sum(size) FILTER (rank = {rank}), 0) AS {name}_shares")
        per_class.append(f"coalesce(sum(price * size) FILTER (rank = {rank}), 0) AS {name}_dollars")
    trade = "FILTER (kind = 'trade')"
    b = f"""b AS (
  SELECT CAST(timezone({NY}, to_timestamp(sip_ns // 1000000000)) AS DATE) AS session_date,
         symbol, sip_ns // 1000000000 AS second,
         count(*) {trade} AS trades,
         coalesce(sum(size) {trade}, 0) AS shares,
         coalesce(sum(price * size) {trade}, 0) AS dollars,
         coalesce(arg_max(price, CAST(sip_ns AS HUGEINT) * 10000000000 + arrival) {trade}, 0)
           AS last_price,
         coalesce(max(sip_ns) {trade}, 0) AS last_sip_ns,
         count(*) FILTER (kind = 'quote') AS quotes,
         {", ".join(per_class)}
  FROM cls GROUP BY ALL)"""
    bs = f"""bs AS (
  SELECT *, {_sum(COUNTED, "shares")} AS c_shares, {_sum(COUNTED, "dollars")} AS c_dollars,
         {_sum(AUCTIONS, "shares")} AS a_shares, {_sum(AUCTIONS, "dollars")} AS a_dollars,
         {_sum(EXTENDED, "shares")} AS x_shares, {_sum(EXTENDED, "dollars")} AS x_dollars,
         {minute("second")} AS minute_of_day
  FROM b)"""
    return [*ranked(tape), b, bs]


MEMBERS = (
    "mem(basket, symbol) AS (VALUES "
    + ", ".join(f"('{b}', '{s}')" for b, names in BASKETS.items() for s in names)
    + ")"
)
SYMBOL_TABLE = "sym(symbol) AS (VALUES " + ", ".join(f"('{s}')" for s in SYMBOLS) + ")"


def bars(tape, bar=1):
    """days, mins and bar: dense (session, symbol, bar) sums, zeros included."""
    m = f"(570 + (minute_of_day - 570) // {bar} * {bar})"
    return [
        *buckets(tape),
        SYMBOL_TABLE,
        MEMBERS,
        "days AS (SELECT DISTINCT session_date FROM bs WHERE minute_of_day BETWEEN 570 AND 959)",
        f"mins AS (SELECT CAST(range AS INTEGER) AS minute_of_day FROM range(570, 960, {bar}))",
        f"""sparse AS (
  SELECT session_date, symbol, {m} AS minute_of_day, sum(c_shares) AS shares,
         sum(c_dollars) AS dollars, sum(a_dollars) AS auction_dollars, sum(trades) AS prints
  FROM bs WHERE minute_of_day BETWEEN 570 AND 959 GROUP BY ALL)""",
        """bar AS (
  SELECT session_date, symbol, minute_of_day, coalesce(shares, 0) AS shares,
         coalesce(dollars, 0) AS dollars, coalesce(auction_dollars, 0) AS auction_dollars,
         coalesce(prints, 0) AS prints
  FROM sym CROSS JOIN days CROSS JOIN mins
  LEFT JOIN sparse USING (session_date, symbol, minute_of_day))""",
    ]


def profiles(tape, bar=1):
    """tp: ticker baselines; skipped: uncovered sessions; samples and bp: basket baselines."""
    return [
        *bars(tape, bar),
        """tp AS (
  SELECT symbol, minute_of_day, count(*) AS days,
         median(shares) AS median_shares, mad(shares) * 1.4826 AS sigma_shares,
         median(dollars) AS median_dollars, mad(dollars) * 1.4826 AS sigma_dollars
  FROM bar GROUP BY ALL)""",
        """gone AS (
  SELECT session_date, symbol FROM bar
  WHERE symbol IN (SELECT symbol FROM mem)
  GROUP BY ALL HAVING sum(prints) = 0)""",
        """covered AS (
  SELECT * FROM bar WHERE session_date NOT IN (SELECT session_date FROM gone)
    AND symbol IN (SELECT symbol FROM mem))""",
        """uni AS (
  SELECT session_date, minute_of_day, sum(dollars) AS ud, sum(auction_dollars) AS ua
  FROM covered GROUP BY ALL)""",
        """own AS (
  SELECT session_date, minute_of_day, basket, sum(dollars) AS d, sum(auction_dollars) AS a
  FROM covered JOIN mem USING (symbol) GROUP BY ALL)""",
        """samples AS (
  SELECT session_date, minute_of_day, basket, d / nullif(ud, 0) AS share,
         sum(a) OVER w / nullif(sum(ua) OVER w, 0) AS cum_share
  FROM own JOIN uni USING (session_date, minute_of_day)
  WINDOW w AS (PARTITION BY session_date, basket ORDER BY minute_of_day
               ROWS UNBOUNDED PRECEDING))""",
        """bp AS (
  SELECT basket, minute_of_day, count(share) AS days,
         coalesce(median(share), 0) AS median_share,
         coalesce(mad(share), 0) * 1.4826 AS sigma_share,
         count(cum_share) AS cum_days,
         coalesce(median(cum_share), 0) AS median_cum_share,
         coalesce(mad(cum_share), 0) * 1.4826 AS sigma_cum_share
  FROM (SELECT DISTINCT basket FROM mem) CROSS JOIN mins
  LEFT JOIN samples USING (basket, minute_of_day) GROUP BY ALL)""",
        """fl AS (
  SELECT minute_of_day, s AS sigma_floor_shares, d AS sigma_floor_dollars,
         f AS sigma_floor_flowshare, c AS sigma_floor_cumshare
  FROM (SELECT minute_of_day, 0.25 * median(sigma_shares) AS s, 0.25 * median(sigma_dollars) AS d
        FROM tp GROUP BY ALL)
  JOIN (SELECT minute_of_day,
               coalesce(0.25 * median(sigma_share) FILTER (days >= 1), 0) AS f,
               coalesce(0.25 * median(sigma_cum_share) FILTER (cum_days >= 1), 0) AS c
        FROM bp GROUP BY ALL) USING (minute_of_day))""",
    ]


def asof(times):
    """times and clk: as-of seconds of every session, and their window edges."""
    union = " UNION ALL ".join(
        f"SELECT session_date, {clock('session_date', t)} AS at_sec FROM days_all" for t in times
    )
    return [
        "days_all AS (SELECT DISTINCT session_date FROM bs)",
        f"times AS ({union})",
        *CLK,
    ]


CLK = [
    f"""clk0 AS (
  SELECT *, {wall("session_date", 570)} AS open_sec, {wall("session_date", 960)} AS close_sec,
         {wall("session_date", 240)} AS pre_sec, at_sec - at_sec % 60 AS bar_sec
  FROM times)""",
    """clk1 AS (
  SELECT *, bar_sec - 60 AS prev_sec, least(at_sec + 1, close_sec) AS live_end,
         greatest(least(bar_sec, close_sec), open_sec) AS cum_end,
         least(at_sec + 1, open_sec) AS pre_end,
         (least(bar_sec, close_sec) - open_sec) // 60 AS bars_done
  FROM clk0)""",
    f"""clk AS (
  SELECT *, CASE WHEN cum_end > open_sec THEN {minute("cum_end - 60")} END AS key_minute,
         prev_sec >= open_sec AND prev_sec < close_sec AS prev_regular
  FROM clk1)""",
]


def _dollars(what, lo, hi, name):
    return f"sum({what}) FILTER (second >= {lo} AND second < {hi}) AS {name}"


WINDOWS = (
    """w AS (
  SELECT session_date, at_sec, symbol, """
    + ",\n         ".join(
        [
            _dollars("c_dollars", "prev_sec", "bar_sec", "prev_d"),
            _dollars("c_dollars", "bar_sec", "at_sec + 1", "cur_d"),
            _dollars("a_dollars", "open_sec", "live_end", "live_d"),
            _dollars("a_dollars", "open_sec", "cum_end", "cum_d"),
            _dollars("x_dollars", "pre_sec", "pre_end", "pre_d"),
            *[
                _dollars("c_dollars", f"cum_end - {60 * j}", f"cum_end - {60 * j - 60}", f"bar{j}_d")
                for j in (1, 2, 3)
            ],
            "arg_min(last_price, second) FILTER (trades > 0 AND second >= open_sec"
            " AND second < cum_end) AS anchor",
            *[
                f"arg_max(last_price, second) FILTER (trades > 0 AND second >= open_sec"
                f" AND second < cum_end - {60 * j - 60}) AS last{j}"
                for j in (1, 2, 3)
            ],
        ]
    )
    + """
  FROM bs JOIN clk USING (session_date) GROUP BY ALL)"""
)

GRID = """g AS (
  SELECT clk.*, basket, symbol,
         coalesce(prev_d, 0) AS prev_d, coalesce(cur_d, 0) AS cur_d, coalesce(live_d, 0) AS live_d,
         coalesce(cum_d, 0) AS cum_d, coalesce(pre_d, 0) AS pre_d,
         coalesce(bar1_d, 0) AS bar1_d, coalesce(bar2_d, 0) AS bar2_d, coalesce(bar3_d, 0) AS bar3_d,
         CASE WHEN anchor > 0 AND last1 > 0 THEN last1 / anchor - 1 END AS ret1,
         CASE WHEN anchor > 0 AND last2 > 0 THEN last2 / anchor - 1 END AS ret2,
         CASE WHEN anchor > 0 AND last3 > 0 THEN last3 / anchor - 1 END AS ret3
  FROM clk CROSS JOIN mem LEFT JOIN w USING (session_date, at_sec, symbol))"""

UNION = """un AS (
  SELECT session_date, at_sec, sum(prev_d) AS u_prev, sum(cur_d) AS u_cur, sum(live_d) AS u_live,
         sum(cum_d) AS u_cum, sum(pre_d) AS u_pre
  FROM (SELECT DISTINCT ON (session_date, at_sec, symbol) * FROM g) GROUP BY ALL)"""

BASKET = """k AS (
  SELECT session_date, at_sec, basket, any_value(open_sec) AS open_sec,
         any_value(bar_sec) AS bar_sec, any_value(live_end) AS live_end,
         any_value(cum_end) AS cum_end, any_value(pre_sec) AS pre_sec,
         any_value(pre_end) AS pre_end, any_value(bars_done) AS bars_done,
         any_value(key_minute) AS key_minute, any_value(prev_regular) AS prev_regular,
         count(*) AS member_count, sum(prev_d) AS prev_d, sum(cur_d) AS cur_d,
         sum(live_d) AS live_d, sum(cum_d) AS cum_d, sum(pre_d) AS pre_d,
         max(prev_d) AS top_prev, max(live_d) AS top_live, max(pre_d) AS top_pre,
         first(symbol ORDER BY prev_d DESC, symbol) AS s_prev,
         first(symbol ORDER BY live_d DESC, symbol) AS s_live,
         first(symbol ORDER BY pre_d DESC, symbol) AS s_pre
  FROM g GROUP BY ALL)"""

SHARES = """m1 AS (
  SELECT k.*, prev_d AS last_minute_dollar_vol, cur_d AS current_minute_dollar_vol,
         cur_d / nullif(u_cur, 0) AS flow_share,
         prev_d / nullif(u_prev, 0) AS prev_share,
         CASE WHEN prev_d > 0 THEN s_prev END AS concentration_symbol,
         top_prev / nullif(prev_d, 0) AS concentration,
         CASE WHEN live_end > open_sec THEN live_d / nullif(u_live, 0) END AS cum_share,
         CASE WHEN cum_end > open_sec THEN cum_d / nullif(u_cum, 0) END AS cum_share_completed,
         CASE WHEN live_end > open_sec AND live_d > 0 THEN s_live END AS concentration_day_symbol,
         CASE WHEN live_end > open_sec THEN top_live / nullif(live_d, 0) END AS concentration_day,
         CASE WHEN pre_end > pre_sec THEN pre_d END AS pre_vol,
         CASE WHEN pre_end > pre_sec THEN pre_d / nullif(u_pre, 0) END AS pre_share,
         CASE WHEN pre_end > pre_sec AND pre_d > 0 THEN s_pre END AS pre_conc_symbol,
         CASE WHEN pre_end > pre_sec THEN top_pre / nullif(pre_d, 0) END AS pre_conc
  FROM k JOIN un USING (session_date, at_sec))"""

BASELINES = """base AS (
  SELECT basket, minute_of_day AS key_minute, sum(median_dollars) AS base_d
  FROM mem JOIN tp USING (symbol) GROUP BY ALL),
m2 AS (
  SELECT m1.*, CASE WHEN prev_regular THEN base_d END AS baseline_20d_dollar_vol,
         CASE WHEN prev_regular THEN prev_d / nullif(base_d, 0) END AS relative_vol,
         CASE WHEN prev_regular AND days >= 10 THEN
           (prev_share - median_share)
             / nullif(greatest(sigma_share, sigma_floor_flowshare), 0) END AS flow_share_z,
         CASE WHEN cum_share_completed IS NOT NULL AND cum_days > 0
           THEN median_cum_share END AS cum_share_typ,
         CASE WHEN cum_days >= 10 THEN
           (cum_share_completed - median_cum_share)
             / nullif(greatest(sigma_cum_share, sigma_floor_cumshare), 0) END AS cum_share_z
  FROM m1 LEFT JOIN base USING (basket, key_minute)
  LEFT JOIN bp ON bp.basket = m1.basket AND bp.minute_of_day = m1.key_minute
  LEFT JOIN fl ON fl.minute_of_day = m1.key_minute)"""


def _state(j):
    d = f"(g.ret{j} - x.ret{j})"
    return f"CASE WHEN {d} > 0.0010 THEN 1 WHEN {d} < -0.0010 THEN -1 WHEN {d} IS NOT NULL THEN 0 END"


BREADTH = f"""x AS (
  SELECT session_date, at_sec,
         CASE WHEN anchor > 0 AND last1 > 0 THEN last1 / anchor - 1 END AS ret1,
         CASE WHEN anchor > 0 AND last2 > 0 THEN last2 / anchor - 1 END AS ret2,
         CASE WHEN anchor > 0 AND last3 > 0 THEN last3 / anchor - 1 END AS ret3
  FROM clk LEFT JOIN (SELECT * FROM w WHERE symbol = 'S0') USING (session_date, at_sec)),
st AS (
  SELECT g.*, x.ret1 AS bench1, {_state(1)} AS st1, {_state(2)} AS st2, {_state(3)} AS st3
  FROM g JOIN x USING (session_date, at_sec)),
side AS (
  SELECT *, bars_done >= 3 AND st1 + st2 + st3 IS NOT NULL AS measured,
         CASE WHEN bars_done >= 3 AND st1 = st2 AND st2 = st3 THEN st1 ELSE 0 END AS side
  FROM st),
br AS (
  SELECT session_date, at_sec, basket,
         CASE WHEN bool_or(measured) THEN count(*) FILTER (side = 1) END AS breadth_up,
         CASE WHEN bool_or(measured) THEN count(*) FILTER (side = 0) END AS breadth_inline,
         CASE WHEN bool_or(measured) THEN count(*) FILTER (side = -1) END AS breadth_down
  FROM side GROUP BY ALL)"""

VOLUME = """vs AS (
  SELECT side.*,
         CASE WHEN bars_done < 3 OR bars_done IS NULL THEN NULL
              WHEN coalesce(p1.median_dollars, 0) = 0 THEN 'unmeasured'
              WHEN bar1_d <= 1.5 * p1.median_dollars THEN 'normal'
              WHEN coalesce(p2.median_dollars, 0) = 0 THEN 'unmeasured'
              WHEN bar2_d <= 1.5 * p2.median_dollars THEN 'normal'
              WHEN coalesce(p3.median_dollars, 0) = 0 THEN 'unmeasured'
              WHEN bar3_d <= 1.5 * p3.median_dollars THEN 'normal'
              ELSE 'unusual' END AS vol_state
  FROM side
  LEFT JOIN tp p1 ON p1.symbol = side.symbol AND p1.minute_of_day = key_minute
  LEFT JOIN tp p2 ON p2.symbol = side.symbol AND p2.minute_of_day = key_minute - 1
  LEFT JOIN tp p3 ON p3.symbol = side.symbol AND p3.minute_of_day = key_minute - 2),
vb0 AS (
  SELECT session_date, at_sec, basket, bool_or(measured) AS priced,
         any_value(bars_done) >= 3 AND count(*) FILTER (vol_state <> 'unmeasured') > 0 AS known,
         count(*) FILTER (vol_state = 'unusual') AS nu,
         count(*) FILTER (vol_state = 'unmeasured') AS nm,
         count(*) FILTER (vol_state = 'unusual' AND side = 1) AS nv
  FROM vs GROUP BY ALL),
vb AS (
  SELECT session_date, at_sec, basket, CASE WHEN known THEN nu END AS vol_unusual,
         CASE WHEN known THEN nm END AS vol_unmeasured,
         CASE WHEN known AND priced THEN nv END AS up_on_vol
  FROM vb0)"""

FULL = """full_table AS (
  SELECT m2.*, breadth_up, breadth_inline, breadth_down, vol_unusual, vol_unmeasured, up_on_vol,
         CASE WHEN bar_sec < open_sec + 60 THEN pre_share ELSE cum_share_z END AS rank_key,
         CASE WHEN lo IS NULL OR at_sec < lo OR at_sec > hi THEN 1 ELSE 0 END AS outside
  FROM m2 JOIN br USING (session_date, at_sec, basket) JOIN vb USING (session_date, at_sec, basket)
  LEFT JOIN (SELECT session_date, min(second) AS lo, max(second) AS hi FROM b GROUP BY session_date)
    USING (session_date)),
ranked_table AS (
  SELECT *, row_number() OVER (PARTITION BY session_date, at_sec
                               ORDER BY rank_key DESC NULLS LAST, basket) AS row_rank
  FROM full_table)"""


def metric_ctes(tape, times):
    """Everything up to full_table for as-of wall times on every session."""
    return [*profiles(tape), *asof(times), *METRIC_TAIL]


METRIC_TAIL = [WINDOWS, GRID, UNION, BASKET, SHARES, BASELINES, BREADTH, VOLUME, FULL]


def share_ctes(tape, times):
    """Up to m1: metrics that need no baseline."""
    return [*buckets(tape), MEMBERS, *asof(times), WINDOWS, GRID, UNION, BASKET, SHARES]
