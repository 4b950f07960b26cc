"""The basket table as of a second, and the same table along a clock."""

from pyspark.sql import functions as F

from tickerloom.functions import display
from tickerloom.functions import session as S
from tickerloom.operators import metrics as M
from tickerloom.operators import registry, series
from tickerloom.schema import CLOSE_MINUTE, OPEN_MINUTE

# The columns of the two views.
DEV_COLUMNS = (
    "member_count", "last_minute_dollar_vol", "baseline_20d_dollar_vol", "relative_vol",
    "current_minute_dollar_vol", "flow_share", "flow_share_z",
    "concentration_symbol", "concentration", "cum_share", "cum_share_typ", "cum_share_z",
    "concentration_day_symbol", "concentration_day",
    "breadth_up", "breadth_inline", "breadth_down", "up_on_vol", "vol_unusual", "vol_unmeasured",
)
TRADER_COLUMNS = (
    "cum_share", "cum_share_typ", "cum_share_z", "relative_vol", "breadth_up", "member_count",
    "up_on_vol", "concentration_symbol", "concentration",
    "concentration_day_symbol", "concentration_day",
    "pre_vol", "pre_share", "pre_conc_symbol", "pre_conc",
)


def check_profiles(inp):
    """Raise if a basket member has no ticker baseline."""
    gone = inp.members.join(inp.tickers.select("symbol").distinct(), "symbol", "left_anti").take(1)
    if gone:
        raise ValueError(f"basket {gone[0]['basket']}: {gone[0]['symbol']} has no baseline")
    return inp


def check_configuration(inp):
    """Raise if the benchmark is no symbol of the tape, or a basket member has no baseline.

    Inputs that have passed, and copies of them with the same configuration, are not checked again.
    """
    if inp.checked:
        return inp
    if inp.universe is not None and not inp.universe.filter(F.col("symbol") == inp.benchmark).take(1):
        raise ValueError(f"benchmark {inp.benchmark} is not in the universe")
    if inp.tickers is not None:
        check_profiles(inp)
    inp.checked = True
    return inp


def view(df, mode="dev", flags=False, own=()):
    """The columns of a view of a basket frame and `own`, with what the rows are keyed by."""
    columns = DEV_COLUMNS if mode == "dev" else TRADER_COLUMNS
    out = [*M.KEYS, "basket", *columns]
    if mode == "trader":
        df = M.ranked(df)
        out.append("row_rank")
    if flags:
        df = df.withColumn("cum_share_z_flag", display.z_flag("cum_share_z"))
        df = df.withColumn(
            "breadth_flag", display.breadth_flag("breadth_up", "breadth_down", "members")
        )
        out += ["cum_share_z_flag", "breadth_flag"]
    return df.select(*out, *own, *(["outside"] if "outside" in df.columns else []))


def basket_table(inp, mode="dev", flags=False, extra=()):
    """One row per basket and as-of second; `outside` is 1 where the session has no data around it.

    dev: every metric, by name. trader: the since-open set with `row_rank`. `extra` names
    registered metrics: those made of sums come out of the same pass over the buckets, functions of
    the inputs are joined in.
    """
    check_configuration(inp)
    own = registry.compiled(extra)
    df = M.basket_frame(inp.with_(own=own), shares=True, baseline=True, breadth=True, volume=True)
    df = view(df, mode, flags, own)
    span = M.outside_span(inp.buckets if inp.whole is None else inp.whole, inp.asof)
    df = df.join(span, M.KEYS)
    for name in (n for n in extra if n not in own):
        df = df.join(registry.metric(name)(inp), [*M.KEYS, "basket"], "left")
    return df


def series_clock(dates, step=60, from_minute=OPEN_MINUTE, to_minute=CLOSE_MINUTE):
    """as-of rows every `step` seconds from one New York minute through another."""
    first = S.bucket_start("session_date", from_minute)
    last = S.bucket_start("session_date", to_minute)
    return dates.select(
        "session_date", F.explode(F.sequence(first, last, F.lit(step).cast("bigint"))).alias("at_sec")
    )


def basket_series(inp, step=60, mode="dev", from_minute=OPEN_MINUTE, to_minute=CLOSE_MINUTE, extra=()):
    """basket_table at every step of each session of inp.asof (session_date); see `series`.

    `extra` names registered metrics made of sums.
    """
    check_configuration(inp)
    own = registry.compiled(extra)
    if gone := [n for n in extra if n not in own]:
        raise ValueError(f"metrics of a series are made of sums: {gone}")
    return view(series.series_frame(inp.with_(own=own), step, from_minute, to_minute), mode, own=own)


def basket_changes(inp, step=1, mode="dev", from_minute=OPEN_MINUTE, to_minute=CLOSE_MINUTE, shaped=None):
    """The rows of basket_series that differ from the basket's row before: the series without repeats.

    `shaped` may turn values to the form in which they are compared, such as rounded ones.
    """
    df = basket_series(inp, step, mode, from_minute, to_minute)
    df = df if shaped is None else shaped(df)
    return series.changes(df, ["basket"], [c for c in df.columns if c not in (*M.KEYS, "basket")])
