"""Column layouts and the constants every module shares."""

from pyspark.sql import types as T

# The nine print classes in precedence order (rank 0 wins).
CLASSES = (
    "unknown",
    "non_flow",
    "duplicate",
    "non_price_forming",
    "cross_reopen",
    "cross_open",
    "cross_close",
    "block",
    "continuous",
)
RANK = {name: rank for rank, name in enumerate(CLASSES)}

# Session clock, in minutes of the America/New_York day.
ZONE = "America/New_York"
PRE_OPEN_MINUTE = 240
OPEN_MINUTE = 570
CLOSE_MINUTE = 960
SESSION_MINUTES = CLOSE_MINUTE - OPEN_MINUTE

# Metric parameters.
MAD_TO_SIGMA = 1.4826
LOOKBACK_SESSIONS = 20
MIN_SAMPLED_DAYS = 10
FLOOR_FRACTION = 0.25
BENCHMARK = "SPY"
DEAD_BAND = 0.0010
PERSIST_BARS = 3
VOLUME_MULTIPLE = 1.5
BREADTH_HIGHLIGHT = 0.70
Z_HIGHLIGHT = 2.0
MAX_CONDITIONS = 8

TRADES = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("sip_ns", T.LongType()),
        T.StructField("part_ns", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("exchange", T.IntegerType()),
        T.StructField("tape", T.IntegerType()),
        T.StructField("conditions", T.ArrayType(T.IntegerType())),
        T.StructField("arrival", T.LongType()),
    ]
)

QUOTES = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("bid_price", T.DoubleType()),
        T.StructField("ask_price", T.DoubleType()),
        T.StructField("bid_size", T.LongType()),
        T.StructField("ask_size", T.LongType()),
        T.StructField("bid_exch", T.IntegerType()),
        T.StructField("ask_exch", T.IntegerType()),
        T.StructField("sip_ns", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("conditions", T.ArrayType(T.IntegerType())),
        T.StructField("arrival", T.LongType()),
    ]
)

_BUCKET_BASE = [
    T.StructField("second", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("trades", T.LongType()),
    T.StructField("shares", T.DoubleType()),
    T.StructField("dollars", T.DoubleType()),
    T.StructField("last_price", T.DoubleType()),
    T.StructField("last_sip_ns", T.LongType()),
    T.StructField("quotes", T.LongType()),
]


def class_columns():
    """`<class>_trades`, `<class>_shares`, `<class>_dollars`, class by class."""
    return [f"{c}_{part}" for c in CLASSES for part in ("trades", "shares", "dollars")]


BUCKET_FILE = T.StructType(
    _BUCKET_BASE
    + [
        T.StructField(name, T.LongType() if name.endswith("_trades") else T.DoubleType())
        for name in class_columns()
    ]
)
BUCKETS = T.StructType([T.StructField("session_date", T.DateType())] + list(BUCKET_FILE.fields))

TICKER_PROFILE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("minute_of_day", T.IntegerType()),
        T.StructField("days", T.IntegerType()),
        T.StructField("median_shares", T.DoubleType()),
        T.StructField("sigma_shares", T.DoubleType()),
        T.StructField("median_dollars", T.DoubleType()),
        T.StructField("sigma_dollars", T.DoubleType()),
    ]
)

BASKET_PROFILE = T.StructType(
    [
        T.StructField("basket", T.StringType()),
        T.StructField("minute_of_day", T.IntegerType()),
        T.StructField("days", T.IntegerType()),
        T.StructField("median_share", T.DoubleType()),
        T.StructField("sigma_share", T.DoubleType()),
        T.StructField("cum_days", T.IntegerType()),
        T.StructField("median_cum_share", T.DoubleType()),
        T.StructField("sigma_cum_share", T.DoubleType()),
        T.StructField("members", T.ArrayType(T.StringType())),
    ]
)

FLOORS = T.StructType(
    [
        T.StructField("minute_of_day", T.IntegerType()),
        T.StructField("sigma_floor_shares", T.DoubleType()),
        T.StructField("sigma_floor_dollars", T.DoubleType()),
        T.StructField("sigma_floor_flowshare", T.DoubleType()),
        T.StructField("sigma_floor_cumshare", T.DoubleType()),
    ]
)


def require_columns(df, names, what):
    """Raise unless every name is a column of df."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; found {df.columns}")
    return df
