"""Vendor flat files (CSV, plain or gzip) to trade and quote rows."""

from pyspark.sql import functions as F

from tickerloom.functions import conditions as C
from tickerloom.schema import QUOTES, TRADES, require_columns

# The header names each feed must carry.
TRADE_COLUMNS = (
    "ticker", "sip_timestamp", "sequence_number", "conditions",
    "price", "size", "exchange", "tape", "participant_timestamp",
)
QUOTE_COLUMNS = (
    "ticker", "sip_timestamp", "sequence_number", "conditions",
    "bid_price", "bid_size", "bid_exchange", "ask_price", "ask_size", "ask_exchange",
)

_INT = "^[+-]?[0-9]+$"
_FLOAT = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _raw(spark, path, names):
    """CSV as text columns, header names lower-cased and trimmed."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    return require_columns(df, names, str(path)).select(*names)


def _number(name, pattern, dtype):
    """(value, malformed): empty reads as 0; unreadable reads as 0 and is counted."""
    c = F.col(name)
    parsed = F.when(c.rlike(pattern), c.try_cast(dtype))
    value = F.coalesce(parsed, F.lit(0).cast(dtype))
    bad = (c.isNotNull() & (c != "") & parsed.isNull()).cast("int")
    return value, bad


def time_window(df, from_ns=0, to_ns=0, column="sip_ns"):
    """Rows with from_ns <= column < to_ns; 0 leaves that side open."""
    if from_ns:
        df = df.filter(F.col(column) >= from_ns)
    if to_ns:
        df = df.filter(F.col(column) < to_ns)
    return df


def in_universe(df, universe):
    """Rows whose symbol is in the universe; None keeps every row."""
    if universe is None:
        return df
    return df.join(universe.select("symbol"), "symbol", "left_semi")


def _decode(raw, kind):
    ints, floats = {}, {}
    if kind == "trade":
        ints = {
            "part_ns": "participant_timestamp", "seq": "sequence_number",
            "exchange": "exchange", "tape": "tape",
        }
        floats = {"price": "price", "size": "size"}
    else:
        ints = {
            "seq": "sequence_number", "bid_exch": "bid_exchange", "ask_exch": "ask_exchange",
        }
        floats = {
            "bid_price": "bid_price", "ask_price": "ask_price",
            "bid_size": "bid_size", "ask_size": "ask_size",
        }
    sip, sip_bad = _number("sip_timestamp", _INT, "bigint")
    cols, bads = {"symbol": F.col("ticker"), "sip_ns": sip}, []
    for out, src in ints.items():
        cols[out], bad = _number(src, _INT, "bigint")
        bads.append(bad)
    for out, src in floats.items():
        cols[out], bad = _number(src, _FLOAT, "double")
        bads.append(bad)
    all_ids = C.parse_conditions(F.col("conditions"))
    cols["conditions"] = C.cap_conditions(all_ids)
    cols["cond_overflow"] = C.overflowed(all_ids)
    cols["sip_malformed"] = sip_bad
    cols["malformed"] = sum(bads, sip_bad)
    schema = TRADES if kind == "trade" else QUOTES
    cols["arrival"] = cols["seq"]
    typed = [cols[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]
    extra = [cols[n].alias(n) for n in ("cond_overflow", "sip_malformed", "malformed")]
    return raw.select(*typed, *extra)


def read_flat_annotated(spark, path, kind, universe=None, from_ns=0, to_ns=0):
    """Every file row with its `disposition`: windowed, filtered or submitted.

    The time window is tested before the universe, so an excluded row counts once.
    """
    names = TRADE_COLUMNS if kind == "trade" else QUOTE_COLUMNS
    df = _decode(_raw(spark, path, names), kind)
    inside = F.lit(True)
    if from_ns:
        inside = inside & (F.col("sip_ns") >= from_ns)
    if to_ns:
        inside = inside & (F.col("sip_ns") < to_ns)
    known = F.lit(True)
    if universe is not None:
        marked = universe.select("symbol").distinct().withColumn("known", F.lit(True))
        df = df.join(marked, "symbol", "left")
        known = F.coalesce(F.col("known"), F.lit(False))
    df = df.withColumn(
        "disposition",
        F.when(~inside, "windowed").when(~known, "filtered").otherwise("submitted"),
    )
    return df.drop("known")


def _read(spark, path, kind, schema, universe, from_ns, to_ns):
    names = TRADE_COLUMNS if kind == "trade" else QUOTE_COLUMNS
    df = _decode(_raw(spark, path, names), kind)
    df = in_universe(time_window(df, from_ns, to_ns), universe)
    return df.select(*schema.names)


def read_trades_flat(spark, path, universe=None, from_ns=0, to_ns=0):
    """Trade rows of a flat file, window first, then universe."""
    return _read(spark, path, "trade", TRADES, universe, from_ns, to_ns)


def read_quotes_flat(spark, path, universe=None, from_ns=0, to_ns=0):
    """Quote rows of a flat file; sizes are read as floats and truncated."""
    return _read(spark, path, "quote", QUOTES, universe, from_ns, to_ns)


def flat_stats(annotated):
    """One row of counters over read_flat_annotated."""
    submitted = F.col("disposition") == "submitted"
    one = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))
    return annotated.agg(
        F.count("*").alias("rows"),
        one(submitted).alias("submitted"),
        one(F.col("disposition") == "filtered").alias("filtered"),
        one(F.col("disposition") == "windowed").alias("windowed"),
        F.coalesce(
            F.sum(F.when(submitted, F.col("malformed")).otherwise(F.col("sip_malformed"))),
            F.lit(0),
        ).alias("malformed"),
        F.coalesce(F.sum(F.when(submitted, F.col("cond_overflow"))), F.lit(0)).alias(
            "cond_overflow"
        ),
    )


def union_tape(trades, quotes):
    """One tape of both feeds; `kind` says which."""
    return trades.withColumn("kind", F.lit("trade")).unionByName(
        quotes.withColumn("kind", F.lit("quote")), allowMissingColumns=True
    )
