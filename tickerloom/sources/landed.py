"""A tape landed as parquet, laid out so that time windows and universes reach the scan.

Files belong to a session and a slice of SIP time, rows are in SIP order with many row groups, and
symbols have a Bloom filter. A window then prunes partitions and row groups by their statistics, a
short list of symbols prunes row groups by the filter.
"""

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tickerloom.schema import ZONE
from tickerloom.sources import flat

#: Symbols that are put into the scan's filter; a longer universe is a semi-join alone.
LISTED = 64
#: Bytes of a row group, and symbols that its filter is made for.
ROW_GROUP, SYMBOLS = 8 << 20, 20_000


def land_tape(tape, path, slice_minutes=30, row_group=ROW_GROUP):
    """Replace the sessions present in `tape` (symbol, sip_ns, session_date, ...).

    Sessions are spread over slices of SIP time, so no task holds a whole session.
    """
    slot = F.floor(F.col("sip_ns") / (slice_minutes * 60_000_000_000))
    (
        tape.repartition("session_date", slot)
        .sortWithinPartitions("session_date", "sip_ns", "symbol")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", row_group)
        .option("parquet.bloom.filter.enabled#symbol", "true")
        .option("parquet.bloom.filter.expected.ndv#symbol", SYMBOLS)
        .partitionBy("session_date")
        .parquet(path)
    )


def _dates(from_ns, to_ns):
    """First and last New York date of a window; None where it is open.

    A message's session is the date of its own SIP time, as in the stores.
    """
    day = lambda ns: dt.datetime.fromtimestamp(ns // 10**9, ZoneInfo(ZONE)).date()
    return day(from_ns) if from_ns else None, day(to_ns - 1) if to_ns else None


def read_landed(spark, path, universe=None, from_ns=0, to_ns=0, own_dates=True):
    """The landed tape of a half-open window and a universe (symbol); None and 0 leave them open.

    own_dates: sessions are dates of SIP time, so the window prunes partitions too. A universe of at
    most LISTED symbols is filtered by the scan.
    """
    df = flat.time_window(spark.read.parquet(path), from_ns, to_ns)
    first, last = _dates(from_ns, to_ns) if own_dates else (None, None)
    if first is not None:
        df = df.filter(F.col("session_date") >= F.lit(first))
    if last is not None:
        df = df.filter(F.col("session_date") <= F.lit(last))
    if universe is not None:
        names = [r[0] for r in universe.select("symbol").distinct().limit(LISTED + 1).collect()]
        if len(names) <= LISTED:
            return df.filter(F.col("symbol").isin(names))
    return flat.in_universe(df, universe)
