"""Frame captures: `<recv_ns> <JSON array of events>` per line.

The same decoder serves spark.read and spark.readStream.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions import conditions as C

_BAD = "_bad"

TRADE_EVENT = T.StructType(
    [
        T.StructField("sym", T.StringType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("p", T.DoubleType()),
        T.StructField("s", T.DoubleType()),
        T.StructField("c", T.ArrayType(T.IntegerType())),
        T.StructField("t", T.LongType()),
        T.StructField("pt", T.LongType()),
        T.StructField("q", T.LongType()),
        T.StructField("z", T.IntegerType()),
        T.StructField(_BAD, T.StringType()),
    ]
)
QUOTE_EVENT = T.StructType(
    [
        T.StructField("sym", T.StringType()),
        T.StructField("bx", T.IntegerType()),
        T.StructField("bp", T.DoubleType()),
        T.StructField("bs", T.LongType()),
        T.StructField("ax", T.IntegerType()),
        T.StructField("ap", T.DoubleType()),
        T.StructField("as", T.LongType()),
        T.StructField("c", T.StringType()),
        T.StructField("t", T.LongType()),
        T.StructField("q", T.LongType()),
        T.StructField("z", T.IntegerType()),
        T.StructField(_BAD, T.StringType()),
    ]
)
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
MS = 1_000_000
#: More than a frame has events.
FRAME_EVENTS = 1_000_000_000


def _marked(lines):
    """(recv_ns, frame, whole) of every capture line; whole: neither blank nor torn."""
    v = F.col("value")
    cut = F.instr(v, " ")
    prefix = F.substring(v, F.lit(1), cut - 1)
    recv = F.when(prefix.rlike("^[+-]?[0-9]+$"), prefix.try_cast("bigint"))
    frame = F.substring(v, cut + 1, F.length(v))
    rows = lines.select(recv.alias("recv_ns"), frame.alias("frame"), cut.alias("cut"))
    whole = (F.col("cut") > 1) & F.col("recv_ns").isNotNull() & F.try_parse_json("frame").isNotNull()
    return rows.select("recv_ns", "frame", F.coalesce(whole, F.lit(False)).alias("whole"))


def _line_counts():
    return [F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("whole")).alias("skipped")]


def parse_lines(lines, observe=None):
    """(recv_ns, frame) of capture lines; blank and torn lines are left out.

    observe: an Observation (batch) or a name (stream) under which the job that reads the records
    reports `lines` and `skipped`, without a second scan.
    """
    rows = _marked(lines)
    if observe is not None:
        rows = rows.observe(observe, *_line_counts())
    return rows.filter("whole").select("recv_ns", "frame")


def line_stats(lines):
    """One row: capture lines, and those of them that are left out."""
    return _marked(lines).agg(*_line_counts())


def read_capture(spark, path, observe=None):
    """Records of a capture file or directory, plain or gzip."""
    return parse_lines(spark.read.text(path), observe)


def stream_capture(spark, path, max_files_per_trigger=None, observe=None):
    """The same records from files dropped into a directory."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_lines(reader.text(path), observe)


def explode_frames(records):
    """One row per event with its arrival order; a frame that is no array is one bad row."""
    is_array = F.ltrim(F.col("frame")).startswith("[")
    events = F.when(is_array, F.from_json("frame", "array<string>"))
    return (
        records.select("recv_ns", events.alias("events"))
        .select("recv_ns", F.posexplode_outer("events").alias("pos", "event"), "events")
        .filter(F.col("events").isNull() | (F.size("events") > 0))
        .withColumn("frame_bad", F.col("events").isNull())
        .drop("events")
    )


def decode_events(events, universe=None):
    """Exploded events with `kind`: trade, quote, status, unknown or decode_error."""
    head = F.from_json("event", "ev string, _bad string", _OPTIONS)
    ev = events.withColumn("head", head).withColumn("ev", F.col("head.ev"))
    broken = F.col("frame_bad") | F.col("head._bad").isNotNull() | F.col("head").isNull()
    ev = ev.withColumn("broken", F.coalesce(broken, F.lit(True)))
    ev = ev.withColumn(
        "t", F.when(F.col("ev") == "T", F.from_json("event", TRADE_EVENT, _OPTIONS))
    ).withColumn("q", F.when(F.col("ev") == "Q", F.from_json("event", QUOTE_EVENT, _OPTIONS)))
    sym = F.coalesce(F.col("t.sym"), F.col("q.sym"), F.lit(""))
    ev = ev.withColumn("symbol", F.when(F.col("ev").isin("T", "Q"), sym))
    known = F.lit(True)
    if universe is not None:
        marked = universe.select("symbol").distinct().withColumn("known", F.lit(True))
        ev = ev.join(marked, "symbol", "left")
        known = F.col("known").isNotNull()
    kind = (
        F.when(F.col("broken"), "decode_error")
        .when(F.col(f"t.{_BAD}").isNotNull() | F.col(f"q.{_BAD}").isNotNull(), "decode_error")
        .when(~F.coalesce(F.col("ev"), F.lit("")).isin("T", "Q"), "status")
        .when(~known, "unknown")
        .when(F.col("ev") == "T", "trade")
        .otherwise("quote")
    )
    return ev.withColumn("kind", kind).drop("head", "broken", "known")


def _arrival():
    """Total arrival order: receive time, then position in the frame (a frame is under 2^31 bytes)."""
    wide = F.col("recv_ns").cast("decimal(19,0)") * F.lit(FRAME_EVENTS).cast("decimal(10,0)")
    return (wide + F.coalesce(F.col("pos"), F.lit(0)).cast("decimal(10,0)")).cast("decimal(28,0)")


def _zero(name, dtype):
    return F.coalesce(F.col(name), F.lit(0).cast(dtype)).cast(dtype)


def capture_trades(decoded):
    """Trade rows of decode_events; wire milliseconds become nanoseconds."""
    return decoded.filter("kind = 'trade'").select(
        "symbol",
        _zero("t.p", "double").alias("price"),
        _zero("t.s", "double").alias("size"),
        (_zero("t.t", "bigint") * MS).alias("sip_ns"),
        (_zero("t.pt", "bigint") * MS).alias("part_ns"),
        _zero("t.q", "bigint").alias("seq"),
        _zero("t.x", "int").alias("exchange"),
        _zero("t.z", "int").alias("tape"),
        C.cap_conditions(F.coalesce("t.c", F.array().cast("array<int>"))).alias("conditions"),
        _arrival().alias("arrival"),
        "recv_ns",
    )


def capture_quotes(decoded):
    """Quote rows of decode_events."""
    return decoded.filter("kind = 'quote'").select(
        "symbol",
        _zero("q.bp", "double").alias("bid_price"),
        _zero("q.ap", "double").alias("ask_price"),
        _zero("q.bs", "bigint").alias("bid_size"),
        _zero("q.as", "bigint").alias("ask_size"),
        _zero("q.bx", "int").alias("bid_exch"),
        _zero("q.ax", "int").alias("ask_exch"),
        (_zero("q.t", "bigint") * MS).alias("sip_ns"),
        _zero("q.q", "bigint").alias("seq"),
        C.quote_conditions("q.c").alias("conditions"),
        _arrival().alias("arrival"),
        "recv_ns",
    )


def capture_stats(decoded):
    """One row of counters over decode_events."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    too_many = (F.col("kind") == "trade") & (F.size(F.col("t.c")) > C.MAX_CONDITIONS)
    return decoded.agg(
        n("trade").alias("trades"),
        n("quote").alias("quotes"),
        n("status").alias("status"),
        n("unknown").alias("unknown"),
        n("decode_error").alias("decode_errs"),
        F.count_if(too_many).alias("cond_overflow"),
    )


def peek(decoded, n=3, symbol=None, with_conditions=False):
    """The first n raw trade events in arrival order."""
    df = decoded.filter(F.col("ev") == "T")
    if symbol:
        df = df.filter(F.col("t.sym") == symbol)
    if with_conditions:
        df = df.filter(F.size("t.c") > 0)
    return df.orderBy("recv_ns", "pos").select("recv_ns", "pos", "event").limit(n)
