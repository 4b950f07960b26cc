"""Per-symbol message state: current book, sequence regressions, busiest symbols."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOOK = ("bid_price", "ask_price", "bid_size", "ask_size", "bid_exch", "ask_exch", "sip_ns", "seq")


def nbbo(quotes, from_ns=0, to_ns=0):
    """The last received quote of every symbol, as of to_ns when given.

    Arrival order decides, sequence regressions included. A lower time bound would leave
    out the quotes that set the book, so it is refused.
    """
    if from_ns:
        raise ValueError("a book needs every quote up to its time: no lower bound")
    if to_ns:
        quotes = quotes.filter(F.col("sip_ns") < to_ns)
    picks = [F.max_by(c, "arrival").alias(c) for c in BOOK]
    return quotes.groupBy("symbol").agg(*picks)


def sequence_regressions(tape, block_width, keys=("session_date", "symbol", "kind"), prior=None):
    """Messages whose sequence number is below the running maximum of their stream.

    A stream (one symbol of one feed) may hold most of the tape, so it is cut into blocks of
    `block_width` arrival units. Block maxima are carried forward over the few blocks of a
    stream; only the rows of one block meet in one task. `prior` (keys, max_seq) continues
    streams of an earlier batch.
    """
    keys = list(keys)
    rows = tape.select(
        *keys, "arrival", "seq", F.floor(F.col("arrival") / block_width).alias("block")
    )
    blocks = rows.groupBy(*keys, "block").agg(F.max("seq").alias("top"))
    before = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = F.max("top").over(before)
    if prior is None:
        blocks = blocks.withColumn("carried", F.coalesce(carried, F.lit(0)))
    else:
        blocks = blocks.join(prior.select(*keys, "max_seq"), keys, "left")
        seen = F.greatest(carried, F.col("max_seq"), F.lit(0))
        blocks = blocks.withColumn("carried", seen)
    inside = (
        W.partitionBy(*keys, "block").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    )
    rows = rows.withColumn("inside", F.max("seq").over(inside))
    rows = rows.join(blocks.select(*keys, "block", "carried"), [*keys, "block"])
    regressed = F.col("seq") < F.greatest("inside", "carried")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("messages"),
        F.count_if(regressed).alias("regressions"),
        F.greatest(F.max("seq"), F.max("carried")).alias("max_seq"),
    )


def symbol_counts(tape):
    """Trades and quotes of every symbol."""
    trade = F.col("kind") == "trade"
    return tape.groupBy("symbol").agg(
        F.count_if(trade).alias("trades"), F.count_if(~trade).alias("quotes")
    )


def busiest_symbols(tape, n=10):
    """The n symbols with the most messages; ties by name."""
    counts = symbol_counts(tape).withColumn("messages", F.col("trades") + F.col("quotes"))
    return counts.orderBy(F.desc("messages"), "symbol").limit(n)
