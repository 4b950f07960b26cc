"""The windows of a live session as keyed state: what a basket table needs, merged batch by batch.

A row per session, configured symbol and bar holds the bar's dollars and its first and last price.
Sums add up and prices are picked by keys that carry second, nanosecond and batch, so a late print
finds its bar whenever it comes. A table shows the session as of its latest second: bars that no
window looks at singly any more are one row per symbol. So the state goes with the configuration,
and a batch reads that and itself, however long the session is.
"""

from pyspark.sql import functions as F

from tickerloom.functions import session as S
from tickerloom.operators import buckets as B
from tickerloom.operators import metrics as M
from tickerloom.schema import CLOSE_MINUTE, OPEN_MINUTE, PERSIST_BARS, PRE_OPEN_MINUTE
from tickerloom.sources import store

KEYS = ["session_date", "symbol", "bar_sec"]
SCHEMA = (
    "session_date date, symbol string, bar_sec bigint, counted double, auctions double, extended double,"
    " first_key decimal(38,0), first_price double, last_key decimal(38,0), last_price double, hi bigint"
)
#: Bar of everything older than the bars kept singly.
OLD = -1


def _key(second):
    """Order of prices: second, nanosecond in it, batch."""
    wide = lambda e, digits: f"cast({e} as decimal({digits},0))"
    place = f"{wide('last_sip_ns % 1000000000', 9)} * {wide('1' + '0' * 12, 13)} + {wide('epoch', 12)}"
    return f"cast({wide(second, 11)} * {wide('1' + '0' * 22, 23)} + {place} as decimal(38,0))"


def batch_rows(tape, inp, epoch):
    """State rows of one micro-batch; the row without a symbol holds a session's latest second."""
    wall = lambda m: S.bucket_start("session_date", m)
    every = B.bucketize(tape)
    counted, auctions, extended = M._slices(inp)
    rows = M.config_rows(inp.with_(buckets=every)).withColumn("epoch", F.lit(epoch).cast("bigint"))
    rows = rows.withColumn("open_sec", wall(OPEN_MINUTE))
    sec = F.col("second")
    regular = (sec >= F.col("open_sec")) & (sec < wall(CLOSE_MINUTE))
    early = (sec >= wall(PRE_OPEN_MINUTE)) & (sec < F.col("open_sec"))
    traded = regular & (F.col("trades") > 0)
    price = F.when(traded, F.col("last_price"))
    rows = rows.select(
        "session_date",
        "symbol",
        S.bar_start("second", "open_sec", inp.bar_minutes).alias("bar_sec"),
        counted.alias("counted"),
        F.when(regular, auctions).otherwise(0.0).alias("auctions"),
        F.when(early, extended).otherwise(0.0).alias("extended"),
        F.when(traded, F.expr(_key("-second"))).alias("first_key"),
        price.alias("first_price"),
        F.when(traded, F.expr(_key("second"))).alias("last_key"),
        price.alias("last_price"),
    )
    latest = every.groupBy("session_date").agg(F.max("second").alias("hi"))
    return rows.unionByName(latest, allowMissingColumns=True)


def merged(rows, bar_minutes=1):
    """State rows added up by session, symbol and bar; bars out of every window become OLD."""
    bar = 60 * bar_minutes
    wall = lambda m: S.bucket_start("session_date", m)
    latest = rows.groupBy("session_date").agg(F.max("hi").alias("now"))
    latest = latest.withColumn("open_sec", wall(OPEN_MINUTE))
    last_bar = F.least(S.bar_start("now", "open_sec", bar_minutes), wall(CLOSE_MINUTE))
    latest = latest.select("session_date", (last_bar - (PERSIST_BARS + 1) * bar).alias("cut"))
    rows = rows.join(latest, "session_date")
    rows = rows.withColumn("bar_sec", F.when(F.col("bar_sec") < F.col("cut"), OLD).otherwise(F.col("bar_sec")))
    return rows.groupBy(*KEYS).agg(
        *(F.sum(c).alias(c) for c in ("counted", "auctions", "extended")),
        F.max("first_key").alias("first_key"),
        F.max_by("first_price", "first_key").alias("first_price"),
        F.max("last_key").alias("last_key"),
        F.max_by("last_price", "last_key").alias("last_price"),
        F.max("hi").alias("hi"),
    )


def member_windows(state):
    """A windows builder for Inputs: the member frame of the sessions' latest seconds, from state."""

    def build(inp):
        bar = 60 * inp.bar_minutes
        times = M.clocks(inp.asof, inp.bar_minutes).withColumnRenamed("bar_sec", "now_bar")
        rows = state.filter("symbol IS NOT NULL").join(times, "session_date")
        dollars = lambda what, when, name: f"sum(if({when}, {what}, 0D)) AS {name}"
        by = lambda price, j: f"if(bar_sec < cum_end - {j * bar}, {price}_key, NULL)"
        aggs = [
            dollars("counted", "bar_sec = prev_sec", "prev_d"),
            dollars("counted", "bar_sec = now_bar", "cur_d"),
            dollars("auctions", "true", "live_d"),
            dollars("auctions", "bar_sec < cum_end", "cum_d"),
            dollars("extended", "true", "pre_d"),
            *[dollars("counted", f"bar_sec = cum_end - {j * bar}", f"bar{j}_d") for j in M._BARS],
            f"max_by(first_price, {by('first', 0)}) AS anchor",
            *[f"max_by(last_price, {by('last', j - 1)}) AS last{j}" for j in M._BARS],
        ]
        return rows.groupBy(*M.KEYS, "symbol").agg(*[F.expr(a) for a in aggs])

    return build


class WindowState:
    """The stored state: a folder per session and the batch that last changed it."""

    def __init__(self, path):
        self.path = path

    def _read(self, spark, dates, epochs):
        fields = SCHEMA + ", epoch bigint"
        if not store.exists(spark, self.path):
            return spark.createDataFrame([], fields)
        rows = spark.read.schema(fields).parquet(self.path)
        return rows.filter(F.col("session_date").isin(*dates)).filter(epochs)

    def merge(self, tape, inp, epoch):
        """Merge a batch; returns the state of the sessions that it touched.

        The state before the batch stays until the session's next one, so a repeated batch gives
        the same state; what is older is removed.
        """
        spark = tape.sparkSession
        delta = batch_rows(tape, inp, epoch).persist()
        try:
            dates = [r[0] for r in delta.filter("symbol IS NULL").select("session_date").distinct().collect()]
            if not dates:
                return self._read(spark, [None], F.lit(False)).drop("epoch")
            before = self._read(spark, dates, F.col("epoch") < epoch)
            held = before.groupBy("session_date", "epoch").count().collect()
            newest = {}
            for r in held:
                newest[r.session_date] = max(newest.get(r.session_date, -1), r.epoch)
            own = F.lit(False)
            for date, n in newest.items():
                own = own | ((F.col("session_date") == F.lit(date)) & (F.col("epoch") == n))
            rows = before.filter(own).drop("epoch").unionByName(delta)
            out = merged(rows, inp.bar_minutes).withColumn("epoch", F.lit(epoch).cast("bigint"))
            out = out.repartition("session_date").write.mode("overwrite")
            out.option("partitionOverwriteMode", "dynamic").partitionBy("session_date", "epoch").parquet(self.path)
        finally:
            delta.unpersist()
        for r in held:
            if r.epoch < newest[r.session_date]:
                store.delete(spark, f"{self.path}/session_date={r.session_date}/epoch={r.epoch}")
        return self._read(spark, dates, F.col("epoch") == epoch).drop("epoch")


def clock(state):
    """(session_date, at_sec): the latest second of each session."""
    return state.filter("symbol IS NULL").select("session_date", F.col("hi").alias("at_sec"))
