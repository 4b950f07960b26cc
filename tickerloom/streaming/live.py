"""Live bucket store, book, sequence check and basket table.

The bucket store needs no streaming state: every micro-batch appends its own partial
buckets under its batch id, and readers add them up. So a late print amends its true
second however late it is, nothing is dropped, and a repeated batch replaces itself.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions import session as S
from tickerloom.operators import book
from tickerloom.operators import buckets as B
from tickerloom.operators import metrics as M
from tickerloom.operators import table
from tickerloom.schema import BUCKETS, class_columns
from tickerloom.sources import store
from tickerloom.streaming import windows

#: Batches between two folds of the live store.
FOLD_EVERY = 16


def _replace(df, path, *by):
    """Write df; partitions of `by` that it has are replaced, others stay."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def append_epoch(tape, epoch, path):
    """Write one micro-batch's partial buckets; writing the same epoch again replaces it."""
    parts = B.bucketize(tape).withColumn("epoch", F.lit(epoch).cast("bigint"))
    _replace(parts, f"{path}/delta", "epoch", "session_date")


def _parts(spark, path, dates=None, through=None):
    """The newest fold and the partial buckets after it, of the sessions and epochs asked for."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in BUCKETS.fields]
    schema = ", ".join([*fields, "epoch bigint"])
    folded = _folded(spark, path)
    parts = spark.createDataFrame([], schema)
    if store.exists(spark, f"{path}/delta"):
        parts = spark.read.schema(schema).parquet(f"{path}/delta").filter(F.col("epoch") > folded)
    if folded >= 0:
        whole = spark.read.schema(", ".join(fields)).parquet(f"{path}/fold/through={folded}")
        parts = parts.unionByName(whole.withColumn("epoch", F.lit(folded).cast("bigint")))
    if through is not None:
        parts = parts.filter(F.col("epoch") <= through)
    return parts if dates is None else parts.filter(F.col("session_date").isin(*dates))


def _folded(spark, path):
    """The last epoch that a finished fold holds; -1 without one."""
    if not store.exists(spark, f"{path}/folds"):
        return -1
    last = spark.read.schema("through bigint").parquet(f"{path}/folds").agg(F.max("through")).first()[0]
    return -1 if last is None else last


def read_live_buckets(spark, path, dates=None, through=None):
    """bucket_1s as of now, or through an epoch: partial buckets of the sessions added up.

    Between partial buckets with the same last SIP time the later batch wins, as it arrived
    later.
    """
    parts = _parts(spark, path, dates, through)
    sums = ["trades", "shares", "dollars", "quotes"] + class_columns()
    latest = F.col("last_sip_ns").cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)")
    latest = latest + F.col("epoch").cast("decimal(12,0)")
    out = parts.groupBy("session_date", "symbol", "second").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max_by("last_price", latest).alias("last_price"),
        F.max("last_sip_ns").alias("last_sip_ns"),
    )
    return out.select(*BUCKETS.names)


def fold(spark, path, through):
    """Add up all epochs through one; readers then read that table and the epochs after it.

    The fold counts once its row is in `folds`, so a fold that failed is never read. The epochs it
    holds and the fold before it are removed afterwards.
    """
    before = _folded(spark, path)
    if through <= before:
        return
    rows = read_live_buckets(spark, path, through=through)
    rows.write.mode("overwrite").partitionBy("session_date").parquet(f"{path}/fold/through={through}")
    done = spark.range(through, through + 1).withColumnRenamed("id", "through")
    done.coalesce(1).write.mode("append").parquet(f"{path}/folds")
    for epoch in range(before + 1, through + 1):
        store.delete(spark, f"{path}/delta/epoch={epoch}")
    if before >= 0:
        store.delete(spark, f"{path}/fold/through={before}")


def _check_first_epoch(spark, path):
    """A new checkpoint counts epochs from 0: over a store that went further it would lose data."""
    further = _folded(spark, path) >= 0
    if not further and store.exists(spark, f"{path}/delta"):
        epochs = spark.read.parquet(f"{path}/delta").filter(F.col("epoch") > 0)
        further = bool(epochs.take(1))
    if further:
        raise ValueError(f"{path} holds batches of another checkpoint; use its checkpoint or a new store")


def start_bucket_store(tape_stream, path, checkpoint, on_batch=(), available_now=False, fold_every=FOLD_EVERY):
    """Run the live store. `on_batch` holds observers fn(tape, epoch), called on every batch."""

    def each(tape, epoch):
        spark = tape.sparkSession
        if epoch == 0:
            _check_first_epoch(spark, path)
        if on_batch:
            tape = tape.persist()
        try:
            append_epoch(tape, epoch, path)
            for observer in on_batch:
                observer(tape, epoch)
        finally:
            if on_batch:
                tape.unpersist()
        if epoch % fold_every == fold_every - 1:
            fold(spark, path, epoch - 1)  # a repeat of this batch still finds its own epoch

    writer = tape_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def windowed_buckets(tape_stream, watermark="24 hours"):
    """bucket_1s as tumbling windows by event time, with the state Spark keeps for them.

    The watermark bounds that state and drops what arrives later: run one session per query. A
    message whose SIP date is not its session date is left out before it can move the watermark.
    """
    if "session_date" in tape_stream.columns:
        tape_stream = believable(tape_stream)
    rows = tape_stream.withColumn("ts", F.expr("timestamp_micros(sip_ns div 1000)"))
    rows = B._flags(rows.withWatermark("ts", watermark), "ts")
    out = rows.groupBy("symbol", F.window("ts", "1 second").alias("w")).agg(*B._bucket_aggregates())
    out = out.withColumn("second", F.unix_seconds("w.start"))
    return out.withColumn("session_date", S.et_date("second")).select(*BUCKETS.names)


def start_updates(df, path, checkpoint):
    """Run a streaming aggregate in update mode: each batch writes the rows that it changed."""

    def each(rows, epoch):
        (
            rows.withColumn("epoch", F.lit(epoch).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(path)
        )

    out = df.writeStream.outputMode("update").foreachBatch(each)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_updates(spark, path, *keys):
    """The newest row of each key among the rows that start_updates wrote."""
    rows = spark.read.parquet(path)
    newest = W.partitionBy(*keys).orderBy(F.desc("epoch"))
    return rows.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n", "epoch")


def live_book(quote_stream):
    """The current book of every symbol (update mode; one state row per symbol)."""
    return book.nbbo(quote_stream)


def believable(tape_stream):
    """Messages whose SIP date is their session date: one corrupt time cannot move a watermark."""
    return tape_stream.filter(S.et_date("sip_ns div 1000000000") == F.col("session_date"))


class SequenceWatch:
    """Observer that counts sequence regressions across batches.

    Every batch writes the totals and the running maximum of every stream under its id, from
    those of the batch before; two states are kept. So the state is one row per stream, and a
    repeated batch gives the same answer.
    """

    KEYS = ("session_date", "symbol", "kind")

    def __init__(self, path, block_width):
        self.path, self.block_width = path, block_width

    def __call__(self, tape, epoch):
        spark, keys = tape.sparkSession, list(self.KEYS)
        totals = ["messages", "regressions"]
        prior = self._state(spark, epoch - 1) if epoch else None
        found = book.sequence_regressions(tape, self.block_width, prior=prior)
        if prior is not None:
            zero = [F.lit(0).cast("bigint").alias(c) for c in totals]
            found = found.unionByName(prior.select(*keys, *zero, "max_seq"))
            found = found.unionByName(prior.select(*keys, *totals, "max_seq"))
            found = found.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in totals], F.max("max_seq").alias("max_seq"))
        found.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        store.delete(spark, f"{self.path}/epoch={epoch - 2}")

    def _state(self, spark, epoch):
        return spark.read.parquet(f"{self.path}/epoch={epoch}")

    def counts(self, spark):
        """Messages and regressions of every stream so far."""
        last = spark.read.parquet(self.path)
        newest = last.agg(F.max("epoch")).first()[0]
        return last.filter(F.col("epoch") == newest).select(*self.KEYS, "messages", "regressions")


class LiveTable:
    """Observer that renders the basket table of each session a batch touched.

    A session is rendered as of its latest second, from the state of its windows, which the batch is
    merged into first; a rendering replaces the session's last one. Buckets carry the date of
    their own time, so a corrupt far-off time lands in another session and moves no clock.
    """

    def __init__(self, inputs, state_path, out_path, mode="trader"):
        self.inputs, self.out_path, self.mode = inputs, out_path, mode
        self.state = windows.WindowState(state_path)
        if inputs is not None:
            table.check_configuration(inputs)

    def __call__(self, tape, epoch):
        state = self.state.merge(tape, self.inputs, epoch)
        inp = self.inputs.with_(asof=windows.clock(state), windows=windows.member_windows(state))
        df = M.basket_frame(inp, shares=True, baseline=True, breadth=True, volume=True)
        rows = table.view(df.withColumn("outside", F.lit(0)), self.mode)
        _replace(rows, self.out_path, "session_date")

    def latest(self, spark):
        """The newest rendering of each session."""
        return spark.read.parquet(self.out_path)


def close_session(spark, live_path, final_path, dates=None):
    """Compact sessions of the live store into the bucket table and label their coverage.

    Only the sessions of `dates` are read and replaced; None closes every session of the store.
    """
    store.write_buckets(read_live_buckets(spark, live_path, dates), final_path)
    done = store.read_buckets(spark, final_path)
    if dates is not None:
        done = done.filter(F.col("session_date").isin(*dates))
    return B.coverage(B.session_bounds(done))
