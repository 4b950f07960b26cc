"""Structured Streaming runs over the given tables, each drained before its rows are read."""

from pyspark.sql import functions as F

from tickerloom.plans import sqltext as Q
from tickerloom.plans import stored, tapes
from tickerloom.plans.base import register, select, shape
from tickerloom.plans.bucket_queries import A1, A5, A5_ROWS, A8, A8_SQL, EVENT, W1, W1_SQL
from tickerloom.plans.metric_queries import TRADER
from tickerloom.plans.source_queries import KNOWN, MS, _capture, universe
from tickerloom.sources import capture, growing
from tickerloom.streaming import live

SLICES = 4
#: Messages of a dropped file: a longer tape has more files, and more of them in a batch.
FILE_ROWS = 1 << 20


def _drops(spark, sf, tape):
    """A tape as a directory of dropped files, out of time order."""

    def write(path):
        df = stored.TAPES[tape](spark, sf)
        files = SLICES * -(-df.count() // (SLICES * FILE_ROWS))
        df.repartition(max(files, SLICES), F.xxhash64("arrival")).write.mode("overwrite").parquet(path)

    return stored._once(spark, sf, f"{tape}_drops", write)


def tape_stream(spark, sf, tape="event"):
    path = _drops(spark, sf, tape)
    drops = spark.read.parquet(path)
    batch = -(-len(drops.inputFiles()) // SLICES)
    return spark.readStream.schema(drops.schema).option("maxFilesPerTrigger", batch).parquet(path)


def _drain(stream, observers=(), **kw):
    query = live.start_bucket_store(stream, on_batch=observers, available_now=True, **kw)
    query.awaitTermination()


def _live_store(spark, sf, tape):
    def write(path):
        _drain(
            tape_stream(spark, sf, tape),
            path=path,
            checkpoint=stored.scratch(spark, f"ckpt_{path.rsplit('/', 2)[-2]}_{tape}"),
        )

    return stored._once(spark, sf, f"{tape}_live", write)


@register("stream_bucket_1s", select(Q.buckets("event"), A1, "b"))
def stream_bucket_1s(spark, sf):
    """The live store after an unordered replay: every late print is in its own second."""
    return shape(live.read_live_buckets(spark, _live_store(spark, sf, "event")), A1)


def _updates(spark, sf, name, df, *keys):
    """A streaming aggregate drained into the shared folder, and its newest rows."""

    def write(path):
        live.start_updates(df(), f"{path}/rows", f"{path}/ckpt").awaitTermination()

    return live.read_updates(spark, f"{stored._once(spark, sf, name, write)}/rows", *keys)


@register("stream_windows", select(Q.buckets("line"), A1, "b"))
def stream_windows(spark, sf):
    """One-second windows kept as streaming state (the watermark spans the whole replay)."""
    windows = lambda: live.windowed_buckets(tape_stream(spark, sf, "line"), "60 days")
    return shape(_updates(spark, sf, "line_windows", windows, "symbol", "second"), A1)


@register("stream_book", select([EVENT], A5, A5_ROWS.format("") + " WHERE n = 1"))
def stream_book(spark, sf):
    """The current book after all quotes streamed in."""
    quotes = lambda: live.live_book(tape_stream(spark, sf).filter("kind = 'quote'"))
    return shape(_updates(spark, sf, "event_book", quotes, "symbol"), A5)


S6 = "s:symbol i:sip_ns i:seq f:price f:size"


@register("stream_capture", select([EVENT], S6, f"tape WHERE kind = 'trade' AND {KNOWN}", sip_ns=MS))
def stream_capture(spark, sf):
    """Captured frames streamed through the same decoder as the batch read."""
    records = capture.stream_capture(spark, _capture(spark, sf))
    events = capture.decode_events(capture.explode_frames(records), universe(spark))
    trades = capture.capture_trades(events).select("symbol", "sip_ns", "seq", "price", "size")

    def write(path):
        out = trades.writeStream.format("parquet").option("checkpointLocation", f"{path}/ckpt")
        out.trigger(availableNow=True).start(f"{path}/rows").awaitTermination()

    path = stored._once(spark, sf, "frames", write)
    return shape(spark.read.schema(trades.schema).parquet(f"{path}/rows"), S6)


def _grow(lines, path, step):
    """Append each file's lines of one step where it lies, as its capture process would."""

    def append(rows):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        files.create_dir(root, recursive=True)
        out = {}
        for r in rows:
            if r.file not in out:
                out[r.file] = files.open_append_stream(f"{root}/capture-{r.file}.jsonl")
            out[r.file].write(r.value.encode() + b"\n")
        for f in out.values():
            f.close()

    rows = lines.filter(F.col("step") == step).repartition(GROWING, "file").sortWithinPartitions("file", "n")
    rows.foreachPartition(append)


GROWING = 3


@register("stream_growing_capture", select([EVENT], S6, f"tape WHERE kind = 'trade' AND {KNOWN}", sip_ns=MS))
def stream_growing_capture(spark, sf):
    """Captures read while they grow: three files, each longer at each of three restarts of the query."""

    def write(path):
        lines = spark.read.text(_capture(spark, sf)).withColumn("n", F.xxhash64("value"))
        lines = lines.withColumns({"file": F.pmod("n", F.lit(GROWING)), "step": F.pmod(F.shiftright("n", 8), F.lit(3))})
        for step in range(3):
            _grow(lines, f"{path}/growing", step)
            records = growing.stream_growing_capture(spark, f"{path}/growing", chunk_bytes=1 << 16)
            events = capture.decode_events(capture.explode_frames(records), universe(spark))
            trades = capture.capture_trades(events).select("symbol", "sip_ns", "seq", "price", "size")
            out = trades.writeStream.format("parquet").option("checkpointLocation", f"{path}/ckpt")
            out.trigger(availableNow=True).start(f"{path}/rows").awaitTermination()

    path = stored._once(spark, sf, "growing_frames", write)
    schema = "symbol string, sip_ns bigint, seq bigint, price double, size double"
    return shape(spark.read.schema(schema).parquet(f"{path}/rows"), S6)


@register("stream_sequence_regressions", W1_SQL)
def stream_sequence_regressions(spark, sf):
    """Sequence regressions counted across micro-batches, with a restart after each of them."""

    def write(path):
        t = tapes.event_tape(spark, sf)
        top = t.agg(F.max("arrival")).first()[0] + 1
        watch = live.SequenceWatch(f"{path}/watch", block_width=1024)
        for n in range(SLICES):
            low, high = n * top // SLICES, (n + 1) * top // SLICES
            part = t.filter((F.col("arrival") >= low) & (F.col("arrival") < high))
            part.write.mode("append").parquet(f"{path}/drops")
            stream = spark.readStream.schema(t.schema).parquet(f"{path}/drops")
            _drain(stream, [watch], path=f"{path}/buckets", checkpoint=f"{path}/ckpt")

    path = stored._once(spark, sf, "seq_watch", write)
    return shape(live.SequenceWatch(f"{path}/watch", 1024).counts(spark), W1)


@register("close_session", A8_SQL)
def close_session(spark, sf):
    """The live store compacted into the bucket table, with each session's coverage."""
    done = live.close_session(
        spark, _live_store(spark, sf, "line"), stored.scratch(spark, f"{sf.strip('/').replace('/', '_')}/closed")
    )
    return shape(done.withColumn("spans", F.col("spans").cast("int")), A8)


ST4_CTES = [
    *Q.profiles("line"),
    "days_all AS (SELECT DISTINCT session_date FROM bs)",
    "times AS (SELECT session_date, max(sip_ns // 1000000000) AS at_sec FROM tape GROUP BY session_date)",
    *Q.CLK,
    *Q.METRIC_TAIL,
]


@register("stream_basket_table", select(ST4_CTES, TRADER, "ranked_table"))
def stream_basket_table(spark, sf):
    """The trader table rendered while the tape streams in; the last rendering is shown."""

    def write(path):
        store_path, out = f"{path}/buckets", f"{path}/table"
        none = stored.session_dates(spark, sf, "line")
        table = live.LiveTable(stored.inputs(spark, sf, none), f"{path}/windows", out)
        _drain(
            tape_stream(spark, sf, "line"),
            observers=[table],
            path=store_path,
            checkpoint=f"{path}/ckpt",
        )

    path = stored._once(spark, sf, "line_live_table", write)
    table = live.LiveTable(None, f"{path}/windows", f"{path}/table")
    return shape(table.latest(spark), TRADER)


