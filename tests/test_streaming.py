import random

import pytest
from conftest import Tape, et
from pyspark.sql import functions as F

from tickerloom.functions import session as S
from tickerloom.operators import book, table
from tickerloom.operators import buckets as B
from tickerloom.schema import PERSIST_BARS
from tickerloom.sources import growing
from tickerloom.streaming import live


def make_tape():
    rnd, t = random.Random(9), Tape()
    for _ in range(600):
        sec = et("2026-08-11", "10:00:00") + rnd.randrange(120)
        t.trade(rnd.choice("AAAB"), sec, rnd.randrange(1, 99), 1, [rnd.randrange(40)], ns=rnd.randrange(4))
        if rnd.random() < 0.3:
            t.quote("A", sec)
    return t


def test_live_store_equals_batch_across_restarts(spark, tmp_path):
    t = make_tape()
    df = t.frame(spark)
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    n = len(t.rows)
    watch = live.SequenceWatch(str(tmp_path / "watch"), block_width=50)
    for i in range(3):
        df.filter(f"arrival >= {i * n // 3} AND arrival < {(i + 1) * n // 3}").write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        live.start_bucket_store(stream, out, ckpt, [watch], available_now=True).awaitTermination()
    want = B.bucketize(df).orderBy("second", "symbol").collect()
    assert live.read_live_buckets(spark, out).orderBy("second", "symbol").collect() == want
    regressions = lambda rows: sorted((r["symbol"], r["kind"], r["messages"], r["regressions"]) for r in rows.collect())
    assert regressions(watch.counts(spark)) == regressions(book.sequence_regressions(df, 50))


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    df = make_tape().frame(spark)
    out = str(tmp_path / "out")
    live.append_epoch(df, 0, out)
    live.append_epoch(df.filter("arrival < 5"), 1, out)
    live.append_epoch(df.filter("arrival < 5"), 1, out)
    got = live.read_live_buckets(spark, out).agg({"trades": "sum", "quotes": "sum"}).first()
    assert sum(got) == df.count() + 5


def test_a_long_day_keeps_few_files_and_folds_add_up(spark, tmp_path):
    df = make_tape().frame(spark)
    out, n, most = str(tmp_path / "out"), 50, 0
    for k in range(n):
        live.append_epoch(df.filter(f"arrival % {n} = {k}").coalesce(1), k, out)
        if k % 8 == 7:
            live.fold(spark, out, k - 1)
        most = max(most, len(list((tmp_path / "out/delta").rglob("*.parquet"))))
    assert most <= 10 * 4  # ten epochs at most, a file per shuffle partition
    assert len(list((tmp_path / "out/fold").glob("through=*"))) == 1
    order = lambda rows: [r[:3] for r in rows.orderBy("second", "symbol").select("symbol", "second", "trades").collect()]
    assert order(live.read_live_buckets(spark, out)) == order(B.bucketize(df))


def test_a_new_checkpoint_over_an_old_store_is_refused(spark, tmp_path):
    df = make_tape().frame(spark)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df.write.parquet(src)
    for epoch in (0, 1):
        live.append_epoch(df, epoch, out)
    stream = spark.readStream.schema(df.schema).parquet(src)
    with pytest.raises(Exception, match="another checkpoint"):
        live.start_bucket_store(stream, out, str(tmp_path / "new"), available_now=True).awaitTermination()


def test_sequence_watch_keeps_two_states(spark, tmp_path):
    df = make_tape().frame(spark)
    watch = live.SequenceWatch(str(tmp_path / "w"), 50)
    for k in range(5):
        watch(df.filter(f"arrival >= {k * 200} AND arrival < {(k + 1) * 200}"), k)
    assert len(list((tmp_path / "w").glob("epoch=*"))) == 2
    rows = lambda d: sorted((r["symbol"], r["kind"], r["messages"], r["regressions"]) for r in d.collect())
    assert rows(watch.counts(spark)) == rows(book.sequence_regressions(df.filter("arrival < 1000"), 50))


def test_window_state_uses_the_nanosecond(spark, tmp_path):
    late = 1704200000999999999
    df = spark.createDataFrame([("A", "trade", 5.0, 1.0, late, [], 0)], "symbol string, kind string, price double, size double, sip_ns bigint, conditions array<int>, arrival bigint")
    df.write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "src"))
    live.start_updates(live.windowed_buckets(stream), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = live.read_updates(spark, str(tmp_path / "out"), "symbol", "second")
    assert got.select("second", "trades", "continuous_trades").collect() == [(1704200000, 1, 1)]


def test_close_session_labels_coverage(spark, tmp_path):
    d = "2026-08-11"
    t = Tape().trade("A", et(d, "09:30:00"), 1, 1).quote("A", et(d, "12:00:00")).trade("A", et(d, "16:00:00"), 1, 1)
    live.append_epoch(t.frame(spark), 0, str(tmp_path / "live"))
    done = live.close_session(spark, str(tmp_path / "live"), str(tmp_path / "final"))
    assert done.first()["coverage"] == "full"


def test_believable_messages(spark):
    d = "2026-08-11"
    t = Tape().trade("A", et(d, "10:00:00"), 1, 1).trade("A", et("2026-08-14", "10:00:00"), 1, 1)
    rows = [r[:-1] + (t.rows[0][-1],) for r in t.rows]
    df = spark.createDataFrame(rows, Tape.schema)
    assert live.believable(df).count() == 1


def test_live_table_equals_the_batch_table_after_every_batch(spark, tmp_path):
    import random

    from test_metrics import basket_profile, floors, inputs, ticker_profile

    d, r, t = "2026-08-11", random.Random(4), Tape()
    for k in range(900):
        sec = et(d, "09:20:00") + k * 20 - (r.randrange(4000) if k % 7 == 0 else 0)  # some come late
        day = "2026-08-12" if k % 97 == 0 else d
        sec += et(day, "09:20:00") - et(d, "09:20:00")
        t.trade(r.choice(["A", "B", "C", "SPY", "other"]), sec, 90 + r.randrange(20), r.randrange(1, 50),
                r.choice([[], [], [12], [25], [37]]), r.randrange(10**9))
    t.quote("other", et(d, "16:20:00"))
    kw = dict(tickers=ticker_profile(spark, dict(A=500, B=0, C=100)), baskets=basket_profile(spark, ["x", "y"]), floors=floors(spark))
    inp = inputs(spark, t, et(d, "10:00:00"), dict(x=["A", "B"], y=["B", "C"]), **kw)
    tape, state, out = t.frame(spark).cache(), str(tmp_path / "state"), str(tmp_path / "out")
    shown = lambda df: {tuple(x[:3]): [round(v, 6) if isinstance(v, float) else v for v in x[3:]] for x in df.collect()}
    bounds, live_rows = [0, 40, 41, 300, 650, 902], []
    for epoch, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = tape.filter((F.col("arrival") >= a) & (F.col("arrival") < b))
        for _ in range(1 + epoch % 2):  # every other batch is repeated, by a new observer
            live.LiveTable(inp, state, out, "dev")(part, epoch)
        rows = B.bucketize(tape.filter(F.col("arrival") < b))
        touched = part.select(S.et_date("sip_ns div 1000000000").alias("session_date")).distinct()
        clock = rows.groupBy("session_date").agg(F.max("second").alias("at_sec")).join(touched, "session_date", "left_semi")
        want = table.basket_table(inp.with_(buckets=rows, asof=clock), "dev")
        got = spark.read.parquet(out).select(*want.columns).join(touched, "session_date", "left_semi")
        assert shown(got) == shown(want) and shown(want), epoch
        held = spark.read.parquet(state).filter(F.col("session_date").cast("string") == d)
        live_rows.append(held.filter(F.col("epoch") == epoch).count())
        assert held.select("epoch").distinct().count() <= 2
    assert max(live_rows) <= 4 * (3 + PERSIST_BARS) + 1  # symbols x bars that windows look at, not bars so far


def test_a_growing_file_is_read_once_line_by_line(spark, tmp_path):
    src, out, ckpt = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()

    def drain():
        lines = growing.stream_growing_lines(spark, str(src), chunk_bytes=7)
        q = lines.writeStream.format("parquet").option("checkpointLocation", ckpt)
        q.trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.value for r in spark.read.schema("value string").parquet(out).collect())

    a, b = src / "a.jsonl", src / "b.jsonl"
    a.write_bytes(b"one\ntwo is longer than a chunk\n\nthr")
    assert drain() == ["", "one", "two is longer than a chunk"]  # the torn tail waits
    with a.open("ab") as f:
        f.write("ee \u00e9\r\nfour".encode())
    b.write_bytes(b"other\n")
    (src / "_hidden").write_bytes(b"no\n")
    assert drain() == ["", "one", "other", "three \u00e9", "two is longer than a chunk"]
    with a.open("ab") as f:
        f.write(b"\n")
    assert drain() == drain() == ["", "four", "one", "other", "three \u00e9", "two is longer than a chunk"]
    a.write_bytes(b"one\n")
    with pytest.raises(Exception, match="shorter"):
        drain()


def test_a_longer_tape_has_more_drop_files_and_as_many_batches(spark, tape, monkeypatch):
    from tickerloom.plans import stored, stream_queries

    for k in range(64):
        tape.trade("S1", 1_700_000_000 + k, 1, 1)
    rows = tape.frame(spark)
    monkeypatch.setitem(stored.TAPES, "many", lambda spark, sf: rows)
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 4, raising=False)
    files = spark.read.parquet(stream_queries._drops(spark, "drop-test", "many")).inputFiles()
    assert len(files) > 2 * stream_queries.SLICES
    assert spark.read.parquet(*files).count() == 64
