import random

import pytest
from conftest import Tape, et
from pyspark.sql import functions as F

from tickerloom.operators import book, prints
from tickerloom.operators import buckets as B
from tickerloom.schema import BUCKETS, class_columns
from tickerloom.sources import store


def rows_of(df):
    return {(r["symbol"], r["second"]): r for r in df.collect()}


def test_totals_classes_and_last_price(spark, tape):
    tape.trade("NVDA", 100, 50.0, 100).trade("NVDA", 100, 50.10, 200, [14])
    tape.trade("NVDA", 100, 50.05, 1000, [2], ns=7).trade("NVDA", 101, 50.20, 300, [30])
    tape.trade("SPY", 100, 600, 10)
    for _ in range(3):
        tape.quote("SPY", 100)
    got = rows_of(B.bucketize(tape.frame(spark)))
    assert len(got) == 3
    r = got["NVDA", 100]
    assert (r["trades"], r["shares"], r["last_price"]) == (3, 1300, 50.05)
    assert (r["continuous_trades"], r["continuous_shares"], r["continuous_dollars"]) == (2, 300, 15020)
    assert (r["duplicate_trades"], r["duplicate_shares"], r["duplicate_dollars"]) == (1, 1000, 50050)
    assert got["SPY", 100]["quotes"] == 3 and got["NVDA", 101]["continuous_trades"] == 1
    assert B.bucketize(tape.frame(spark)).columns == BUCKETS.names


def test_late_print_keeps_the_later_price_and_ties_go_to_arrival(spark, tape):
    tape.trade("A", 100, 50, 1, ns=200_000_000).trade("A", 100, 49, 1, ns=100_000_000)
    tape.trade("B", 100, 10, 1, ns=5).trade("B", 100, 11, 1, ns=5)
    tape.quote("C", 100)
    got = rows_of(B.bucketize(tape.frame(spark)))
    assert got["A", 100]["last_price"] == 50
    assert got["B", 100]["last_price"] == 11
    assert (got["C", 100]["last_price"], got["C", 100]["last_sip_ns"]) == (0.0, 0)


def test_order_of_rows_does_not_matter_and_wide_arrival_agrees(spark):
    rnd, t = random.Random(7), Tape()
    for _ in range(400):
        t.trade(rnd.choice("AB"), 1000 + rnd.randrange(200), rnd.randrange(1, 99), rnd.randrange(1, 9),
                [rnd.randrange(75)], ns=rnd.randrange(3))
    base = B.bucketize(t.frame(spark)).orderBy("second", "symbol").collect()
    rnd.shuffle(t.rows)
    again = t.frame(spark)
    assert B.bucketize(again).orderBy("second", "symbol").collect() == base
    wide = again.withColumn("arrival", F.col("arrival").cast("decimal(28,0)"))
    assert B.bucketize(wide).orderBy("second", "symbol").collect() == base


@pytest.mark.parametrize("base", [0, 2**33 - 1, 2**62, -(2**63), 2**63 - 3])
def test_arrivals_of_any_width_order_ties(spark, tape, base):
    for price in (7, 9, 8):
        tape.trade("A", 1, price, 1, ns=5)
    tape.trade("A", 1, 1, 1, ns=4)  # earlier on the tape's clock, later in arrival
    df = tape.frame(spark).withColumn("arrival", F.lit(base) + F.least("arrival", F.lit(2)))
    assert B.bucketize(df).first()["last_price"] == 8


def test_minutes_equal_the_sum_of_their_seconds(spark):
    rnd, t = random.Random(3), Tape()
    for _ in range(300):
        t.trade("A", 6000 + rnd.randrange(180), rnd.randrange(1, 99), rnd.randrange(1, 9), [rnd.randrange(40)])
    b = B.bucketize(t.frame(spark))
    minutes = {r["minute"]: r for r in B.minute_buckets(b).collect()}
    for start in (6000, 6060, 6120):
        one = B.derive_minute(b, start).first()
        sums = b.filter((F.col("second") >= start) & (F.col("second") < start + 60))
        want = sums.agg(*[F.sum(c) for c in ["trades", *class_columns()]]).first()
        assert tuple(one[c] for c in ["trades", *class_columns()]) == tuple(want)
        assert minutes[start]["last_price"] == one["last_price"]
    with pytest.raises(ValueError):
        B.derive_minute(b, 6001)


def test_first_and_last_trade_price_skip_quote_only_seconds(spark, tape):
    tape.quote("A", 100).trade("A", 101, 5, 1).trade("A", 103, 7, 1).quote("A", 104)
    b = B.bucketize(tape.frame(spark))
    assert B.first_trade_price(b, "symbol").first()["first_price"] == 5
    assert B.last_trade_price(b, "symbol").first()["last_price"] == 7


@pytest.mark.parametrize("last, quotes, label", [("16:00:00", True, "full"), ("15:59:59", True, "partial"), ("16:00:00", False, "partial")])
def test_coverage(spark, tape, last, quotes, label):
    d = "2026-08-11"
    tape.trade("A", et(d, "09:30:00"), 1, 1).trade("A", et(d, last), 1, 1)
    if quotes:
        tape.quote("A", et(d, "12:00:00"))
    bounds = B.session_bounds(B.bucketize(tape.frame(spark)))
    assert B.coverage(bounds).first()["coverage"] == label
    if label == "partial" and not quotes:
        assert B.coverage(bounds, trades_only=True).first()["coverage"] == "trades-only"


def test_store_replaces_only_the_sessions_it_writes(spark, tape, tmp_path):
    a, b = et("2026-08-11", "10:00:00"), et("2026-08-12", "10:00:00")
    tape.trade("A", a, 1, 1).trade("A", b, 2, 1)
    path = str(tmp_path / "b")
    rows = B.bucketize(tape.frame(spark))
    store.write_buckets(rows, path)
    store.write_buckets(B.bucketize(Tape().trade("A", b, 3, 1).frame(spark)), path)
    got = {r["second"]: r["last_price"] for r in store.read_buckets(spark, path).collect()}
    assert got == {a: 1.0, b: 3.0}
    csv = str(tmp_path / "csv")
    store.write_buckets_csv(rows, csv)
    assert store.read_buckets_csv(spark, csv).orderBy("second").collect() == rows.orderBy("second").collect()


def test_bucket_csv_columns(spark, tape, tmp_path):
    rows = B.bucketize(tape.trade("A", 100, 1, 1).frame(spark)).drop("session_date")
    extra, short = str(tmp_path / "x"), str(tmp_path / "s")
    rows.withColumn("new_column", F.lit(1)).write.option("header", True).csv(extra)
    rows.drop("quotes").write.option("header", True).csv(short)
    assert store.read_buckets_csv(spark, extra).count() == 1
    with pytest.raises(ValueError, match="quotes"):
        store.read_buckets_csv(spark, short)
    bad = str(tmp_path / "bad")
    rows.withColumn("trades", F.lit("x")).write.option("header", True).csv(bad)
    with pytest.raises(Exception):
        store.read_buckets_csv(spark, bad).collect()


def test_unknown_ids_are_counted_and_quarantined(spark, tape):
    df = tape.trade("A", 1, 1, 1, [99]).trade("A", 1, 1, 1, [99, 98]).trade("A", 1, 1, 1).frame(spark)
    assert [tuple(r) for r in prints.unknown_condition_ids(df).collect()] == [(98, 1), (99, 2)]
    assert prints.unknown_condition_prints(df).first()["prints"] == 2
    with pytest.raises(ValueError, match="98"):
        prints.check_known_conditions(df)


@pytest.mark.parametrize("width", [1, 2, 100])
def test_sequence_regressions(spark, width):
    rows = [("2026-01-01", "A", "trade", i, s) for i, s in enumerate([1, 2, 5, 4, 6])]
    df = spark.createDataFrame(rows, "session_date string, symbol string, kind string, arrival bigint, seq bigint")
    got = book.sequence_regressions(df, width).first()
    assert (got["messages"], got["regressions"], got["max_seq"]) == (5, 1, 6)


def test_sequence_regressions_match_brute_force_for_a_hot_symbol(spark):
    rnd = random.Random(11)
    rows, top, want = [], {}, {}
    for i in range(3000):
        sym = "H" if rnd.random() < 0.7 else rnd.choice("XYZ")
        seq = i + rnd.randrange(-40, 40)
        if seq < top.get(sym, 0):
            want[sym] = want.get(sym, 0) + 1
        top[sym] = max(top.get(sym, 0), seq)
        rows.append(("2026-01-01", sym, "trade", i, seq))
    df = spark.createDataFrame(rows, "session_date string, symbol string, kind string, arrival bigint, seq bigint")
    got = {r["symbol"]: r["regressions"] for r in book.sequence_regressions(df, 64).collect()}
    assert got == want
    first, rest = df.filter("arrival < 1000"), df.filter("arrival >= 1000")
    a = book.sequence_regressions(first, 64)
    b = book.sequence_regressions(rest, 64, prior=a)
    both = a.unionByName(b).groupBy("symbol").agg(F.sum("regressions").alias("n")).collect()
    assert {r["symbol"]: r["n"] for r in both} == want


def test_book_is_the_last_received_quote(spark):
    schema = "symbol string, bid_price double, ask_price double, bid_size bigint, ask_size bigint, bid_exch int, ask_exch int, sip_ns bigint, seq bigint, arrival bigint"
    rows = [("SPY", 500.01, 500.03, 1, 1, 1, 1, 1000, 9, 0), ("SPY", 500.03, 500.04, 4, 2, 1, 1, 2000, 3, 1),
            ("SPY", 1.0, 2.0, 1, 1, 1, 1, 3000, 4, 2)]
    q = spark.createDataFrame(rows, schema)
    got = book.nbbo(q, to_ns=3000).first()
    assert (got["bid_price"], got["bid_size"], got["ask_price"], got["ask_size"], got["sip_ns"]) == (500.03, 4, 500.04, 2, 2000)
    assert book.nbbo(q).first()["bid_price"] == 1.0
    with pytest.raises(ValueError):
        book.nbbo(q, from_ns=1000)


def test_busiest_symbols(spark, tape):
    tape.trade("B", 1, 1, 1).quote("B", 1).trade("A", 1, 1, 1).quote("A", 1).trade("C", 1, 1, 1)
    got = book.busiest_symbols(tape.frame(spark), 2).collect()
    assert [(r["symbol"], r["messages"]) for r in got] == [("A", 2), ("B", 2)]


def test_no_scan_task_aggregates_buckets(spark, tape):
    plan = B.bucketize(tape.trade("S1", 1_700_000_000, 1, 1).frame(spark))._jdf.queryExecution().sparkPlan().toString()
    lines = [line.strip(" :+-*") for line in plan.splitlines()]
    shuffle = next(k for k, line in enumerate(lines) if line.startswith("Exchange") or "REPARTITION_BY_COL" in line)
    aggregates = [k for k, line in enumerate(lines) if line.startswith("HashAggregate")]
    assert aggregates and max(aggregates) < shuffle
