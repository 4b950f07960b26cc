import random

import pytest
from conftest import Tape, et
from pyspark.sql import functions as F

from tickerloom.operators import quality as QL
from tickerloom.sources import capture

DAY_NS = 86_400 * 10**9


@pytest.mark.parametrize("values", [[5], list(range(100)), [3, 3, 3, 9], [-5, -1, 0, 0, 2, 10**9]])
def test_floor_index_quantiles(spark, values):
    rnd = random.Random(1)
    shuffled = values[:]
    rnd.shuffle(shuffled)
    df = spark.createDataFrame([("k", float(v)) for v in shuffled], "k string, v double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)
    got = {r["p"]: r["value"] for r in QL.floor_index_quantiles(df, "v", probs, ["k"]).collect()}
    ordered = sorted(values)
    assert got == {p: float(ordered[int(p * (len(ordered) - 1))]) for p in probs}


def test_quantiles_of_a_heavy_tail_match_brute_force(spark):
    rnd = random.Random(2)
    values = [int(rnd.paretovariate(0.5)) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = {r["p"]: r["value"] for r in QL.floor_index_quantiles(df, "v", QL.LATENCY_PROBS).collect()}
    ordered = sorted(values)
    assert got == {p: ordered[int(p * 4999)] for p in QL.LATENCY_PROBS}


def test_second_load_and_rolling_peak(spark):
    d = "2026-08-11"
    t = Tape()
    for sec, n in (("09:30:02", 5), ("09:30:03", 5), ("09:40:00", 6), ("19:59:59", 6)):
        for i in range(n):
            t.trade("A", et(d, sec), 1, 1) if i % 2 else t.quote("A", et(d, sec))
    dates = spark.createDataFrame([(d,)], "d string").selectExpr("cast(d as date) AS session_date")
    load = QL.second_load(t.frame(spark), dates).cache()
    assert load.count() == 57_600
    assert load.agg({"total": "sum"}).first()[0] == 22
    one = QL.rolling_peak(load, "total", 1).first()
    assert (one["rate"], one["at_sec"]) == (6, et(d, "09:40:00"))
    ten = QL.rolling_peak(load, "total", 10).first()
    assert (ten["rate"], ten["at_sec"]) == (1.0, et(d, "09:29:54"))
    assert QL.sustained_rate(load).first()["rate"] == pytest.approx(16 / 3600)
    assert QL.open_histogram(load).count() == 305


def test_clock_ignores_a_corrupt_future_time(spark):
    base = et("2026-08-11", "10:00:00") * 10**9
    rows = [("d", base, 0), ("d", base + 2 * DAY_NS, 1), ("d", base + 30 * 10**9, 2)]
    df = spark.createDataFrame(rows, "session_date string, sip_ns bigint, arrival bigint")
    assert QL.session_clock(df).first()["clock_ns"] == base + 30 * 10**9


def test_clock_takes_chains_of_jumps_from_zero(spark):
    hour = 3600 * 10**9
    steps = [0, 0, 5, 30, 20, 90, 30, 53, 53 + 24, 200, 100, 124, 150]  # hours after base; 0 is no time
    rows = [("d", k, h and (1000 + h) * hour) for k, h in enumerate(steps)]
    rows += [("e", k, 0) for k in range(2)] + [("f", 0, 7), ("f", 1, 24 * hour + 8), ("f", 2, 24 * hour + 7)]
    df = spark.createDataFrame(rows, "session_date string, arrival bigint, sip_ns bigint")
    clock = {}
    for day, _, ns in rows:
        now = clock.get(day, 0)
        if ns > now and (now == 0 or ns - now <= 24 * hour):
            clock[day] = ns
    for block in (1, 3, 4096):
        assert dict(QL.session_clock(df.repartition(3), block).collect()) == clock


def test_clock_equals_the_rule_message_by_message(spark):
    import random

    day, r = 24 * 3600, random.Random(3)
    rows, want = [], {}
    for name, n, spread in (("calm", 3000, day // 3), ("wild", 3000, 9 * day), ("chain", 1001, 0), ("back", 1001, 0)):
        clock = 0
        for k in range(n):
            ns = 10**6 + (r.randrange(spread) if spread else (k if name == "chain" else n - k) * (day - 1))
            rows.append((name, k, ns * 10**9))
            if ns > clock and (clock == 0 or ns - clock <= day):
                clock = ns
        want[name] = clock * 10**9
    df = spark.createDataFrame(rows, "session_date string, arrival bigint, sip_ns bigint")
    wide = df.withColumn("arrival", (F.col("arrival") + 10**18).cast("decimal(28,0)"))
    for one, chunk in ((df, 1), (df, 700), (wide, 65536)):
        assert dict(QL.session_clock(one.repartition(5), chunk).collect()) == want
    assert QL.session_clock(df.limit(0)).count() == 0


def test_clock_takes_captured_trades(spark, tmp_path):
    event = '{"ev":"T","sym":"A","p":1,"s":1,"t":%d,"q":1}'
    lines = [f"{10**18 + k} [{event % (1786790411377 + k)},{event % (1786790411377 + 3 * k)}]" for k in range(50)]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    records = capture.read_capture(spark, str(tmp_path / "c.jsonl"))
    trades = capture.capture_trades(capture.decode_events(capture.explode_frames(records)))
    clock = QL.session_clock(trades.withColumn("session_date", F.lit("d"))).first()["clock_ns"]
    assert clock == (1786790411377 + 3 * 49) * 10**6


def test_reconcile(spark):
    schema = "symbol string, kind string, sip_ns bigint"
    cap = spark.createDataFrame([("A", "trade", 10), ("A", "trade", 20), ("B", "quote", 10)], schema)
    fl = spark.createDataFrame([("A", "trade", 10), ("A", "trade", 20), ("A", "trade", 11), ("B", "quote", 10), ("B", "quote", 99)], schema)
    u = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    rep = QL.reconcile(cap, fl, u, 10, 99)
    got = {(r["symbol"], r["kind"]): (r["capture"], r["flat"], r["delta"], r["exact"]) for r in rep.collect()}
    assert got["A", "trade"] == (2, 3, 1, 0) and got["B", "quote"] == (1, 1, 0, 1)
    assert got["C", "trade"] == (0, 0, 0, 1)
    s = {r["kind"]: r for r in QL.reconcile_summary(rep).collect()}
    assert (s["trade"]["exact"], s["trade"]["symbols"]) == (2, 3)
    assert s["trade"]["delta_pct"] == pytest.approx(100 / 3)


def test_compare_metrics(spark):
    schema = "session_date string, at_sec bigint, basket string, last_minute_dollar_vol double, baseline_20d_dollar_vol double, relative_vol double"
    a = [("d", 1, "x", 1000.0, 500.0, 2.0), ("d", 1, "y", 0.0, None, None), ("d", 1, "z", 100.0, 50.0, 2.0)]
    b = [("d", 1, "x", 1004.0, 500.0, 2.008), ("d", 1, "y", 0.0, None, None), ("d", 1, "z", 200.0, 51.0, None)]
    got = QL.compare_metrics(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    v = {r["basket"]: (r["base_pass"], r["rvol_pass"], r["last_pass"]) for r in got.collect()}
    assert v == {"x": (1, 1, 1), "y": (1, 1, 1), "z": (0, 0, 0)}
    s = QL.compare_summary(got).first()
    assert (s["checks"], s["base_pass"], s["worst_rel_delta"]) == (3, 2, -0.5)


def test_rvol_check(spark):
    from tickerloom.operators import buckets as B

    t = Tape()
    for s, n in (("A", 100), ("B", 50), ("C", 300)):
        t.trade(s, et("2026-08-11", "09:35:10"), 1, n)
    rows = [(s, 575, float(m)) for s, m in (("A", 100), ("B", 100), ("C", 100), ("D", 100), ("E", 0))]
    prof = spark.createDataFrame(rows, "symbol string, minute_of_day int, median_shares double")
    r = QL.rvol_check(B.bucketize(t.frame(spark)), prof, 575).first()
    assert (r["compared"], r["thin"], r["within"], r["p50"], r["p90"]) == (4, 1, 2, 0.5, 1.0)
    assert QL.rvol_check(B.bucketize(t.frame(spark)), prof, 700).count() == 0
    with pytest.raises(ValueError):
        QL.rvol_check(B.bucketize(t.frame(spark)), prof, 969)


def test_exact_median(spark):
    rows = [("a", 1.0), ("a", 4.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("b", -7.0), ("c", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert dict(QL.exact_median(df, "v", ["k"]).collect()) == {"a": 2.5, "b": 5.0, "c": 2.5}


def test_compare_cumulative(spark):
    cols = "session_date string, at_sec int, basket string, cum_share double, cum_share_typ double, cum_share_z double"
    view = spark.createDataFrame([("d", 1, "a", 0.12344, 0.2, 1.04), ("d", 1, "b", None, 0.2, 1.0), ("d", 1, "x", 0.1, 0.1, 0.0)], cols)
    check = spark.createDataFrame([("d", 1, "a", 0.12341, 0.2, 0.96), ("d", 1, "b", 0.1, 0.2, 1.2)], cols)
    got = {r[2]: tuple(r[3:6]) for r in QL.compare_cumulative(view, check).collect()}
    assert got == {"a": (1, 1, 1), "b": (0, 1, 0), "x": (0, 0, 0)}
