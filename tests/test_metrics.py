import pytest
from conftest import Tape, et
from pyspark.sql import functions as F

from tickerloom.operators import buckets as B
from tickerloom.operators import metrics as M
from tickerloom.operators import registry, table

D = "2026-08-11"


def at(hms):
    return et(D, hms)


def members(spark, **baskets):
    rows = [(b, s) for b, names in baskets.items() for s in names]
    return spark.createDataFrame(rows, "basket string, symbol string")


def ticker_profile(spark, medians, minutes=range(570, 960)):
    rows = [(s, m, 20, 1.0, 0.0, float(d), 0.0) for s, d in medians.items() for m in minutes]
    return spark.createDataFrame(rows, "symbol string, minute_of_day int, days int, median_shares double, sigma_shares double, median_dollars double, sigma_dollars double")


def basket_profile(spark, names, days=20, med=0.25, sigma=0.125, cum_days=20):
    rows = [(b, m, days, med, sigma, cum_days, med, sigma) for b in names for m in range(570, 960)]
    return spark.createDataFrame(rows, "basket string, minute_of_day int, days int, median_share double, sigma_share double, cum_days int, median_cum_share double, sigma_cum_share double")


def floors(spark, f=0.0625):
    rows = [(m, f, f, f, f) for m in range(570, 960)]
    return spark.createDataFrame(rows, "minute_of_day int, sigma_floor_shares double, sigma_floor_dollars double, sigma_floor_flowshare double, sigma_floor_cumshare double")


def inputs(spark, tape, sec, config, **kw):
    return M.Inputs(
        buckets=B.bucketize(tape.frame(spark)),
        members=members(spark, **config),
        asof=M.asof_literal(spark, sec),
        **kw,
    )


def by_basket(df):
    return {r["basket"]: r for r in df.collect()}


def test_volume_columns(spark, tape):
    tape.trade("AMD", at("10:00:30"), 10, 100).trade("NVDA", at("10:00:59"), 20, 100)
    tape.trade("AMD", at("10:01:10"), 10, 55).trade("AMD", at("10:01:40"), 10, 99)
    inp = inputs(spark, tape, at("10:01:30"), dict(chips=["AMD", "NVDA"], quiet=["SPY"]),
                 tickers=ticker_profile(spark, dict(AMD=500, NVDA=1000, SPY=0)))
    got = by_basket(M.basket_frame(inp, baseline=True))
    c, q = got["chips"], got["quiet"]
    assert (c["member_count"], c["last_minute_dollar_vol"], c["baseline_20d_dollar_vol"]) == (2, 3000, 1500)
    assert (c["relative_vol"], c["current_minute_dollar_vol"]) == (2.0, 550)
    assert (q["last_minute_dollar_vol"], q["relative_vol"], q["flow_share"]) == (0, None, 0.0)
    early = inp.with_(asof=M.asof_literal(spark, at("09:30:30")))
    assert by_basket(M.basket_frame(early, baseline=True))["chips"]["baseline_20d_dollar_vol"] is None


def test_one_second_reads_one_session(spark, tape):
    for d in ("2026-08-10", D):
        tape.trade("A", et(d, "10:00:10"), 10, 3).trade("B", et(d, "10:00:20"), 10, 1)
    inp = inputs(spark, tape, at("10:00:15"), dict(a=["A"], b=["B"]))
    cut = inp.with_(asof=None).at(at("10:00:15"))
    plan = M.basket_frame(cut)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    order = lambda i: M.basket_frame(i).orderBy("basket").collect()
    assert order(cut) == order(inp)
    assert by_basket(M.basket_frame(cut))["a"]["flow_share"] == 1.0


def test_flow_share_and_concentration(spark, tape):
    for s, d in (("A", 300), ("B", 100), ("C", 600)):
        tape.trade(s, at("13:00:10"), d, 1)
    tape.trade("A", at("13:00:20"), 600, 1, [18])
    baskets = dict(ab=["A", "B"], abc=["A", "B", "C"], d=["D"])
    got = by_basket(M.basket_frame(inputs(spark, tape, at("13:00:30"), baskets)))
    assert got["ab"]["flow_share"] == pytest.approx(0.4)
    inp = inputs(spark, tape, at("13:01:30"), baskets)
    got = by_basket(M.basket_frame(inp))
    assert (got["abc"]["concentration_symbol"], got["abc"]["concentration"]) == ("C", 0.6)
    assert (got["abc"]["concentration_day_symbol"], got["abc"]["concentration_day"]) == ("A", 900 / 1600)
    assert got["d"]["concentration"] is None and got["d"]["concentration_symbol"] is None
    assert got["ab"]["flow_share"] is None  # an empty window is a gap, not zero


def test_concentration_tie_goes_to_the_first_name(spark, tape):
    tape.trade("B", at("13:00:10"), 100, 1).trade("A", at("13:00:40"), 100, 1)
    got = by_basket(M.basket_frame(inputs(spark, tape, at("13:01:00"), dict(x=["B", "A"]))))
    assert (got["x"]["concentration_symbol"], got["x"]["concentration"]) == ("A", 0.5)


def test_cumulative_share(spark, tape):
    tape.trade("A", at("09:30:00"), 300, 1, [25]).trade("B", at("09:30:10"), 100, 1)
    baskets = dict(a=["A"], b=["B"])
    base = dict(tickers=ticker_profile(spark, dict(A=1, B=1)), baskets=basket_profile(spark, ["a", "b"]),
                floors=floors(spark))
    read = lambda hms: by_basket(M.basket_frame(inputs(spark, tape, at(hms), baskets, **base), baseline=True))["a"]
    assert read("09:29:59")["cum_share"] is None
    assert read("09:30:05")["cum_share"] == 1.0
    r = read("09:30:10")
    assert (r["cum_share"], r["cum_share_typ"], r["cum_share_z"]) == (0.75, None, None)
    for hms in ("09:31:05", "09:31:59"):
        r = read(hms)
        assert (r["cum_share_z"], r["cum_share_typ"]) == (4.0, 0.25)
    late = read("17:00:00")
    assert late["cum_share"] == 0.75 and late["key_minute"] == 959


def test_ten_day_gate(spark, tape):
    tape.trade("A", at("10:00:10"), 300, 1).trade("B", at("10:00:10"), 100, 1)
    kw = dict(tickers=ticker_profile(spark, dict(A=1, B=1)), floors=floors(spark))
    nine = basket_profile(spark, ["a"], days=9, cum_days=9)
    inp = inputs(spark, tape, at("10:01:00"), dict(a=["A"], b=["B"]), baskets=nine, **kw)
    r = by_basket(M.basket_frame(inp, baseline=True))["a"]
    assert (r["flow_share_z"], r["cum_share_z"], r["cum_share_typ"]) == (None, None, 0.25)
    ten = inp.with_(baskets=basket_profile(spark, ["a"], days=10, cum_days=10))
    assert by_basket(M.basket_frame(ten, baseline=True))["a"]["flow_share_z"] == 4.0


@pytest.fixture
def prices():
    t = Tape()
    flat = lambda s, hms, p: t.trade(s, at(hms), p, 1)
    for s in ("SPY", "A", "B", "C", "D"):
        flat(s, "09:30:00", 100)
    for m in ("31", "32", "33", "34"):
        flat("SPY", f"09:{m}:00", 100)
    flat("A", "09:31:30", 101)
    flat("B", "09:30:30", 99)
    flat("C", "09:30:40", 100.05)
    flat("D", "09:30:40", 101)
    flat("D", "09:33:30", 99)
    flat("L", "09:33:10", 50)
    flat("L", "09:33:40", 60)
    return t


def test_breadth(spark, prices):
    baskets = dict(five=["A", "B", "C", "D", "E"], al=["A", "L"], e=["E"])
    got = by_basket(M.basket_frame(inputs(spark, prices, at("09:34:05"), baskets), breadth=True))
    pick = lambda b: tuple(got[b][c] for c in ("breadth_up", "breadth_inline", "breadth_down"))
    assert pick("five") == (1, 3, 1) and pick("al") == (1, 1, 0) and pick("e") == (None, None, None)
    early = by_basket(M.basket_frame(inputs(spark, prices, at("09:32:05"), baskets), breadth=True))
    assert early["five"]["breadth_up"] is None
    no_mark = inputs(spark, prices, at("09:34:05"), baskets, benchmark="QQQ")
    assert by_basket(M.basket_frame(no_mark, breadth=True))["five"]["breadth_up"] is None
    status = M.benchmark_status(inputs(spark, prices, at("09:34:05"), baskets)).first()
    assert status["benchmark_return"] == 0.0


def test_volume_breadth(spark):
    t = Tape()
    t.trade("SPY", at("09:30:00"), 100, 1)
    per_minute = {"V": (202, 101), "X": (300, 100.05), "B": (150, 100), "M": (300, 100), "T": (300, 100), "W": (101, 101)}
    for s in per_minute:
        t.trade(s, at("09:30:00"), 100, 0.001)
    for m in ("31", "32", "33"):
        t.trade("SPY", at(f"09:{m}:00"), 100, 1)
        for s, (dollars, price) in per_minute.items():
            if s != "W" or m == "31":
                t.trade(s, at(f"09:{m}:05"), price, dollars / price)
    t.trade("L", at("09:33:05"), 202, 1)
    med = {s: 100 for s in "VWXBL"} | {"T": 0}
    baskets = dict(vwx=["V", "W", "X"], five=["V", "W", "X", "T", "M"], bl=["B", "L"], tm=["T", "M"])
    inp = inputs(spark, t, at("09:34:10"), baskets, tickers=ticker_profile(spark, med))
    got = by_basket(M.basket_frame(inp, volume=True))
    assert (got["vwx"]["up_on_vol"], got["vwx"]["breadth_up"]) == (1, 2)
    assert (got["five"]["vol_unusual"], got["five"]["vol_unmeasured"]) == (2, 2)
    assert (got["bl"]["vol_unusual"], got["bl"]["vol_unmeasured"]) == (0, 0)
    assert (got["tm"]["vol_unusual"], got["tm"]["up_on_vol"]) == (None, None)
    states = {r["symbol"]: r["vol_state"] for r in M.member_volume_states(inp).collect()}
    assert states["V"] == "unusual" and states["B"] == "normal" and states["M"] == "unmeasured"


def test_up_but_unmeasured_counts_only_below_the_line(spark):
    t = Tape()
    for s, p in (("SPY", 100), ("U", 101), ("N", 100)):
        t.trade(s, at("09:30:00"), 100, 1)
        for m in ("30", "31", "32", "33"):
            t.trade(s, at(f"09:{m}:30"), p, 1)
    inp = inputs(spark, t, at("09:34:00"), dict(x=["U", "N"]), tickers=ticker_profile(spark, dict(U=0, N=100)))
    r = by_basket(M.basket_frame(inp, volume=True))["x"]
    assert (r["up_on_vol"], r["breadth_up"], r["vol_unmeasured"]) == (0, 1, 1)


def test_premarket(spark):
    t = Tape().trade("B", at("04:00:00"), 100, 1, [12]).trade("C", at("07:00:00"), 600, 1, [12])
    t.trade("A", at("08:00:00"), 300, 1, [13]).trade("C", at("09:31:10"), 500, 1).trade("C", at("09:45:00"), 50, 1, [12])
    baskets = dict(ab=["A", "B"], abc=["A", "B", "C"], d=["D"])
    got = by_basket(M.basket_frame(inputs(spark, t, at("08:00:05"), baskets)))
    assert (got["ab"]["pre_vol"], got["ab"]["pre_share"]) == (400, 0.4)
    assert (got["abc"]["pre_conc_symbol"], got["abc"]["pre_conc"]) == ("C", 0.6)
    assert (got["d"]["pre_vol"], got["d"]["pre_conc"]) == (0, None)
    assert by_basket(M.basket_frame(inputs(spark, t, at("03:59:59"), baskets)))["ab"]["pre_vol"] is None
    assert by_basket(M.basket_frame(inputs(spark, t, at("12:00:00"), baskets)))["abc"]["pre_vol"] == 1000


def test_rank_switches_with_the_clock(spark):
    t = Tape().trade("A", at("08:00:00"), 900, 1, [12]).trade("B", at("08:00:00"), 100, 1, [12])
    t.trade("A", at("09:30:05"), 100, 1).trade("B", at("09:30:05"), 300, 1)
    kw = dict(tickers=ticker_profile(spark, dict(A=1, B=1)), baskets=basket_profile(spark, ["a", "b"]), floors=floors(spark))
    def order(hms):
        df = table.basket_table(inputs(spark, t, at(hms), dict(a=["A"], b=["B"]), **kw), "trader")
        return [r["basket"] for r in df.orderBy("row_rank").collect()]
    assert order("09:30:59") == ["a", "b"] and order("09:31:00") == ["b", "a"]


def test_member_without_baseline_is_an_error(spark, tape):
    tape.trade("A", at("10:00:00"), 1, 1)
    inp = inputs(spark, tape, at("10:01:00"), dict(a=["A", "Z"]), tickers=ticker_profile(spark, dict(A=1)))
    with pytest.raises(ValueError, match="Z"):
        table.basket_table(inp)


def test_table_says_when_the_session_has_no_data_around(spark, tape):
    tape.trade("A", at("10:00:00"), 1, 1).trade("A", at("11:00:00"), 1, 1)
    kw = dict(tickers=ticker_profile(spark, dict(A=1)), baskets=basket_profile(spark, ["a"]), floors=floors(spark))
    inp = inputs(spark, tape, at("10:30:00"), dict(a=["A"]), **kw)
    for hms, outside in (("09:59:59", 1), ("10:00:00", 0), ("10:30:00", 0), ("11:00:00", 0), ("11:00:01", 1)):
        assert table.basket_table(inp.with_(asof=M.asof_literal(spark, at(hms)))).first()["outside"] == outside
        assert table.basket_table(inp.at(at(hms))).first()["outside"] == outside


def test_benchmark_outside_the_universe_is_an_error(spark, tape):
    tape.trade("A", at("10:00:00"), 1, 1)
    inp = inputs(spark, tape, at("10:01:00"), dict(a=["A"]), tickers=ticker_profile(spark, dict(A=1)))
    with pytest.raises(ValueError, match="benchmark"):
        table.basket_table(inp.with_(universe=spark.createDataFrame([("A",)], "symbol string")))


def test_a_configuration_is_checked_once(spark, tape):
    tape.trade("A", at("10:00:00"), 1, 1)
    inp = inputs(spark, tape, at("10:01:00"), dict(a=["A"]), tickers=ticker_profile(spark, dict(A=1)))
    assert table.check_configuration(inp).with_(asof=inp.asof).checked and not inp.with_(benchmark="B").checked
    with pytest.raises(ValueError, match="no baseline"):
        table.check_configuration(inp.with_(members=members(spark, a=["A", "Z"])))


def test_registered_metric(spark, tape):
    tape.trade("A", at("10:00:00"), 5, 1).trade("A", at("10:00:30"), 5, 1)
    fn = lambda inp: inp.buckets.join(inp.members, "symbol").join(inp.asof, "session_date").groupBy(*M.KEYS, "basket").agg(F.sum("trades").alias("prints"))
    registry.register_metric("prints", fn)
    try:
        with pytest.raises(ValueError):
            registry.register_metric("prints", fn)
        inp = inputs(spark, tape, at("10:01:00"), dict(a=["A"]), tickers=ticker_profile(spark, dict(A=1)),
                     baskets=basket_profile(spark, ["a"]), floors=floors(spark))
        assert table.basket_table(inp, extra=["prints"]).first()["prints"] == 2
    finally:
        registry.unregister_metric("prints")


def window_metrics(windows=tuple(registry.WINDOWS)):
    """A metric for each window: a basket's share of prints in it, and its prints."""
    out = {}
    for w in windows:
        sums = {"n": (F.col("trades"), w)}
        out[f"prints {w}"] = registry.WindowMetric(sums, lambda basket, union: basket("n"))
        out[f"part {w}"] = registry.WindowMetric(sums, lambda basket, union: basket("n") / F.nullif(union("n"), F.lit(0.0)))
    return out


@pytest.fixture
def own_metrics():
    made = window_metrics()
    for name, m in made.items():
        registry.register_metric(name, m)
    yield list(made)
    for name in made:
        registry.unregister_metric(name)


def test_window_metrics_by_hand(spark, tape, own_metrics):
    for hms, symbol in (("08:00:00", "A"), ("09:40:00", "A"), ("10:00:10", "A"), ("10:00:20", "B"),
                        ("10:01:05", "B"), ("10:01:30", "A"), ("10:01:31", "A")):
        tape.trade(symbol, at(hms), 5, 1)
    inp = inputs(spark, tape, at("10:01:30"), dict(a=["A"], ab=["A", "B"], quiet=["Z"]), tickers=ticker_profile(spark, dict(A=1, B=1, Z=1)),
                 baskets=basket_profile(spark, ["a"]), floors=floors(spark))
    got = by_basket(table.basket_table(inp, extra=own_metrics))
    counts = {w: (got["a"][f"prints {w}"], got["ab"][f"prints {w}"]) for w in registry.WINDOWS}
    assert counts == {"previous_bar": (1, 2), "current_bar": (1, 2), "since_open": (3, 5), "completed": (2, 3), "pre_market": (1, 1)}
    assert got["a"]["part since_open"] == 0.6 and got["quiet"]["part since_open"] == 0.0
    early = by_basket(table.basket_table(inp.with_(asof=M.asof_literal(spark, at("05:00:00"))), extra=own_metrics))
    assert early["a"]["part pre_market"] is None  # 0/0 is a gap


def test_window_metrics_read_nothing_of_their_own(spark, tape, own_metrics):
    tape.trade("A", at("10:00:00"), 5, 1)
    kw = dict(tickers=ticker_profile(spark, dict(A=1)), baskets=basket_profile(spark, ["a"]), floors=floors(spark))
    inp = inputs(spark, tape, at("10:01:00"), dict(a=["A"]), **kw)

    def reads(df):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        return text.count("LogicalRDD"), text.count("Aggregate ["), text.count("Join ")

    assert reads(table.basket_table(inp, extra=own_metrics)) == reads(table.basket_table(inp))
    assert reads(table.basket_series(inp, extra=own_metrics)) == reads(table.basket_series(inp))


def test_window_metrics_are_checked(spark, tape, own_metrics):
    with pytest.raises(ValueError, match="next_bar"):
        registry.WindowMetric({"n": (F.col("trades"), "next_bar")}, lambda basket, union: basket("n"))
    tape.trade("A", at("10:00:00"), 5, 1)
    inp = inputs(spark, tape, at("10:01:00"), dict(a=["A"]), tickers=ticker_profile(spark, dict(A=1)))
    with pytest.raises(ValueError, match="kept windows"):
        table.basket_table(inp.with_(windows=M.member_windows), extra=own_metrics)
    registry.register_metric("joined", lambda inp: inp.asof)
    try:
        with pytest.raises(ValueError, match="joined"):
            table.basket_series(inp, extra=["joined"])
    finally:
        registry.unregister_metric("joined")


@pytest.mark.parametrize("step", [20, 60])
def test_series_equals_single_renders(spark, step, own_metrics):
    import random

    rnd, t = random.Random(5), Tape()
    for _ in range(1500):
        pre = rnd.random() < 0.2
        sec = at("04:00:00") + rnd.randrange(19800) if pre else at("09:29:00") + rnd.randrange(23600)
        t.trade(rnd.choice(["A", "B", "C", "SPY"]), sec, 90 + rnd.randrange(20), rnd.randrange(1, 50),
                rnd.choice([[], [], [12], [25], [37]]))
    kw = dict(tickers=ticker_profile(spark, dict(A=500, B=0, C=100)), baskets=basket_profile(spark, ["x", "y"]), floors=floors(spark))
    inp = inputs(spark, t, at("10:00:00"), dict(x=["A", "B"], y=["B", "C"]), **kw)
    inp = inp.with_(buckets=inp.buckets.cache())
    series = table.basket_series(inp, step, "dev", 560, 965, own_metrics[1::2]).cache()
    clock = table.series_clock(inp.asof.select("session_date"), step, 560, 965)
    single = table.basket_table(inp.with_(asof=clock), "dev", extra=own_metrics[1::2])
    rounded = lambda df: df.select(*[F.round(f"`{c}`", 9).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
    a, b = rounded(series), rounded(single)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_changes_hold_the_whole_series(spark):
    import random

    rnd, t = random.Random(8), Tape()
    for _ in range(60):
        t.trade(rnd.choice(["A", "B", "SPY"]), at("09:30:00") + rnd.randrange(600), 10, rnd.randrange(1, 9))
    kw = dict(tickers=ticker_profile(spark, dict(A=500, B=9)), baskets=basket_profile(spark, ["x", "y"]), floors=floors(spark))
    inp = inputs(spark, t, at("10:00:00"), dict(x=["A", "B"], y=["B"]), **kw)
    series = {(r.at_sec, r.basket): r for r in table.basket_series(inp, 1, "trader", 569, 585).collect()}
    changed = {(r.at_sec, r.basket): r for r in table.basket_changes(inp, 1, "trader", 569, 585).collect()}
    assert len(changed) < len(series) // 3
    now = {}
    for key in sorted(series):
        now[key[1]] = changed.get(key, now.get(key[1]))
        assert now[key[1]][2:] == series[key][2:], key


def test_series_repeats_no_member_for_a_second(spark, tape):
    tape.trade("A", at("10:00:00"), 5, 1).trade("SPY", at("10:00:00"), 5, 1)
    kw = dict(tickers=ticker_profile(spark, dict(A=1)), baskets=basket_profile(spark, ["a"]), floors=floors(spark))
    inp = inputs(spark, tape, at("10:01:00"), dict(a=["A"]), **kw)
    text = table.basket_series(inp, 1)._jdf.queryExecution().optimizedPlan().toString()
    clocks = [line for line in text.split("\n") if "Generate explode(sequence(" in line]
    assert sum("Some(1)" in c for c in clocks) == 1  # the baskets' seconds
    assert sum("Some(60)" in c for c in clocks) == len(clocks) - 1  # members meet bars only


def test_shares_stay_within_one(spark, tape):
    for i in range(50):
        tape.trade("AB"[i % 2], at("10:00:00") + i, 10 + i, 1 + i % 3)
    r = by_basket(M.basket_frame(inputs(spark, tape, at("10:00:45"), dict(a=["A"], all=["A", "B"]))))
    assert r["all"]["flow_share"] == pytest.approx(1.0) and 0 <= r["a"]["flow_share"] <= 1
