import datetime as dt

import pytest
from conftest import Tape, et

from tickerloom.operators import baselines as BL
from tickerloom.operators import rolling
from tickerloom.operators import buckets as B
from tickerloom.sources import store

DAYS = ["2026-08-05", "2026-08-06", "2026-08-07", "2026-08-10", "2026-08-12"]


def dates(names):
    return [dt.date.fromisoformat(d) for d in names]


def symbols(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def members(spark, **baskets):
    rows = [(b, s) for b, names in baskets.items() for s in names]
    return spark.createDataFrame(rows, "basket string, symbol string")


@pytest.fixture(scope="module")
def nvda(spark):
    t = Tape()
    for day, shares in zip(DAYS, (100, 200, 300, 0, 0)):
        at = et(day, "09:35:10")
        if shares:
            t.trade("NVDA", at, 10, shares)
        t.trade("NVDA", at, 10, 999999, [17]).trade("NVDA", at, 10, 888888, [2])
    return B.bucketize(t.frame(spark)).cache()


def test_ticker_profile(spark, nvda):
    p = BL.ticker_profile(nvda, symbols(spark, "NVDA", "SPY"), dates(DAYS)).cache()
    assert p.count() == 780
    r = p.filter("symbol = 'NVDA' AND minute_of_day = 575").first()
    assert (r["days"], r["median_shares"], r["median_dollars"]) == (5, 100, 1000)
    assert r["sigma_shares"] == pytest.approx(148.26)
    quiet = p.filter("symbol = 'SPY' AND median_shares = 0 AND sigma_dollars = 0 AND days = 5")
    assert quiet.count() == 390
    shape = store.check_profile_shape(p, "symbol").collect()
    assert all(r["ok"] for r in shape)


def test_input_sessions_are_checked(spark, nvda):
    s = symbols(spark, "NVDA")
    with pytest.raises(ValueError, match="no input"):
        BL.ticker_profile(nvda, s, [])
    with pytest.raises(ValueError, match="duplicate"):
        BL.ticker_profile(nvda, s, dates(DAYS[:1] * 2))
    with pytest.raises(ValueError, match="2026-08-13"):
        BL.check_sessions_have_data(nvda, dates(["2026-08-05", "2026-08-13"]))
    assert BL.regular_dates(nvda, 2) == dates(["2026-08-10", "2026-08-12"])
    assert BL.regular_dates(nvda, 1, through=dt.date(2026, 8, 6)) == dates(["2026-08-06"])


@pytest.fixture(scope="module")
def shares(spark):
    """Five days of A/C at 09:35, one silent 09:35, one day without C."""
    t = Tape()
    split = dict(zip(DAYS, ((30, 70), (40, 60), (50, 50), (60, 40), (70, 30))))
    for day in DAYS + ["2026-08-13", "2026-08-11"]:
        t.trade("A", et(day, "09:30:00"), 10, 1, [25])
        t.trade("A", et(day, "16:00:00"), 500, 1, [19])
        a, c = split.get(day, (0, 0))
        if a:
            t.trade("A", et(day, "09:35:05"), a, 1).trade("C", et(day, "09:35:06"), c, 1)
        for s in "ABC":
            if not (day == "2026-08-11" and s == "C"):
                t.trade(s, et(day, "09:36:00"), 1, 1)
    return B.bucketize(t.frame(spark)).cache()


def test_basket_profile(spark, shares):
    m = members(spark, flat=["B"], x=["A", "B"], y=["C"])
    all_days = dates(DAYS + ["2026-08-13", "2026-08-11"])
    skipped = BL.skipped_days(shares, m, all_days).collect()
    assert [(str(r["session_date"]), r["uncovered"]) for r in skipped] == [("2026-08-11", ["C"])]
    p = BL.basket_profile(shares, m, all_days).filter("basket = 'x'").cache()
    at = {r["minute_of_day"]: r for r in p.collect()}
    assert len(at) == 390
    assert (at[575]["days"], at[575]["median_share"]) == (5, 0.5)
    assert at[575]["sigma_share"] == pytest.approx(1.4826 * 0.1)
    assert at[576]["days"] == 6 and at[576]["median_share"] == pytest.approx(2 / 3)
    assert (at[600]["days"], at[600]["median_share"]) == (0, 0.0)
    assert at[575]["cum_days"] == 6  # the opening cross already defines the share
    days = BL.basket_day_shares(shares, m, dates(DAYS))
    got = [r["cum_share"] for r in days.filter("basket = 'x' AND minute_of_day = 575").orderBy("session_date").collect()]
    assert got == pytest.approx([40 / 110, 50 / 110, 60 / 110, 70 / 110, 80 / 110])
    assert at[600]["median_cum_share"] == at[576]["median_cum_share"]
    assert at[600]["cum_days"] == 6 and at[575]["members"] == ["A", "B"]


def test_basket_profile_round_trip_and_stale_members(spark, shares, tmp_path):
    m = members(spark, x=["A", "B"], y=["C"])
    path = str(tmp_path / "p")
    store.write_table(BL.basket_profile(shares, m, dates(DAYS)), path)
    assert store.read_basket_profile(spark, path, m).count() == 780
    with pytest.raises(ValueError, match="stale"):
        store.read_basket_profile(spark, path, members(spark, x=["A"], y=["C"]))
    with pytest.raises(ValueError, match="z"):
        store.read_basket_profile(spark, path, members(spark, x=["A", "B"], y=["C"], z=["A"]))


def test_floors(spark):
    rows = [(f"T{i}", m, 5, 1.0, float(s), 1.0, float(10 * s)) for i, s in enumerate((0, 40, 80, 120, 160)) for m in (570, 765)]
    tick = spark.createDataFrame(rows, "symbol string, minute_of_day int, days int, median_shares double, sigma_shares double, median_dollars double, sigma_dollars double")
    r = BL.volume_floors(tick, 0.25, 195).filter("minute_of_day = 570").first()
    assert (r["sigma_floor_shares"], r["sigma_floor_dollars"]) == (20, 200)
    rows = [("a", 570, 3, 0.5, 0.2, 3, 0.5, 0.1), ("b", 570, 0, 0.0, 9.0, 1, 0.5, 0.3), ("a", 571, 0, 0.0, 0.0, 0, 0.0, 0.0)]
    bask = spark.createDataFrame(rows, "basket string, minute_of_day int, days int, median_share double, sigma_share double, cum_days int, median_cum_share double, sigma_cum_share double")
    got = {r["minute_of_day"]: tuple(r)[1:] for r in BL.share_floors(bask, 0.5).collect()}
    assert got[570] == pytest.approx((0.1, 0.1)) and got[571] == (0.0, 0.0)
    for bad in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            BL.volume_floors(tick, bad)


def test_empty_and_short_profiles_give_no_floors(spark, tmp_path):
    schema = "symbol string, minute_of_day int, days int, median_shares double, sigma_shares double, median_dollars double, sigma_dollars double"
    full = [(s, m, 5, 1.0, 1.0, 1.0, 1.0) for s in "AB" for m in (570, 765)]
    assert BL.volume_floors(spark.createDataFrame(full, schema), bar_minutes=195).count() == 2
    for rows in ([], full[:-1], full[::2]):
        with pytest.raises(Exception, match="without bar"):
            BL.volume_floors(spark.createDataFrame(rows, schema), bar_minutes=195).collect()
    none = spark.createDataFrame([], schema)
    store.write_table(none, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no rows"):
        store.read_ticker_profile(spark, str(tmp_path / "t"))
    floors = spark.createDataFrame([], "minute_of_day int, sigma_floor_shares double, sigma_floor_dollars double, sigma_floor_flowshare double, sigma_floor_cumshare double")
    store.write_floors(floors, str(tmp_path / "f"), 0.25, "none")
    with pytest.raises(ValueError, match="no rows"):
        store.read_floors(spark, str(tmp_path / "f"))


def test_incomplete_tables_are_refused(spark, nvda, tmp_path):
    p = BL.ticker_profile(nvda, symbols(spark, "NVDA"), dates(DAYS))
    path = str(tmp_path / "p")
    store.write_table(p.filter("minute_of_day <> 700"), path)
    with pytest.raises(ValueError, match="contiguous"):
        store.read_ticker_profile(spark, path)


def test_session_discovery(spark):
    names = ["2026-08-10.csv", "2026-08-10.csv.gz", "2026-08-10.trades-only.csv", "2026-08-11.trades-only.csv.gz",
             "2026-08-12.partial.csv", "2026-08-13.csv.gz", "notes.txt", "2026-99-99.csv"]
    files = spark.createDataFrame([(f"file:/b/{n}",) for n in names], "path string")
    cat = store.bucket_catalog(files)
    got = [r["path"][8:] for r in store.discover_sessions(cat, 10).collect()]
    assert got == ["2026-08-10.csv", "2026-08-11.trades-only.csv.gz", "2026-08-13.csv.gz"]
    got = [str(r["session_date"]) for r in store.discover_sessions(cat, 1, "2026-08-12").collect()]
    assert got == ["2026-08-11"]
    with pytest.raises(ValueError):
        store.check_discovered(store.discover_sessions(cat, 1, "2020-01-01"))


def test_a_failed_rebuild_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda: sorted(r[0] for r in spark.read.parquet(store.table_path(spark, path)).collect())
    with pytest.raises(ValueError, match="no finished build"):
        store.table_path(spark, path)
    for n in (1, 2, 3):
        store.write_table(spark.range(n), path)
        assert rows() == list(range(n))
    with pytest.raises(Exception):
        store.write_table(spark.range(3).selectExpr("raise_error('broken') AS id"), path)
    assert rows() == [0, 1, 2]
    assert len(list((tmp_path / "t/data").glob("build=*"))) <= 3  # last, the one before, the broken one


def test_rolling_baselines_equal_full_builds(spark, tmp_path):
    import datetime as dt
    import random

    r, t = random.Random(6), Tape()
    days = [str(dt.date(2026, 8, 3) + dt.timedelta(days=k)) for k in range(24)]
    for day in days:
        for s in ("A", "B", "C"):
            for _ in range(4):
                t.trade(s, et(day, "09:30:00") + r.randrange(4) * 5400 + r.randrange(60), 10, r.randrange(1, 9))
    rows, m = B.bucketize(t.frame(spark)).cache(), members(spark, x=["A", "B"], y=["C"])
    samples = rolling.SampleStore(str(tmp_path / "s"), lookback=4, bar_minutes=195)
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect())
    for k, day in enumerate(dates(days)):
        stay = samples.roll(rows, day)
        assert [str(d) for d in stay] == days[max(0, k - 3) : k + 1]
        assert len(list((tmp_path / "s").glob("session_date=*"))) == len(stay)
        if k in (0, 3, 4, 23):
            full = BL.ticker_profile(rows, symbols(spark, "A", "B", "C"), stay, 195)
            assert shown(samples.ticker_profile(spark, symbols(spark, "A", "B", "C"))) == shown(full)
            assert shown(samples.basket_profile(spark, m)) == shown(BL.basket_profile(rows, m, stay, 195))
    assert samples.roll(rows, dates(days)[-1]) == stay  # a repeated night changes nothing
    plan = BL.session_bars(BL.of_dates(rows, stay[-1:]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("session_date") and days[-2] not in plan
    with pytest.raises(ValueError, match="no data"):
        samples.roll(rows, dt.date(2026, 9, 30))
