import math

import pytest
from conftest import et
from pyspark.sql import functions as F

from tickerloom.functions import conditions as C
from tickerloom.functions import display
from tickerloom.functions import session as S
from tickerloom.functions.stats import padded, with_robust, zguard
from tickerloom.schema import CLASSES, RANK


@pytest.mark.parametrize(
    "text, ids, over",
    [
        ("", [], 0),
        (None, [], 0),
        ("14", [14], 0),
        ("14,12,37,41", [14, 12, 37, 41], 0),
        (" 14, 12 ", [14, 12], 0),
        ("14;12 37", [14, 12, 37], 0),
        ("14,x,37", [14, -1, 37], 0),
        ("1,2,3,4,5,6,7,8,9,10", [1, 2, 3, 4, 5, 6, 7, 8], 1),
    ],
)
def test_parse_conditions(spark, text, ids, over):
    parsed = C.parse_conditions("c")
    row = spark.createDataFrame([(text,)], "c string").select(
        C.cap_conditions(parsed).alias("ids"), C.overflowed(parsed).alias("over")
    )
    assert row.first() == (ids, over)


def test_class_of_every_id_and_every_pair(spark):
    # Fixed values, written out here: ids of ranks 1 to 7, and ids of rank 8.
    lists = (
        "7 12 13 15 16 20 29 38", "2", "5 10 21 22 32 33 52 53", "18 28", "17 25 55", "8 19", "9 24",
        "1 3 4 6 11 14 23 27 30 31 34 35 36 37 41 57 58 59 60 62 63 64 65 66 67 68 69 70 71",
    )
    known = {int(i): k for k, ids in enumerate(lists, 1) for i in ids.split()}
    assert len(known) == 40 + 15
    rank = lambda i: known.get(i, 0)
    cases = [[]] + [[i] for i in range(-1, 75)]
    cases += [[a, b] for a in range(0, 73, 2) for b in range(1, 73, 3)]
    cases += [[37] * 8 + [a] for a in range(75)] + [[37] * 20]  # every id counts, however many there are
    df = spark.createDataFrame([(c,) for c in cases], "conditions array<int>")
    for conditions, got in df.select("conditions", C.classify("conditions")).collect():
        assert got == min([rank(i) for i in conditions], default=8), conditions


def test_unknown_ids_names_and_lateness(spark):
    rows = [([99, 98, 99, 41],), ([5],), ([30],), ([31, 9],), ([37],)]
    df = spark.createDataFrame(rows, "conditions array<int>").withColumn("r", C.classify("conditions"))
    got = df.select(
        C.unknown_ids("conditions"), C.class_name("r"), C.monitor_lateness("r", "conditions")
    ).collect()
    assert [tuple(r) for r in got] == [
        ([99, 98, 99], "UNKNOWN", False),
        ([], "NON_PRICE_FORMING", True),
        ([], "CONTINUOUS", True),
        ([], "BLOCK", False),
        ([], "CONTINUOUS", False),
    ]
    assert CLASSES[8] == "continuous"


def test_quote_conditions_take_an_int_or_an_array(spark):
    rows = [("1",), ("[14,37]",), (None,), ("{}",), ("[1,2,3,4,5,6,7,8,9]",)]
    got = spark.createDataFrame(rows, "c string").select(C.quote_conditions("c")).collect()
    assert [r[0] for r in got] == [[1], [14, 37], [], [], list(range(1, 9))]


def test_minutes_across_daylight_saving(spark):
    a, b = et("2026-10-30", "09:35:30"), et("2026-11-02", "09:35:30")
    df = spark.createDataFrame([(a,), (b,)], "sec bigint").withColumn("d", S.et_date("sec"))
    rows = df.select(
        S.minute_of_day("sec"), S.bucket_start("d", 575), F.col("d").cast("string"), S.minute_start("sec")
    ).collect()
    assert [r[0] for r in rows] == [575, 575]
    assert rows[1][1] - rows[0][1] == 3 * 86400 + 3600
    assert [r[2] for r in rows] == ["2026-10-30", "2026-11-02"]
    assert rows[0][3] == a - 30


def test_minute_out_of_range_fails(spark):
    df = spark.createDataFrame([(1440,)], "m int").withColumn("d", F.lit("2026-01-02").cast("date"))
    with pytest.raises(Exception, match="out of range"):
        df.select(S.bucket_start("d", "m")).collect()


def test_bars_align_to_the_open(spark):
    df = spark.createDataFrame([(570,), (599,), (600,), (569,)], "m int")
    assert [r[0] for r in df.select(S.bar_minute("m", 30)).collect()] == [570, 570, 600, 540]
    with pytest.raises(ValueError):
        S.check_bar(7)


INF, NAN = math.inf, math.nan


@pytest.mark.parametrize(
    "value, center, sigma, floor, want",
    [
        (10.0, 4.0, 3.0, 1.0, 2.0),
        (10.0, 4.0, 1.0, 3.0, 2.0),
        (105.0, 100.0, 0.0, 2.0, 2.5),
        (500.0, 100.0, 0.0, 20.0, 20.0),
        (95.0, 100.0, 0.0, 2.0, -2.5),
        (5.0, 5.0, 1.0, 0.0, 0.0),
        (5.0, 4.0, 0.0, 0.0, None),
        (5.0, 4.0, -1.0, 0.0, None),
        (5.0, 4.0, -1.0, 2.0, 0.5),
        (NAN, 4.0, 1.0, 1.0, None),
        (5.0, NAN, 1.0, 1.0, None),
        (5.0, 4.0, NAN, 1.0, None),
        (5.0, 4.0, 1.0, NAN, None),
        (INF, 4.0, 1.0, 1.0, None),
        (5.0, -INF, 1.0, 1.0, None),
        (5.0, 4.0, INF, 1.0, None),
        (1e308, -1e308, 1.0, 1.0, None),
    ],
)
def test_zguard(spark, value, center, sigma, floor, want):
    df = spark.createDataFrame([(value, center, sigma, floor)], "v double, c double, s double, f double")
    assert df.select(zguard("v", "c", "s", "f")).first()[0] == want


def test_robust_and_padding(spark):
    df = spark.createDataFrame([([300.0, 100.0, 200.0],), (None,)], "a array<double>")
    out = with_robust(df.select(padded("a", F.lit(5)).alias("a")), a=("m", "s")).collect()
    assert out[0]["m"] == 100 and out[0]["s"] == pytest.approx(148.26)
    assert tuple(out[1]) == (0.0, 0.0)
    even = with_robust(spark.createDataFrame([([1.0, 2.0, 4.0, 10.0],)], "a array<double>"), a=("m", "s"))
    assert even.first()["m"] == 3 and even.first()["s"] == pytest.approx(1.4826 * 1.5)
    none = with_robust(spark.createDataFrame([([],)], "a array<double>"), a=("m", "s"))
    assert tuple(none.first()) == (0.0, 0.0)


def test_display(spark):
    values = [(0.0,), (550.0,), (1500.0,), (53.3e6,), (371e6,), (1.23e9,), (680e3,)]
    df = spark.createDataFrame(values, "v double")
    got = df.select(display.fmt_dollars("v"), display.fmt_usd("v")).collect()
    assert [r[0] for r in got] == ["0", "550", "1.50k", "53.3M", "371M", "1.23B", "680k"]
    assert [r[1] for r in got] == ["$0", "$550", "$2K", "$53.3M", "$371.0M", "$1.2B", "$680K"]


def test_flags(spark):
    df = spark.createDataFrame([(2.0, 7, 0, 10, 0.0011), (-2.0, 8, 0, 10, -0.0011), (1.9, 1, 9, 10, 0.001)],
                               "z double, up int, down int, n int, r double")
    got = df.select(display.z_flag("z"), display.breadth_flag("up", "down", "n"), display.benchmark_flag("r"))
    assert [tuple(r) for r in got.collect()] == [
        ("green", None, "green"),
        ("red", "green", "red"),
        (None, "red", "yellow"),
    ]
