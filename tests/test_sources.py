import gzip
import json

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import session as S
from tickerloom.operators import buckets as B
from tickerloom.sources import capture, config, flat, landed, store

TRADES = """Size,TICKER, price ,conditions,exchange,tape,participant_timestamp,sip_timestamp,sequence_number,trf_id
12.75,WIDG,8.125,"14,37",4,3,900,1000,1,x
10,WIDG,8.5,,4,3,,2000,2,
7,BOLT,300,,4,3,,3000,3,
"""
QUOTES = """ask_price,ask_size,ticker,bid_price,bid_size,ask_exchange,bid_exchange,conditions,sequence_number,sip_timestamp
77.13,1,KITE,77.11,1,1,1,,1,1000
77.2,2.9,KITE,77.19,4,1,1,1,2,2000
7q.4,,KITE,77.21,4,1,1,,3,3000
"""


def universe(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def write(path, text):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


@pytest.mark.parametrize("name", ["t.csv", "t.csv.gz"])
def test_trades(spark, tmp_path, name):
    path = write(tmp_path / name, TRADES)
    u = universe(spark, "WIDG", "SPY")
    rows = flat.read_trades_flat(spark, path, u).orderBy("sip_ns").collect()
    assert [(r["symbol"], r["price"], r["size"], r["part_ns"], r["conditions"]) for r in rows] == [
        ("WIDG", 8.125, 12.75, 900, [14, 37]),
        ("WIDG", 8.5, 10.0, 0, []),
    ]
    s = flat.flat_stats(flat.read_flat_annotated(spark, path, "trade", u)).first()
    assert (s["rows"], s["submitted"], s["filtered"], s["windowed"], s["malformed"]) == (3, 2, 1, 0, 0)
    assert B.bucketize(flat.read_trades_flat(spark, path)).count() == 2


def test_quotes_window_and_malformed(spark, tmp_path):
    path = write(tmp_path / "q.csv", QUOTES)
    rows = flat.read_quotes_flat(spark, path).orderBy("sip_ns").collect()
    assert [(r["ask_price"], r["ask_size"]) for r in rows] == [(77.13, 1), (77.2, 2), (0.0, 0)]
    s = flat.flat_stats(flat.read_flat_annotated(spark, path, "quote")).first()
    assert (s["submitted"], s["malformed"]) == (3, 1)
    s = flat.flat_stats(flat.read_flat_annotated(spark, path, "quote", None, 1000, 3000)).first()
    assert (s["submitted"], s["windowed"], s["malformed"]) == (2, 1, 0)
    assert flat.read_quotes_flat(spark, path, None, 1000, 3000).count() == 2


def test_missing_column_is_an_error(spark, tmp_path):
    path = write(tmp_path / "t.csv", TRADES.replace("TICKER", "name"))
    with pytest.raises(ValueError, match="ticker"):
        flat.read_trades_flat(spark, path)


T = '{"ev":"T","sym":"WIDG","x":4,"p":41.07,"s":3.25,"c":[14,37],"t":1786790411377,"pt":1786790411305,"q":7,"z":3,"trfi":202,"new":1}'
Q = '{"ev":"Q","sym":"WIDG","bx":1,"bp":41.06,"bs":100,"ax":2,"ap":41.09,"as":500,"c":1,"t":1786790411399,"q":8,"z":3}'
STATUS = '{"ev":"status","message":"ok"}'


def decoded(spark, tmp_path, lines, u=None):
    path = write(tmp_path / "c.jsonl", "\n".join(lines))
    records = capture.read_capture(spark, path)
    return records, capture.decode_events(capture.explode_frames(records), u)


def test_frame(spark, tmp_path):
    _, d = decoded(spark, tmp_path, [f"17 [{Q},{T},{STATUS}]"])
    s = capture.capture_stats(d).first()
    assert (s["trades"], s["quotes"], s["status"], s["unknown"], s["decode_errs"]) == (1, 1, 1, 0, 0)
    t = capture.capture_trades(d).first()
    assert (t["sip_ns"], t["part_ns"], t["size"]) == (1786790411377 * 10**6, 1786790411305 * 10**6, 3.25)
    assert (t["conditions"], t["seq"], int(t["arrival"])) == ([14, 37], 7, 17 * 10**9 + 1)
    q = capture.capture_quotes(d).first()
    assert (q["bid_price"], q["bid_size"], q["ask_price"], q["ask_size"]) == (41.06, 100, 41.09, 500)
    assert q["conditions"] == [1]


def test_torn_lines_are_skipped_and_bad_events_counted(spark, tmp_path):
    lines = ["", "nospace", f"x1 [{T}]", f"18 [{T[:40]}", ' 19 []', f"20 [{T.replace('WIDG', 'BOLT')}]",
             '21 {"ev":"T"}', f'22 [{T.replace("41.07", json.dumps("abc"))},5,{STATUS}]', "23 []", f"24 [{T}"]
    records, d = decoded(spark, tmp_path, lines, universe(spark, "WIDG"))
    assert sorted(r["recv_ns"] for r in records.collect()) == [20, 21, 22, 23]
    s = capture.capture_stats(d).first()
    assert (s["trades"], s["unknown"], s["status"], s["decode_errs"]) == (0, 1, 1, 3)


def test_skipped_lines_are_counted_by_the_job_that_reads(spark, tmp_path):
    from pyspark.sql import Observation

    lines = ["", f"17 [{T}]", f"18 [{T[:40]}", "x1 []", "19 []", "nospace"]
    path = write(tmp_path / "c.jsonl", "\n".join(lines))
    seen = Observation("lines")
    assert capture.read_capture(spark, path, seen).count() == 2
    assert seen.get == {"lines": 6, "skipped": 4} == capture.line_stats(spark.read.text(path)).first().asDict()
    stream = capture.stream_capture(spark, str(tmp_path), observe="lines")
    out = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ckpt"))
    query = out.trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(p.observedMetrics["lines"]) for p in query.recentProgress if p.numInputRows] == [(6, 4)]


def test_too_many_conditions(spark, tmp_path):
    many = T.replace("[14,37]", "[1,3,4,6,11,14,23,27,30]")
    _, d = decoded(spark, tmp_path, [f"17 [{many}]"])
    assert capture.capture_stats(d).first()["cond_overflow"] == 1
    assert capture.capture_trades(d).first()["conditions"] == [1, 3, 4, 6, 11, 14, 23, 27]


def test_peek(spark, tmp_path):
    plain = T.replace("[14,37]", "[]")
    _, d = decoded(spark, tmp_path, [f"18 [{T}]", f"17 [{plain},{Q}]", f"19 [{T.replace('WIDG', 'A')}]"])
    assert [r["recv_ns"] for r in capture.peek(d, 2).collect()] == [17, 18]
    assert [r["recv_ns"] for r in capture.peek(d, 5, "WIDG", True).collect()] == [18]


def test_configuration(spark, tmp_path):
    cfg = {
        "benchmarks": {"index": ["SPY", "QQQ"], "bond_gate_futures": ["ZN"]},
        "baskets": {"b": {"members": ["Y", "X", "Y"], "note": "n"}, "a": {"members": ["X"]}},
    }
    path = write(tmp_path / "c.json", json.dumps(cfg, indent=1))
    got = [tuple(r) for r in config.load_baskets(spark, path).collect()]
    assert got == [("a", "X"), ("b", "X"), ("b", "Y")]
    u = config.load_universe(spark, path)
    assert [r["symbol"] for r in u.collect()] == ["QQQ", "SPY", "X", "Y"]
    config.check_members_known(config.load_baskets(spark, path), u)
    with pytest.raises(ValueError, match="Y"):
        config.check_members_known(config.load_baskets(spark, path), universe(spark, "X"))
    for bad, match in (({"baskets": {"a": {"members": []}}}, "no members"), ({"baskets": {}}, "no baskets")):
        with pytest.raises(ValueError, match=match):
            config.load_baskets(spark, write(tmp_path / f"{match}.json", json.dumps(bad)))
    with pytest.raises(ValueError, match="empty"):
        config.load_universe(spark, write(tmp_path / "e.json", json.dumps({"baskets": {}})))


def test_unlisted_symbols(spark):
    ref = spark.createDataFrame([("A", "stocks", True), ("B", "otc", False), ("C", "stocks", False)],
                                "symbol string, market string, active boolean")
    got = config.unlisted_symbols(universe(spark, "A", "B", "C", "D"), ref).collect()
    assert sorted(map(tuple, got)) == [("B", "inactive"), ("B", "market"), ("C", "inactive"), ("D", "missing")]


def test_session_files_are_found_in_a_real_folder(spark, tmp_path):
    for name in ("2026-08-10.csv", "2026-08-10.csv.gz", "2026-08-11.trades-only.csv", "2026-08-12.partial.csv", "2026-08-13.csv.gz", "notes.txt"):
        (tmp_path / name).write_text("x")
    files = store.list_bucket_files(spark, str(tmp_path))
    found = store.discover_sessions(store.bucket_catalog(files), 2).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["2026-08-11.trades-only.csv", "2026-08-13.csv.gz"]
    with pytest.raises(ValueError, match="no bucket files"):
        store.check_discovered(store.discover_sessions(store.bucket_catalog(files), 2, through="2026-01-01"))


def test_a_store_without_a_column_is_refused(spark, tape, tmp_path):
    rows = B.bucketize(tape.trade("A", 1, 1, 1).frame(spark))
    rows.drop("last_price").write.partitionBy("session_date").parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="last_price"):
        store.read_buckets(spark, str(tmp_path / "b"))


def scanned(df):
    """(rows that the scan gave, its pushed filters) of a collected frame without a shuffle."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    leaf = plan.collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value(), leaf.toString()


def test_windows_and_universes_reach_the_scan(spark, tmp_path):
    rows = [(f"S{k % 50:02d}", 1_786_700_000 * 10**9 + k * 10**9, k) for k in range(40_000)]
    rows += [("ODD", 1_786_700_000 * 10**9 + 5, -1)]
    tape = spark.createDataFrame(rows, "symbol string, sip_ns bigint, arrival bigint")
    tape = tape.withColumn("session_date", S.et_date("sip_ns div 1000000000"))
    path = str(tmp_path / "t")
    landed.land_tape(tape, path, row_group=16 << 10)
    assert landed.read_landed(spark, path).count() == len(rows)
    low, high = rows[9_000][1], rows[9_500][1]
    window = landed.read_landed(spark, path, None, low, high)
    assert sorted(r.arrival for r in window.collect()) == list(range(9_000, 9_500))
    read, text = scanned(window)
    assert "GreaterThanOrEqual(sip_ns" in text and "LessThan(sip_ns" in text and read < 6_000
    one = landed.read_landed(spark, path, universe(spark, "ODD"))
    assert one.count() == 1
    read, text = scanned(one)
    assert "symbol" in text.split("PushedFilters")[1] and read < 6_000  # the other files have no such symbol
    many = spark.createDataFrame([(f"S{k:02d}",) for k in range(80)], "symbol string")
    assert landed.read_landed(spark, path, many).count() == 40_000
    landed.land_tape(tape.filter("arrival < 0"), path)  # its session is replaced, the others stay
    first = tape.filter("arrival < 0").first().session_date
    assert landed.read_landed(spark, path).count() == 1 + tape.filter(F.col("session_date") != F.lit(first)).count()


def test_captured_times_are_whole_milliseconds(spark):
    from tickerloom.plans import source_queries

    first, n = 1_704_154_120_618, 2000  # divided as doubles, some of these come out less
    row = dict(symbol="S1", exchange=1, price=1.0, size=1.0, conditions=[1], seq=1, tape=1)
    row |= dict(bid_exch=1, bid_price=1.0, bid_size=1, ask_exch=1, ask_price=1.0, ask_size=1)
    ms = spark.range(first, first + n)
    for k, v in row.items():
        ms = ms.withColumn(k, F.array(*map(F.lit, v)) if k == "conditions" else F.lit(v))
    ms = ms.withColumns({"sip_ns": F.col("id") * 1_000_000, "part_ns": F.col("id") * 1_000_000 + 999_000})
    for kind, names in (("trade", ("t", "pt")), ("quote", ("t",))):
        event = ms.withColumn("kind", F.lit(kind)).select("id", source_queries._event_json().alias("j"))
        for name in names:
            assert event.filter(F.get_json_object("j", f"$.{name}").cast("bigint") == F.col("id")).count() == n


def test_frames_of_ids_that_a_double_cannot_hold(spark, tmp_path):
    from tickerloom.plans import source_queries

    first, n, s = 1 << 56, 40, 1_704_467_000
    events = spark.range(first, first + n).selectExpr(
        "id AS event_id", f"TIMESTAMP_NTZ'2024-01-05 15:03:20' + make_dt_interval(0, 0, 0, id - {first}) AS ts",
        "1L AS user_id", "'click' AS event_type", "1.5D AS value", "'{\"k\": 5}' AS props",
    )
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    recv = {i: (s + i - first) * 10**9 + i * 37 % 1009 * 10**6 for i in range(first, first + n)}
    frame = {k: max(recv[i] for i in recv if i // 4 == k) for k in {i // 4 for i in recv}}
    want = sorted((i - 400 * (i % 10 == 3), frame[i // 4]) for i in recv)
    got = source_queries.decode_trades(spark, str(tmp_path)).select("seq", "recv_ns").collect()
    assert sorted(map(tuple, got)) == want
