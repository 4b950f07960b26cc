"""Market tapes derived from the given tables.

`event_tape`: the events table, one message per row, trades and quotes over 30 days.
`line_tape`: the lineitem table folded onto 20 sessions across a daylight-saving change, with
one symbol holding over a third of all messages.
"""

import datetime as dt

from pyspark.sql import functions as F

from tickerloom.functions import session as S

BENCHMARK = "S0"
BASKETS = {"core": ("S1", "S2", "S3"), "edge": ("S3", "S4"), "solo": ("S5",)}
SYMBOLS = ("S0", "S1", "S2", "S3", "S4", "S5")
FIRST_DATE = dt.date(2024, 3, 1)
N_DATES = 20
WIDE_SYMBOLS = 24
LINE_DATES = [FIRST_DATE + dt.timedelta(days=i) for i in range(N_DATES)]


def _symbol_case(number, n=6):
    return F.concat(F.lit("S"), (number % n).cast("string"))


def event_tape(spark, sf_dir, n_symbols=6):
    """Messages of the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    ts = F.col("ts")
    micros = (F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("bigint")
    sip = (
        (F.unix_date(ts.cast("date")).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60)
        * 1_000_000
        + micros
    ) * 1000
    k = F.get_json_object("props", "$.k").cast("int")
    lit = lambda n: F.lit(n).cast("int")
    conds = (
        F.when(i % 4 == 0, F.array().cast("array<int>"))
        .when(i % 4 == 1, F.array(k))
        .when(i % 4 == 2, F.array(k, lit(41), lit(37)))
        .otherwise(F.array(k % 36 + 1, lit(14)))
    )
    df = e.select(
        _symbol_case(F.col("user_id"), n_symbols).alias("symbol"),
        F.when(F.col("event_type") == "view", "quote").otherwise("trade").alias("kind"),
        F.col("value").alias("price"),
        (1 + i % 5).cast("double").alias("size"),
        sip.alias("sip_ns"),
        (i - F.when(i % 10 == 3, 400).otherwise(0)).alias("seq"),
        (i % 3).cast("int").alias("exchange"),
        (1 + i % 3).cast("int").alias("tape"),
        conds.alias("conditions"),
        i.alias("arrival"),
        F.col("value").alias("bid_price"),
        (F.col("value") + 0.25).alias("ask_price"),
        (1 + i % 9).alias("bid_size"),
        (1 + i % 7).alias("ask_size"),
        (i % 4).cast("int").alias("bid_exch"),
        (i % 5).cast("int").alias("ask_exch"),
    )
    return df.select(
        "*",
        (F.col("sip_ns") - (F.col("arrival") % 11) * 1_000_000).alias("part_ns"),
        (F.col("sip_ns") + (F.col("arrival") * 37 % 1009) * 1_000_000).alias("recv_ns"),
        S.et_date("sip_ns div 1000000000").alias("session_date"),
    )


def wide_tape(spark, sf_dir):
    """The events table over more symbols: some sessions lack a basket member."""
    return event_tape(spark, sf_dir, WIDE_SYMBOLS)


def line_tape(spark, sf_dir):
    """Messages of the lineitem table."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    line = F.col("l_linenumber").cast("bigint")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    mix = order * 7919 + part * 31 + supp * 17 + line
    eighth = F.floor(mix / 8)
    sod = F.when(mix % 8 == 0, 14400 + eighth % 57600).otherwise(34200 + eighth % 23460)
    date = F.date_add(F.lit(FIRST_DATE), ((part * 7 + supp + order) % N_DATES).cast("int"))
    lit = lambda n: F.lit(n).cast("int")
    digit = cents % 10
    conds = (
        F.when(digit == 6, F.array(lit(37)))
        .when(digit == 7, F.array(lit(12)))
        .when(digit == 8, F.array(lit(14), lit(41)))
        .when(digit == 9, F.array(((supp + cents) % 72).cast("int")))
        .otherwise(F.array().cast("array<int>"))
    )
    df = li.select(
        F.when(order % 3 == 0, "S1").otherwise(_symbol_case(part)).alias("symbol"),
        F.when(line % 4 == 3, "quote").otherwise("trade").alias("kind"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        date.alias("d"),
        sod.alias("sod"),
        ((cents * 64 + F.col("l_quantity").cast("bigint")) % 1_000_000_000).alias("nanos"),
        (order * 8 + line).alias("seq"),
        conds.alias("conditions"),
        (order * 8 + line).alias("arrival"),
    )
    sec = S.wall_second("d", "sod")
    return df.withColumn("sip_ns", sec * 1_000_000_000 + F.col("nanos")).select(
        "symbol", "kind", "price", "size", "sip_ns", "seq", "conditions", "arrival",
        F.col("d").alias("session_date"),
    )


def members(spark):
    """(basket, symbol) of the test baskets."""
    rows = ", ".join(f"('{b}', '{s}')" for b, names in BASKETS.items() for s in names)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(basket, symbol)")


def symbols(spark):
    """(symbol) of the test universe."""
    rows = ", ".join(f"('{s}')" for s in SYMBOLS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(symbol)")


# --- the same tapes as SQL for the checking engine -------------------------------------

EVENT_TAPE_SQL = """
tape AS (
  SELECT *, CAST(timezone('America/New_York', to_timestamp(sip_ns // 1000000000)) AS DATE)
           AS session_date,
         sip_ns - (arrival % 11) * 1000000 AS part_ns,
         sip_ns + (arrival * 37 % 1009) * 1000000 AS recv_ns
  FROM (
    SELECT 'S' || (user_id % 6) AS symbol,
           CASE WHEN event_type = 'view' THEN 'quote' ELSE 'trade' END AS kind,
           value AS price,
           CAST(1 + event_id % 5 AS DOUBLE) AS size,
           epoch_us(ts) * 1000 AS sip_ns,
           event_id - CASE WHEN event_id % 10 = 3 THEN 400 ELSE 0 END AS seq,
           event_id % 3 AS exchange,
           1 + event_id % 3 AS tape_id,
           CASE event_id % 4
             WHEN 0 THEN CAST([] AS BIGINT[])
             WHEN 1 THEN [CAST(json_extract_string(props, '$.k') AS BIGINT)]
             WHEN 2 THEN [CAST(json_extract_string(props, '$.k') AS BIGINT), 41, 37]
             ELSE [CAST(json_extract_string(props, '$.k') AS BIGINT) % 36 + 1, 14]
           END AS conditions,
           event_id AS arrival,
           value AS bid_price, value + 0.25 AS ask_price,
           1 + event_id % 9 AS bid_size, 1 + event_id % 7 AS ask_size,
           event_id % 4 AS bid_exch, event_id % 5 AS ask_exch
    FROM events)
)"""

LINE_TAPE_SQL = """
line_base AS (
  SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         l_orderkey * 7919 + l_partkey * 31 + l_suppkey * 17 + l_linenumber AS mix
  FROM lineitem),
tape AS (
  SELECT symbol, kind, price, size, seq, conditions, arrival, d AS session_date,
         CAST(epoch(timezone('America/New_York', CAST(d AS TIMESTAMP) + to_seconds(sod))) AS BIGINT)
           * 1000000000 + nanos AS sip_ns
  FROM (
    SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'S1' ELSE 'S' || (l_partkey % 6) END AS symbol,
           CASE WHEN l_linenumber % 4 = 3 THEN 'quote' ELSE 'trade' END AS kind,
           l_extendedprice / l_quantity AS price,
           l_quantity AS size,
           DATE '2024-03-01' + CAST((l_partkey * 7 + l_suppkey + l_orderkey) % 20 AS INTEGER) AS d,
           CASE WHEN mix % 8 = 0 THEN 14400 + (mix // 8) % 57600
                ELSE 34200 + (mix // 8) % 23460 END AS sod,
           (cents * 64 + CAST(l_quantity AS BIGINT)) % 1000000000 AS nanos,
           l_orderkey * 8 + l_linenumber AS seq,
           CASE cents % 10
             WHEN 6 THEN [37] WHEN 7 THEN [12] WHEN 8 THEN [14, 41]
             WHEN 9 THEN [(l_suppkey + cents) % 72]
             ELSE CAST([] AS BIGINT[]) END AS conditions,
           l_orderkey * 8 + l_linenumber AS arrival
    FROM line_base)
)"""
