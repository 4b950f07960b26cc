"""Bucket store and baselines of the derived tapes, written once and read by the queries.

They live in the folder the cluster shares, so a lost executor only costs a re-read.
"""

from tickerloom.operators import baselines as BL
from tickerloom.operators import buckets as B
from tickerloom.operators.metrics import Inputs
from tickerloom.plans import tapes
from tickerloom.sources import store

TAPES = {"event": tapes.event_tape, "line": tapes.line_tape, "wide": tapes.wide_tape}
_PATHS = {}


def scratch(spark, name):
    """A path of its own below the shared folder."""
    import uuid

    key = (spark.sparkContext.applicationId, "root")
    if key not in _PATHS:
        _PATHS[key] = f"{store.shared_dir(spark)}/tickerloom-{uuid.uuid4().hex[:12]}"
    return f"{_PATHS[key]}/{name}"


def _once(spark, sf_dir, name, write):
    key = (spark.sparkContext.applicationId, str(sf_dir), name)
    if key not in _PATHS:
        path = scratch(spark, f"{str(sf_dir).strip('/').replace('/', '_')}/{name}")
        write(path)
        _PATHS[key] = path
    return _PATHS[key]


def _checked(spark, path, read):
    """A table read and validated once per application."""
    key = (spark.sparkContext.applicationId, path, "frame")
    if key not in _PATHS:
        _PATHS[key] = read(path)
    return _PATHS[key]


def buckets(spark, sf_dir, tape):
    """bucket_1s of a tape, from its store."""
    path = _once(
        spark,
        sf_dir,
        f"{tape}_bucket_1s",
        lambda p: store.write_buckets(B.bucketize(TAPES[tape](spark, sf_dir)), p),
    )
    return _checked(spark, path, lambda p: store.read_buckets(spark, p))


#: Sessions that baselines of a tape look back on at most: the list becomes a partition filter.
LOOKBACK = 400


def dates(spark, sf_dir, tape):
    """The session dates with regular-session data, ascending: the latest LOOKBACK of them."""
    key = (spark.sparkContext.applicationId, str(sf_dir), f"{tape}_dates")
    if key not in _PATHS:
        _PATHS[key] = BL.regular_dates(buckets(spark, sf_dir, tape), n=LOOKBACK)
    return _PATHS[key]


def ticker_profile(spark, sf_dir, tape, bar_minutes=1):
    """Ticker baselines over every session of a tape, from their store."""

    def write(path):
        df = BL.ticker_profile(
            buckets(spark, sf_dir, tape),
            tapes.symbols(spark),
            dates(spark, sf_dir, tape),
            bar_minutes,
        )
        store.write_table(df, path)

    path = _once(spark, sf_dir, f"{tape}_ticker_profile_{bar_minutes}", write)
    return _checked(spark, path, lambda p: store.read_ticker_profile(spark, p, bar_minutes))


def basket_profile(spark, sf_dir, tape, bar_minutes=1):
    """Basket baselines over every covered session of a tape, from their store."""
    members = tapes.members(spark)

    def write(path):
        df = BL.basket_profile(
            buckets(spark, sf_dir, tape), members, dates(spark, sf_dir, tape), bar_minutes
        )
        store.write_table(df, path)

    path = _once(spark, sf_dir, f"{tape}_basket_profile_{bar_minutes}", write)
    read = lambda p: store.read_basket_profile(spark, p, members, bar_minutes)
    return _checked(spark, path, read)


def floors(spark, sf_dir, tape, bar_minutes=1):
    """Sigma floors of a tape, from their store."""

    def write(path):
        df = BL.floors(
            ticker_profile(spark, sf_dir, tape, bar_minutes),
            basket_profile(spark, sf_dir, tape, bar_minutes),
            bar_minutes=bar_minutes,
        )
        store.write_floors(df, path, BL.FLOOR_FRACTION, f"{tape} tape")

    path = _once(spark, sf_dir, f"{tape}_floors_{bar_minutes}", write)
    return _checked(spark, path, lambda p: store.read_floors(spark, p, bar_minutes))


def session_dates(spark, sf_dir, tape):
    """(session_date) of every session with a bucket: the store's partition list."""
    key = (spark.sparkContext.applicationId, str(sf_dir), f"{tape}_sessions")
    if key not in _PATHS:
        days = buckets(spark, sf_dir, tape).select("session_date").distinct().collect()
        rows = ", ".join(f"(DATE '{d}')" for d in sorted(r[0] for r in days))
        _PATHS[key] = f"SELECT * FROM VALUES {rows} AS t(session_date)"
    return spark.sql(_PATHS[key])


def inputs(spark, sf_dir, asof, tape="line", baselines=True):
    """Metric inputs over a tape's stores."""
    inp = Inputs(
        buckets=buckets(spark, sf_dir, tape),
        members=tapes.members(spark),
        asof=asof,
        benchmark=tapes.BENCHMARK,
        universe=tapes.symbols(spark),
    )
    if not baselines:
        return inp
    return inp.with_(
        tickers=ticker_profile(spark, sf_dir, tape),
        baskets=basket_profile(spark, sf_dir, tape),
        floors=floors(spark, sf_dir, tape),
    )
