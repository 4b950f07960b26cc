"""Baselines that roll from session to session.

The samples of a baseline are a session's bars per symbol: they are kept, a partition per session,
so the nightly job reads one session of buckets, adds its bars, drops the oldest session and takes
the medians anew from bars alone. Adding a session again replaces it.
"""

from pyspark.sql import functions as F

from tickerloom.operators import baselines as BL
from tickerloom.schema import LOOKBACK_SESSIONS
from tickerloom.sources import store

SCHEMA = (
    "symbol string, minute_of_day int, shares double, dollars double, auction_dollars double,"
    " prints bigint, session_date date"
)


class SampleStore:
    """Bars of the sessions that baselines look back on, below a path."""

    def __init__(self, path, lookback=LOOKBACK_SESSIONS, bar_minutes=1, counted=None, auctions=None):
        self.path, self.lookback, self.bar_minutes = path, lookback, bar_minutes
        self.counted, self.auctions = counted, auctions

    def bars(self, spark):
        """Every stored bar; a filter on session_date prunes partitions."""
        if not store.exists(spark, self.path):
            return spark.createDataFrame([], SCHEMA)
        return spark.read.schema(SCHEMA).parquet(self.path)

    def dates(self, spark):
        """The stored sessions, ascending: as many as the lookback, or one more before `roll` drops it."""
        return sorted(r[0] for r in self.bars(spark).select("session_date").distinct().collect())

    def add(self, buckets, date):
        """Store the bars of one session; one without data in its regular session is an error."""
        spark = buckets.sparkSession
        rows = BL.session_bars(BL.of_dates(buckets, [date]), self.bar_minutes, self.counted, self.auctions)
        rows = rows.select(*(F.col(c.split()[0]) for c in SCHEMA.split(", "))).persist()
        try:
            if not rows.take(1):
                raise ValueError(f"no data in the regular session of {date}")
            out = rows.repartition("symbol").sortWithinPartitions("symbol", "minute_of_day").write.mode("overwrite")
            out.option("partitionOverwriteMode", "dynamic").partitionBy("session_date").parquet(self.path)
        finally:
            rows.unpersist()
        return self.dates(spark)

    def roll(self, buckets, date):
        """Add a session and drop those beyond the lookback; the sessions that stay."""
        spark, dates = buckets.sparkSession, self.add(buckets, date)
        for old in dates[: -self.lookback]:
            store.delete(spark, f"{self.path}/session_date={old}")
        return dates[-self.lookback :]

    def ticker_profile(self, spark, symbols):
        """ticker_profile of the stored sessions."""
        dates = BL.check_dates(self.dates(spark))
        return BL.ticker_profile_of(self.bars(spark), symbols, len(dates), self.bar_minutes)

    def basket_profile(self, spark, members):
        """basket_profile of the stored sessions."""
        dates = BL.check_dates(self.dates(spark))
        return BL.basket_profile_of(self.bars(spark), members, dates, self.bar_minutes)
