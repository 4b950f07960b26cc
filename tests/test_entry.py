import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_query_is_checked_by_sql():
    own = set(entry.base.QUERIES)
    assert own == set(entry.base.ORACLES)
    assert own <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_has_the_trader_columns(spark):
    df = entry.entry(spark)
    assert {"session_date", "at_sec", "basket", "cum_share", "row_rank"} <= set(df.columns)
    assert df.count() > 0


def test_bucket_plan_shuffles_once_and_hashes(spark):
    from tickerloom.operators import buckets as B
    from tickerloom.plans import tapes

    plan = B.bucketize(tapes.event_tape(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and "partial_" in plan
