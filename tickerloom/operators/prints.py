"""Reports on print classes and condition codes."""

from pyspark.sql import functions as F

from tickerloom.functions import conditions as C
from tickerloom.schema import RANK


def with_class(trades):
    """trades with `class_rank` and `class_name`."""
    ranked = trades.withColumn("class_rank", C.classify("conditions"))
    return ranked.withColumn("class_name", C.class_name("class_rank"))


def unknown_condition_ids(trades):
    """Occurrences of each id missing from the tables, ascending."""
    ids = trades.select(F.explode("conditions").alias("condition_id"))
    ids = ids.filter(C.is_unknown("condition_id"))
    return ids.groupBy("condition_id").agg(F.count("*").alias("prints")).orderBy("condition_id")


def unknown_condition_prints(trades):
    """One row: prints carrying at least one unknown id."""
    hit = C.classify("conditions") == RANK["unknown"]
    return trades.agg(F.count_if(hit).alias("prints"))


def condition_histogram(trades):
    """Occurrences of every id, most frequent first."""
    ids = trades.select(F.explode("conditions").alias("condition_id"))
    counts = ids.groupBy("condition_id").agg(F.count("*").alias("prints"))
    return counts.orderBy(F.desc("prints"), "condition_id")


def class_distribution(trades):
    """Prints and dollars of every class."""
    ranked = trades.select(
        C.classify("conditions").alias("class_rank"),
        (F.col("price") * F.col("size")).alias("notional"),
    )
    out = ranked.groupBy("class_rank").agg(
        F.count("*").alias("prints"), F.sum("notional").alias("dollars")
    )
    return out.withColumn("class_name", C.class_name("class_rank"))


def condition_samples(trades, condition_id=55, n=20):
    """The first n prints carrying an id, in arrival order."""
    hits = trades.filter(F.array_contains("conditions", condition_id))
    return hits.orderBy("sip_ns", "arrival").select("symbol", "sip_ns", "size").limit(n)


def check_known_conditions(trades):
    """Raise if the tape carries an id missing from the tables."""
    unknown = unknown_condition_ids(trades).take(20)
    if unknown:
        ids = {r["condition_id"]: r["prints"] for r in unknown}
        raise ValueError(f"condition ids missing from the class tables: {ids}")
    return trades


def lateness_log(trades):
    """Prints whose reporting delay is tracked, with the delay in nanoseconds."""
    ranked = with_class(trades).filter(C.monitor_lateness("class_rank", "conditions"))
    return ranked.select(
        "symbol",
        "class_name",
        "conditions",
        "sip_ns",
        "part_ns",
        (F.col("sip_ns") - F.col("part_ns")).alias("lateness_ns"),
        "size",
        (F.col("price") * F.col("size")).alias("notional"),
        F.expr("sip_ns div 1000000000").alias("second"),
    )


