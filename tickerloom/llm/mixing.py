"""Mixing sources to target weights by a subset-sum fit of document lengths.

Every source gets a target number of words. Whole copies of a source go in as long as they fit.
For what is left, its documents are counted by exact length, a share of each length is taken, and
a bounded-knapsack program over the lengths that remain fits the last words. Then documents are
picked by a seeded hash, as many of each length as the fit says.
"""

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.llm import base
from tickerloom.llm.packing import fullest

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = 20240229
#: The knapsack fits the last words: this many, or less than one document if that is more.
FIT_WORDS = 1 << 16
#: Documents of one source and length are ranked in groups of about this size.
RANKED = 1024


def targets(sources, weights=WEIGHTS, copies=MOST_COPIES):
    """(source, source_size) -> (source, source_no, source_size, target), one row per source.

    Sources in code point order, null last, get the weights in turn and share the sum of all
    sizes; a target stops at `copies` times its source, and the excess is shared by weight again.
    That is the level l at which min(copies * size, l * weight) sum up to the total: sources are
    ordered by the level at which they stop, and l is the first level that the next one bears.
    The windows here see one row per source.
    """
    no = F.row_number().over(W.orderBy(F.asc_nulls_last("source")))
    weight = F.get(F.array(*map(F.lit, weights)), (no - 1) % len(weights))
    cap = copies * F.col("source_size")
    df = sources.withColumn("source_no", no).withColumn("weight", weight)
    df = df.withColumn("stops", cap / F.col("weight"))
    order = W.orderBy("stops", "source_no")
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    df = df.withColumn("level", (total - before) / rest)
    fits = F.when(F.col("level") <= F.col("stops"), F.struct("stops", "source_no", "level"))
    level = F.min(fits).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level"]
    df = df.withColumn("level", level)
    target = F.least(cap.cast("double"), F.col("level") * F.col("weight"))
    return df.select("source", "source_no", "source_size", target.alias("target"))


def fit(lengths, counts, budget, most=FIT_WORDS):
    """How many documents of each length to take, so that their words come closest to budget.

    lengths are distinct and positive; counts say how many there are. An even share of each
    length comes first, then lengths whose share was cut most, then the longest that fit; the
    last `most` words are left to the subset-sum program.
    """
    total = sum(n * k for n, k in zip(lengths, counts))
    take = {n: k * budget // total for n, k in zip(lengths, counts)}
    there = dict(zip(lengths, counts))
    left = budget - sum(n * k for n, k in take.items())

    def add(n, k):
        nonlocal left
        k = max(0, min(k, there[n] - take[n], left // n))
        take[n] += k
        left -= n * k
        return k

    for n in sorted(lengths, key=lambda n: (-(there[n] * budget % total), n)):
        if left - n > most:
            add(n, 1)
    for n in sorted(lengths, reverse=True):
        add(n, (left - most) // n)
    while left > most and any(add(n, 1) for n in sorted(lengths, reverse=True) if n <= left):
        pass
    for n, k in fullest({n: there[n] - take[n] for n in lengths if n <= left}, left).items():
        add(n, k)
    return take


def _plan(histogram):
    """Histogram rows (source_no, size, n, budget) with `picked`, fitted source by source.

    A group holds one row per distinct length, so it is bounded by the lengths that occur and not
    by the documents of a source.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        budget = int(rows["budget"].iloc[0])
        sized = rows[rows["size"] > 0]
        take = {}
        if budget > 0 and len(sized):
            take = fit(sized["size"].tolist(), sized["n"].tolist(), budget)
        out = rows[["source_no", "size", "n"]].copy()
        out["picked"] = [take.get(s, 0) for s in rows["size"]]
        return out

    schema = "source_no int, size bigint, n bigint, picked bigint"
    base.reachable(histogram.sparkSession)
    return histogram.groupBy("source_no").applyInPandas(run, schema)


def mix(docs, seed=SEED):
    """docs (doc_id, text, source) -> (doc_id, source, size, source_size, target, times, taken).

    One row per row of docs; `times` is how often the mix takes the document. A null text has no
    words; documents without words are taken as often as their source is copied whole. Documents
    of one source and length are picked by a hash of seed and doc_id, so reruns agree; of rows
    with equal doc_id, source and size any may be the one picked. Other columns are not looked at.
    """
    size = F.size(base.words(F.col("text").cast("string"))).cast("bigint")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        size.alias("size"),
    )
    rows = base.settled(rows, "sizes")
    sources = base.settled(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("copies", F.least(whole, F.lit(MOST_COPIES)).cast("bigint"))
    budget = F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("bigint")
    budget = F.when(F.col("copies") < MOST_COPIES, budget).otherwise(F.lit(0).cast("bigint"))
    sources = sources.withColumn("budget", budget)

    same = rows["source"].eqNullSafe(sources["source"])
    by_length = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    numbered = by_length.join(sources, by_length["source"].eqNullSafe(sources["source"]))
    plan = base.settled(_plan(numbered.select("source_no", "size", "n", "budget")), "plan")

    rows = rows.join(sources, same).drop(sources["source"]).join(plan, ["source_no", "size"])
    mark = F.xxhash64(F.lit(seed), "doc_id")
    rows = rows.withColumn("mark", mark).withColumn("bin", F.pmod("mark", F.ceil(F.col("n") / RANKED)))
    key = ["source_no", "size", "bin"]
    bins = rows.filter(F.col("n") > RANKED).groupBy(*key).agg(F.count("*").alias("in_bin"))
    earlier = W.partitionBy("source_no", "size").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(*key, F.sum("in_bin").over(earlier).alias("before"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy("mark", "doc_id"))
    rows = rows.withColumn("rank", rank).join(bins, key, "left")
    picked = F.coalesce(F.col("before"), F.lit(0)) + F.col("rank") <= F.col("picked")
    times = F.col("copies") + picked.cast("bigint")
    rows = rows.withColumn("times", times)
    taken = (F.col("size") * F.col("times")).alias("taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", "times", taken)


def take(docs, seed=SEED):
    """The mix as rows of docs, each repeated as often as it is taken, columns as they are.

    Rows of equal doc_id, source and size are told apart by a hash of all their columns.
    """
    names = ("_no", "_key", "_source", "_size", "_k", "_times")
    no_id, key, source, size, k, times = (base.free_name(docs, c) for c in names)
    keys = [no_id, key, source, size]  # nulls apart, so that rows join on plain equality

    def keyed(df, n, more):
        null = F.concat_ws("/", F.col("doc_id").isNull().cast("string"), F.col("source").isNull().cast("string"))
        own = [null.alias(no_id), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias(key)]
        own += [F.coalesce(F.col("source").cast("string"), F.lit("")).alias(source), n.alias(size)]
        return df.select(*own, *more)

    columns = [F.col(f"`{c}`") for c in docs.columns]
    words = F.size(base.words(F.col("text").cast("string"))).cast("bigint")
    whole = F.xxhash64(*(c.cast("string") for c in columns))
    left = keyed(docs, words, columns)
    left = left.withColumn(k, F.row_number().over(W.partitionBy(*keys).orderBy(whole)))
    right = keyed(mix(docs, seed).filter("times > 0"), F.col("size"), [F.col("times").alias(times)])
    right = right.withColumn(k, F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(times))))
    both = left.join(right, [*keys, k])
    copies = F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(times)
    return both.select(*columns, copies).select(*columns)


@base.register("op3_mix_subset_sum")
def op3(spark, sf_dir):
    """Every document's part in the mix of all sources."""
    out = mix(base.documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "times")
