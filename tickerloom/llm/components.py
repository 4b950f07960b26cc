"""Connected components of a graph that never leaves the executors."""

from pyspark.sql import functions as F

from tickerloom.llm import base


def _least(edges):
    """edges (u, v) with the least node among u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _both(edges):
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges):
    """One large-star and one small-star step: neighbours move to lesser nodes until all are stars."""
    large = _least(_both(edges)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = _least(down)
    own = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
    return own.filter("u <> v").distinct()


def roots(edges):
    """edges (u, v: bigint) -> (node, root): the least node of each node's component.

    Every node of some edge but the roots themselves has a row. Each round is a table in the
    shared folder, so a lost executor repeats one round only; rounds go with the logarithm of the
    longest path. No edges give no rows.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = base.settled(now, "edges")
    state = None
    while True:
        mark = F.xxhash64("u", "v").cast("decimal(38,0)")
        seen = now.agg(F.count("*"), F.sum(mark)).first()
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
        now = base.settled(_star(now), "edges")
