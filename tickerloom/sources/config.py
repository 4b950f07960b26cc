"""Basket configuration: baskets, benchmark groups, the symbol universe."""

from pyspark.sql import functions as F

# Fixed value: the benchmark group that holds no equities.
EXCLUDED_GROUP = "bond_gate_futures"

CONFIG_SCHEMA = (
    "benchmarks map<string, array<string>>, "
    "baskets map<string, struct<members: array<string>>>"
)


def _read(spark, path, lines):
    return spark.read.option("multiLine", not lines).schema(CONFIG_SCHEMA).json(path)


def load_baskets(spark, path, lines=False):
    """(basket, symbol), distinct; a configuration without members fails.

    `path` holds one JSON document, or with `lines` any number of files of one object per line,
    each with some baskets or members of them: a large configuration is then read in parallel.
    """
    entries = _read(spark, path, lines).select(F.explode(F.map_entries("baskets")).alias("e"))
    entries = entries.select(F.col("e.key").alias("basket"), F.col("e.value.members").alias("m"))
    bad = entries.filter(F.col("basket").isNull() | (F.coalesce(F.size("m"), F.lit(0)) < 1))
    worst = bad.take(1)
    if worst or not entries.take(1):
        name = worst[0]["basket"] if worst else None
        raise ValueError(f"{path}: " + (f"basket {name!r} has no members" if name else "no baskets"))
    return (
        entries.select("basket", F.explode("m").alias("symbol"))
        .distinct()
        .orderBy("basket", "symbol")
    )


def load_universe(spark, path, lines=False):
    """(symbol): basket members and benchmark symbols, distinct and sorted."""
    cfg = _read(spark, path, lines)
    members = cfg.select(F.explode(F.map_values("baskets")).alias("b")).select(
        F.explode("b.members").alias("symbol")
    )
    groups = cfg.select(F.explode(F.map_entries("benchmarks")).alias("g"))
    marks = groups.filter(F.col("g.key") != EXCLUDED_GROUP).select(
        F.explode("g.value").alias("symbol")
    )
    out = members.union(marks).distinct().orderBy("symbol")
    if not out.take(1):
        raise ValueError(f"{path}: empty universe")
    return out


def member_union(members):
    """Every basket member once."""
    return members.select("symbol").distinct()


def check_members_known(members, universe):
    """Raise if a basket member is not in the universe."""
    gone = member_union(members).join(universe, "symbol", "left_anti").take(1)
    if gone:
        raise ValueError(f"basket member {gone[0]['symbol']} is not in the universe")
    return members


def unlisted_symbols(universe, reference):
    """Universe symbols that the reference table lacks, or lists as inactive or not stocks.

    `reference` has (symbol, market, active).
    """
    r = reference.select("symbol", "market", "active", F.lit(True).alias("listed"))
    joined = universe.select("symbol").join(r, "symbol", "left")
    problems = F.array(
        F.when(F.col("listed").isNull(), "missing"),
        F.when(F.col("market") != "stocks", "market"),
        F.when(~F.col("active"), "inactive"),
    )
    return joined.select("symbol", F.explode(F.array_compact(problems)).alias("problem"))
