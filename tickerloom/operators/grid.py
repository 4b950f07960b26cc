"""Products of configuration-sized tables, dealt to many tasks."""

from pyspark.sql import functions as F

BLOCKS = 32


def each(days, rows, name):
    """Every row of `days` with every row of `rows`; neither is tape, and the result has a row for each.

    `rows` are dealt to blocks by column `name`, and `days` meet every block.
    """
    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    rows = rows.withColumn("block", F.pmod(F.hash(name), F.lit(BLOCKS)))
    return days.select("*", block).join(rows, "block").drop("block")
