"""What the operators share: registration, input tables, tables kept in the shared folder."""

import os
import tempfile
import uuid

from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}

#: A word: a run of characters other than ASCII white space (space, \t \n \v \f \r).
SPACE = r"[\x20\x09-\x0D]+"


def register(name, sql=None):
    """Add fn(spark, sf_dir) under a name, with SQL that gives the same rows where there is some."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark):
    """The folder that all executors share; a new local one only where none is set, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder the whole cluster shares")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark, name):
    """A path in the shared folder that nothing has written to."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex[:12]}/{name}"


def settled(df, name):
    """df written to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df, fn, schema):
    """df.mapInArrow by workers that find this package."""
    reachable(df.sparkSession)
    return df.mapInArrow(fn, schema)


def reachable(spark):
    """Put this package's folder on the path of Python workers."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])


def partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name="text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def once(column):
    """`column`, computed once a row.

    The optimizer writes deterministic projections anew into filters and generators above them,
    and there into lambdas too, where an array would be computed again for each element. A term
    that differs by partition keeps it from that, and always holds.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def words(text):
    """The words of a text column, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def free_name(df, name):
    """`name`, prolonged until df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
