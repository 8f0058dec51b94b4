"""Broadcasts behind a check of the size, with another way beyond it, and results that are kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a query batch that may be sent to every executor.
MOST_ROWS = 20_000


def pair_with_all(rows: DataFrame, queries: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Every row with every query. Up to ``most`` queries are broadcast; more are dealt to blocks that the rows are joined with, so neither side is ever held whole."""
    n = queries.count()
    if n <= most:
        return rows.crossJoin(F.broadcast(queries))
    blocks = -(-n // most)
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)))
    spread = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    return spread.join(dealt.hint("merge"), "_block").drop("_block")


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df as it is if its rows lie evenly over at least as many partitions as there are cores, else dealt by a hash of keys.

    For tables as they are scanned, of which only the rows are counted: a file
    written as one row group is one task, however large it is.
    """
    held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # a row a partition
    if max(held, default=0) * df.sparkSession.sparkContext.defaultParallelism <= 2 * sum(held):
        return df
    return df.repartition(*keys)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, without its lineage, in the folder that ``spark.checkpoint.dir`` names; a temporary one serves a local master alone."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strata-"))
    return df.checkpoint(eager=True)
