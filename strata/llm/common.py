"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: The white space that ends a word in every operator here: space, \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, the context's checkpoint folder, or else a temporary
    one, which only a local master's one machine can see: on any other master
    this raises.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the executors share")
    return tempfile.mkdtemp(prefix="strata-")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder all executors share."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(columns: list[str], name: str) -> str:
    """name, or name with a number behind it, that no column bears, whatever the case."""
    taken, out, n = {c.lower() for c in columns}, name, 0
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def within(rows: list, most: int) -> list:
    """Of rows with a column bytes, in their order, those that fit into what the ones before have left of ``most``."""
    out = []
    for r in rows:
        if r["bytes"] <= most:
            most -= r["bytes"]
            out.append(r)
    return out
