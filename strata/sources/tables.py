"""CSV folders as tables of strings, and the catalogue of what is registered."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name to path of every CSV file below folder; of equal names the last by path counts. Listed by Spark's file system."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], system.listFiles(root, True)
    while files.hasNext():
        path = files.next().getPath().toString()
        if path.lower().endswith(".csv"):
            found.append(path)
    return {posixpath.basename(p)[:-4].lower(): p for p in sorted(found)}


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A file's rows as strings, empty cells as "", the first record as header; rows of another width raise. None for an empty file."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    table = reader.csv(path)
    if not table.columns:
        return None
    text = spark.read.schema(", ".join(f"`{c}` string" for c in table.columns)).option("header", True).option("multiLine", True).option("escape", '"')
    text = text.option("mode", "FAILFAST").option("enforceSchema", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return text.csv(path).na.fill("")


def load_csv_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table of the folder by lower-cased name; a folder without any raises."""
    tables = {name: t for name, path in csv_files(spark, folder).items() if (t := read_csv(spark, path)) is not None}
    if not tables:
        raise ValueError(f"no CSV tables in {folder}")
    return tables


def as_strings(table: DataFrame) -> DataFrame:
    """Any table as a table of strings, nulls as ""."""
    return table.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in table.columns))


def describe(tables: dict[str, DataFrame]) -> str:
    """A line per table, by name: its columns and number of rows."""
    return "\n".join(f"TABLE {name} ({', '.join(t.columns)})  -- {t.count()} rows" for name, t in sorted(tables.items()))
