"""A content-addressed table of model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.text import cache_key

KINDS = ("context", "graph", "coref", "summary", "needle")


def keyed(rows: DataFrame, tag: str, kind: str = "context", doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rows with their key; the kind is part of the tag, except for context sentences."""
    label = tag if kind == "context" else f"{kind}|{tag}"
    return rows.withColumn("key", cache_key(F.lit(label), F.col(doc_col), F.col(text_col)))


def hits(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Keyed rows with their value; an empty value is a hit too."""
    return rows.join(cache.select("key", "value"), "key")


def misses(rows: DataFrame, cache: DataFrame) -> DataFrame:
    return rows.join(cache.select("key"), "key", "left_anti")


def plan(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: chunks, cached, calls. Nothing is written."""
    marked = rows.join(cache.select("key").distinct().withColumn("hit", F.lit(1)), "key", "left")
    cached = F.coalesce(F.sum("hit"), F.lit(0)).cast("long")
    return marked.agg(F.count(F.lit(1)).alias("chunks"), cached.alias("cached"), (F.count(F.lit(1)) - cached).alias("calls"))


def added(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows (key, value); a key that is there already keeps its value."""
    return cache.select("key", "value").unionByName(fresh.select("key", "value").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti"))
