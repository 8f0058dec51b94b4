"""Bounded core memory with an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2000
#: Bytes that an entry takes beside its text.
MARK = 3


def survivors(entries: DataFrame, budget: int = BUDGET, by: list[str] | None = None) -> DataFrame:
    """Of entries (seq, text), the newest that fit the budget in bytes, and always the newest one. Texts are taken to be distinct; ``by`` separates memories."""
    newest = Window.partitionBy(*(by or [])).orderBy(F.desc("seq"))
    running = F.sum(F.octet_length("text") + MARK).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return entries.withColumn("_sum", running).withColumn("_n", F.row_number().over(newest)).where((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def additions(entries: DataFrame, core: DataFrame, text: Column | None = None) -> DataFrame:
    """Entries whose trimmed text isn't blank and isn't in core already."""
    clean = entries.withColumn("text", F.trim(F.col("text") if text is None else text)).where("text <> ''")
    return clean.join(core.select("text").distinct(), "text", "left_anti")


def archived(entries: DataFrame) -> DataFrame:
    """doc_id (mem-<seq>), text, meta of entries, for the archive's index."""
    meta = F.create_map(F.lit("added"), F.date_format("added", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return entries.select(F.concat(F.lit("mem-"), F.col("seq").cast("string")).alias("doc_id"), "text", meta.alias("meta"))


def core_block(core: DataFrame) -> DataFrame:
    """One row, block: the core entries as a list, oldest first."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: F.concat(F.lit("- "), s["text"]))
    return core.agg(F.array_join(lines, "\n").alias("block"))
