"""Markdown and text files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folder names that hold no documents of one's own; the corpus root itself may bear one.
SKIPPED = frozenset({"node_modules", ".git", "vendor", "dist", "build", "target", ".next", ".venv", "venv", "__pycache__", ".cache", "coverage", ".strata"})


def read_corpus(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (path below folder), text, meta of every .md or .txt file below folder, whatever the case of its ending."""
    spread = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    path = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), r"^[a-zA-Z0-9]+:(//[^/]*)?(?=/)", "")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(root).toUri().getPath().rstrip("/")
    files = spread.select(F.substring(path, len(base) + 2, 1 << 20).alias("doc_id"), F.col("value").alias("text"), path.alias("path"))
    parents = F.slice(F.split("doc_id", "/"), 1, F.greatest(F.size(F.split("doc_id", "/")) - 1, F.lit(0)))
    skipped = F.array(*map(F.lit, sorted(SKIPPED | set(exclude))))
    kept = files.where(F.col("doc_id").rlike(r"(?i)\.(md|txt)$") & ~F.arrays_overlap(parents, skipped))
    return kept.select("doc_id", "text", F.create_map(F.lit("path"), F.col("path")).alias("meta"))
