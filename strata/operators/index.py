"""The chunk index: ingest, plan, search, save and load."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import embedded
from strata.operators.chunking import chunk
from strata.operators.search import hybrid
from strata.sources import cache as replies
from strata.sources.providers import offline_embedded


class UnusableIndex(RuntimeError):
    """An index that can't be used."""


def ingest(
    docs: DataFrame,
    target: int = 800,
    overlap: int | None = 100,
    least_words: int = 0,
    contexts: DataFrame | None = None,
    tag: str = "",
    embed: Callable[[DataFrame], DataFrame] = offline_embedded,
    onto: DataFrame | None = None,
) -> DataFrame:
    """Chunks of docs (doc_id, text) with context and vector; ``embed`` reads the column text.

    contexts: cached context sentences (key, value); a chunk without one has
    an empty context. onto: chunks that are there already; a chunk of the same
    id is replaced, so ingesting a document again doesn't count it twice.
    """
    chunks = chunk(docs, target, overlap, least_words)
    if contexts is None:
        chunks = chunks.withColumn("context", F.lit(""))
    else:
        keyed = replies.keyed(chunks, tag)
        chunks = keyed.join(contexts.select("key", F.col("value").alias("context")), "key", "left").withColumn("context", F.coalesce("context", F.lit(""))).drop("key")
    chunks = chunks.select("chunk_id", "doc_id", "position", F.col("text").alias("own"), "context", embedded(F.col("context"), F.col("text")).alias("text"))
    made = embed(chunks).select("chunk_id", "doc_id", "position", F.col("own").alias("text"), "context", F.col("text").alias("embedded"), "vector")
    if onto is None:
        return made
    return onto.join(made.select("chunk_id"), "chunk_id", "left_anti").unionByName(made)


def plan(docs: DataFrame, contexts: DataFrame, tag: str, target: int = 800, overlap: int | None = 100, least_words: int = 0) -> DataFrame:
    """One row: chunks, cached, calls that ingesting docs would make."""
    return replies.plan(replies.keyed(chunk(docs, target, overlap, least_words), tag), contexts)


def search(chunks: DataFrame, queries: DataFrame, k: int = 10, embed: Callable[[DataFrame], DataFrame] = offline_embedded) -> DataFrame:
    """query_id, chunk_id, doc_id, text, context, score, rank: hybrid search over the embedded texts. queries: query_id, text."""
    best = hybrid(chunks, embed(queries), k, "chunk_id", "embedded", "vector")
    return best.withColumnRenamed("id", "chunk_id").join(chunks.select("chunk_id", "doc_id", "text", "context"), "chunk_id")


def semantic(chunks: DataFrame, queries: DataFrame, k: int = 10, embed: Callable[[DataFrame], DataFrame] = offline_embedded, tier: str = "semantic") -> DataFrame:
    """Evidence of the semantic (or memory) tier: texts with their context."""
    hits = search(chunks, queries, k, embed)
    return hits.select(
        "query_id", F.lit(tier).alias("tier"), F.col("chunk_id").alias("source_id"), embedded(F.col("context"), F.col("text")).alias("text"), "score", F.create_map(F.lit("doc"), F.col("doc_id")).alias("meta"), "rank"
    )


def save(chunks: DataFrame, path: str, model: str = "") -> None:
    """Chunks and vectors as a new Parquet version below path, then a one-row manifest that names it; postings are derived, not stored. A reader sees the old index or the new one."""
    version = uuid.uuid4().hex
    chunks.write.parquet(f"{path}/chunks-{version}")
    n = chunks.sparkSession.read.parquet(f"{path}/chunks-{version}").count()
    chunks.sparkSession.createDataFrame([(model, n, version)], "model string, n long, version string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str, model: str = "") -> DataFrame:
    """The saved chunks; raises if rows are missing or lack vectors, or if another model made the vectors (both names given)."""
    told = spark.read.schema("model string, n long, version string").json(f"{path}/manifest").collect()
    if len(told) != 1:
        raise UnusableIndex(f"{path} holds no single manifest")
    chunks = spark.read.parquet(f"{path}/chunks-{told[0]['version']}")
    if chunks.where("vector is not null").count() != told[0]["n"]:
        raise UnusableIndex(f"{path} is corrupt: its chunks and vectors don't match the manifest")
    if model and told[0]["model"] and model != told[0]["model"]:
        raise UnusableIndex(f"{path} was embedded by {told[0]['model']}, not {model}")
    return chunks


def entries(chunks: DataFrame) -> DataFrame:
    """The index in its order: by document and position."""
    return chunks.orderBy("doc_id", "position", "chunk_id")


def add(chunks: DataFrame, more: DataFrame) -> DataFrame:
    """chunks with others that have vectors already; one whose id is there replaces the old one."""
    return chunks.join(more.select("chunk_id"), "chunk_id", "left_anti").unionByName(more)
