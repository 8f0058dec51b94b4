"""Vector search, reciprocal-rank fusion, hybrid search and reranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.vectors import dot, doubles, unit
from strata.operators import ranked
from strata.operators.lexical import MOST_CELLS, bm25
from strata.operators.sized import MOST_ROWS, pair_with_all

RRF_K = 60


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank: each query's k nearest rows by cosine; ties to the smaller id.

    queries: query_id, vector. A batch of queries goes to every executor as a
    matrix, and a batch of rows keeps the k best a query, so pairs are neither
    rows nor sorted. Batches beyond MOST_ROWS queries or MOST_CELLS components,
    and those whose vectors aren't all finite and of one width, are paired.
    """
    rows = vectors.select(F.col(id_col).alias("id"), unit(doubles(F.col(vector_col))).alias("v"))
    asked = queries.select("query_id", unit(doubles(F.col("vector"))).alias("q"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("q").cast("bigint")), F.lit(0)).alias("cells")).collect()[0]
    batch = asked.collect() if size["n"] <= MOST_ROWS and size["cells"] <= MOST_CELLS else []
    widths = {None if r["q"] is None else len(r["q"]) for r in batch}
    if len(widths) == 1 and None not in widths and all(x is not None and math.isfinite(x) for r in batch for x in r["q"]):
        return _near_sent(rows, queries, [r["query_id"] for r in batch], np.array([r["q"] for r in batch], np.float64), k, digits)
    scored = pair_with_all(rows, asked).select("query_id", "id", F.round(dot(F.col("v"), F.col("q")), digits).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _near_sent(rows: DataFrame, queries: DataFrame, ids: list, asked: np.ndarray, k: int, digits: int) -> DataFrame:
    """The same over rows (id, v) for query vectors that are sent; v as dot() takes it: over the shorter width, products with null as nought."""
    step, dims = max(1, MOST_CELLS // max(len(ids), asked.shape[1], 1)), asked.shape[1]

    def of_rows(there, vectors):
        width = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
        row = np.repeat(np.arange(len(vectors)), width)
        at = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
        dense, held = np.zeros((len(vectors), dims)), at < dims
        dense[row[held], at[held]] = pc.fill_null(vectors.flatten(), 0.0).to_numpy()[held]
        # Not by BLAS, in which a row's place in the batch may decide its last bit.
        scores = np.einsum("ij,kj->ik", dense, asked)
        null = vectors.is_null().to_numpy(zero_copy_only=False)
        yield ranked.rows(scores, np.broadcast_to(~null[:, None], scores.shape), there, k, digits)
        if null.any():
            last = there.filter(pa.array(null))
            last = last.take(pc.array_sort_indices(last, null_placement="at_start")[:k])
            every = pa.array(np.repeat(np.arange(len(ids)), len(last)), pa.int32())
            yield pa.RecordBatch.from_arrays([every, pa.concat_arrays([last] * len(ids)), pa.nulls(len(every), pa.float64())], ["query", "id", "score"])

    def scored(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                yield from of_rows(batch.column(0).slice(i, step), batch.column(1).slice(i, step))

    return ranked.ranked(rows.mapInArrow(scored, ranked.schema(rows.schema["id"].dataType)), queries, ids, k)


def fuse(lists: list[DataFrame], k: int, digits: int = 9) -> DataFrame:
    """query_id, id, score, rank: the k best by the sum of 1 / (60 + rank) over ranked lists (query_id, id, rank)."""
    every = lists[0].select("query_id", "id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("query_id", "id", "rank"))
    scores = every.groupBy("query_id", "id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), digits).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def pool(k: int) -> int:
    """How many of each list are fused for k results."""
    return max(5 * k, 20)


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "chunk_id", text_col: str = "text", vector_col: str = "vector") -> DataFrame:
    """query_id, id, score, rank of the fused vector and BM25 lists. queries: query_id, text, vector."""
    k = k if k > 0 else 10
    near = vector_topk(chunks, queries, pool(k), id_col, vector_col)
    worded = bm25(chunks, queries, pool(k), id_col, text_col)
    return fuse([near, worded], k)


def rerank(hits: DataFrame, scores: DataFrame, k: int, most: int = 20) -> DataFrame:
    """hits (query_id, id, rank) in the order of a reranker's scores (query_id, position from 0, score).

    Only the first ``most`` hits are scored; unscored ones come last, in their
    old order; positions that no hit has are passed over.
    """
    cut = hits.where(F.col("rank") <= most).drop("score")
    given = scores.select("query_id", (F.col("position") + 1).alias("rank"), F.col("score").cast("double").alias("score"))
    scored = cut.join(given, ["query_id", "rank"], "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "id", "score", F.col("place").alias("rank"))
