"""The best rows of each query within a batch, as a window over score and id would have them."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded as Spark's round does: by its shortest decimals, halves away from zero."""
    with np.errstate(invalid="ignore"):
        scaled = x * 10.0**digits
        out = np.floor(scaled + 0.5) / 10.0**digits
        close = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4
    for i in np.flatnonzero(close):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def best(scores: np.ndarray, found: np.ndarray, ids: pa.Array, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, query and rounded score of each query's k best rows that are found. scores, found: rows by queries; NaN comes first, ties go to the smaller id."""
    n = len(scores)
    value = np.where(found, np.where(np.isnan(scores), np.inf, scores), -np.inf)
    least = np.partition(value, n - k, axis=0)[n - k] - 2 * 10.0**-digits if n > k else -np.inf
    row, query = np.nonzero(found & (value >= least))
    score = half_up(scores[row, query], digits)
    place = np.empty(n, np.int64)
    place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(n)
    order = np.lexsort((place[row], -np.where(np.isnan(score), np.inf, score), query))
    row, query, score = row[order], query[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return row[keep], query[keep], score[keep]


def schema(id_type: DataType) -> StructType:
    """What rows() makes."""
    return StructType([StructField("query", IntegerType()), StructField("id", id_type), StructField("score", DoubleType())])


def rows(scores: np.ndarray, found: np.ndarray, ids: pa.Array, k: int, digits: int) -> pa.RecordBatch:
    """query (its position), id, score of best()."""
    row, query, score = best(scores, found, ids, k, digits)
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), ids.take(pa.array(row)), pa.array(score, pa.float64())], ["query", "id", "score"])


def numbered(queries: DataFrame, ids: list) -> DataFrame:
    """query, query_id: the ids of a batch of queries by position, for every executor."""
    kind = StructType([StructField("query", IntegerType()), StructField("query_id", queries.schema["query_id"].dataType)])
    return F.broadcast(queries.sparkSession.createDataFrame(list(enumerate(ids)), kind))


def ranked(found: DataFrame, queries: DataFrame, ids: list, k: int) -> DataFrame:
    """query_id, id, score, rank of the k best of what batches found (query, id, score)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.join(numbered(queries, ids), "query").select("query_id", "id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
