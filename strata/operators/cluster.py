"""Spherical k-means and the summary tree over it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.vectors import dot, doubles, unit


def _points(vectors: DataFrame, ord_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(ord_col).cast("long").alias("ord"), doubles(F.col(vector_col)).alias("v"))


def _beside(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """points with all centroids in a column c: one broadcast row, so the plan stays small however many there are."""
    table = points.sparkSession.createDataFrame([(centroids,)], "c array<array<double>>")
    return points.crossJoin(F.broadcast(table))


def first_centroids(vectors: DataFrame, k: int, ord_col: str = "ord", vector_col: str = "vector") -> list[list[float]]:
    """k vectors: that of least ord, then again and again the one least similar to those chosen; ties to the least ord.

    The running similarity to the nearest choice needs one row a round on the
    driver.
    """
    points = _points(vectors, ord_col, vector_col)
    head = points.orderBy("ord").limit(1).collect()
    chosen = [head[0]["v"]] if head else []
    while chosen and len(chosen) < k:
        near = F.array_max(F.transform("c", lambda c: dot(F.col("v"), c)))
        row = _beside(points, chosen).select("ord", "v", near.alias("near")).agg(F.min_by("v", F.struct("near", "ord")).alias("v")).collect()[0]
        chosen.append(row["v"])
    return chosen


def assign(vectors: DataFrame, centroids: list[list[float]], ord_col: str = "ord", vector_col: str = "vector", digits: int | None = None) -> DataFrame:
    """ord, v, cluster: the most similar centroid, the lowest number of equals; similarities are compared as rounded to ``digits``, where that is given."""
    points = _beside(_points(vectors, ord_col, vector_col), centroids)
    near = lambda c: dot(F.col("v"), c) if digits is None else F.round(dot(F.col("v"), c), digits)
    scored = F.transform("c", lambda c, i: F.struct(near(c).alias("s"), (-i).alias("i")))
    return points.select("ord", "v", (-F.array_max(scored)["i"]).cast("int").alias("cluster"))


def recentred(assigned: DataFrame, centroids: list[list[float]]) -> list[list[float]]:
    """Each cluster's summed members at length one; an empty one keeps its centroid. Sums are combined before they are shuffled; k vectors reach the driver."""
    parts = assigned.select("cluster", F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v")).select("cluster", unit(F.col("v")).alias("v"))
    found = {r["cluster"]: r["v"] for r in sums.collect()}
    return [found.get(i, c) for i, c in enumerate(centroids)]


def kmeans(vectors: DataFrame, k: int, rounds: int = 10, ord_col: str = "ord", vector_col: str = "vector") -> DataFrame:
    """ord, cluster: deterministic spherical k-means, clusters numbered from 0 without gaps.

    k of 1 puts all in one; k of the number of vectors or more gives each its
    own. Stops when no vector moves. Centroids (k vectors) live on the driver.
    """
    points = _points(vectors, ord_col, vector_col).cache()
    n = points.count()
    if n == 0 or k <= 1:
        return points.select("ord", F.lit(0).alias("cluster"))
    if k >= n:
        return points.select("ord", (F.row_number().over(Window.orderBy("ord")) - 1).alias("cluster"))
    centroids = first_centroids(points, k, "ord", "v")
    before = None
    for _ in range(rounds):
        now = assign(points, centroids, "ord", "v").cache()
        if before is not None and now.join(before.select("ord", F.col("cluster").alias("was")), "ord").where("cluster <> was").isEmpty():
            break
        centroids = recentred(now, centroids)
        before = now
    used = before.select("cluster").distinct().select("cluster", (F.row_number().over(Window.orderBy("cluster")) - 1).alias("number"))  # k rows
    return before.join(F.broadcast(used), "cluster").select("ord", F.col("number").cast("int").alias("cluster"))


def clusters_wanted(n: int, branching: int = 5) -> int:
    """How many clusters n nodes of a level make: n over the branching, rounded up, and never n itself."""
    branching = branching if branching >= 2 else 5
    k = math.ceil(n / branching)
    return max(1, n // 2) if k >= n else k


def tree(leaves: DataFrame, summarise, embed, branching: int = 5, levels: int = 4, rounds: int = 10) -> DataFrame:
    """level, i, node_id (L<level>-<i>), text, members, vector of the summary nodes over leaves (ord, text, vector).

    summarise: (level, i, texts in order) -> text, called on the driver for a
    cluster's texts; embed: a DataFrame with text -> with vector. Leaves aren't
    among the nodes. Stops at one node or after ``levels``.
    """
    spark = leaves.sparkSession
    current, every = leaves.select("ord", "text", "vector"), None
    for level in range(1, levels + 1):
        n = current.count()
        if n <= 1:
            break
        groups = current.join(kmeans(current, clusters_wanted(n, branching), rounds), "ord")
        texts = groups.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]).alias("texts")).orderBy("cluster").collect()
        rows = [(level, r["cluster"], f"L{level}-{r['cluster']}", summarise(level, r["cluster"], r["texts"]), len(r["texts"])) for r in texts]
        nodes = embed(spark.createDataFrame(rows, "level int, i int, node_id string, text string, members int")).cache()
        every = nodes if every is None else every.unionByName(nodes)
        current = nodes.select(F.col("i").cast("long").alias("ord"), "text", "vector")
    return every if every is not None else embed(spark.createDataFrame([], "level int, i int, node_id string, text string, members int"))
