"""Exact top-k inner-product search by ball trees and branch and bound.

Vectors are dealt to shards of about SHARD rows: cells around pivots drawn from
a bounded sample, so that a shard's ball is small, and within a large cell by a
hash of the identifier. Every shard builds a ball tree. Queries go through it a
block at a time: a node is left out for the queries whose kth score so far
exceeds the node's bound, q.c + |q| r, and nodes with the higher bound come
first. The kth score is shared: a first pass over the query's own shard gives
each query a score to start from. By it a query is sent only to those other
shards whose own ball may hold a score as high, and a shard's vectors only to
the blocks of queries that come to it; there the trees prune by it again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import checkpoint

PIVOTS, SAMPLE, SHARD, BLOCK, LEAF = 32, 2_048, 8_192, 8_192, 256
#: Pivots a shard, beyond PIVOTS and up to SAMPLE.
FINE = 4


def _matrix(column: pd.Series) -> np.ndarray:
    """Packed integer vectors as rows, shorter ones filled up with zeros."""
    widths = {len(b) for b in column}
    if len(widths) == 1:
        return np.frombuffer(b"".join(column), np.int64).reshape(len(column), -1)
    out = np.zeros((len(column), max(widths, default=0) // 8), np.int64)
    for row, b in zip(out, column, strict=True):
        row[: len(b) // 8] = np.frombuffer(b, np.int64)
    return out


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


class BallTree:
    """Rows in leaf order, and for each node its span of rows, centre, radius and children."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows, self.order, self.leaf = rows.astype(np.float64), np.arange(len(rows)), leaf
        self.span, self.centre, self.radius, self.children = [], [], [], []
        self._grow(0, len(rows))

    def _grow(self, a: int, b: int) -> int:
        at, own = len(self.span), self.rows[self.order[a:b]]
        centre = own.mean(axis=0)
        # A little more than the radius, so that rounding never prunes a row.
        radius = np.sqrt(((own - centre) ** 2).sum(axis=1).max()) * (1 + 1e-9) + 1e-6
        self.span.append((a, b))
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append(None)
        if b - a > self.leaf and radius > 1e-5:
            first = own[np.argmax(((own - centre) ** 2).sum(axis=1))]
            second = own[np.argmax(((own - first) ** 2).sum(axis=1))]
            along = own @ (second - first)
            half = np.argsort(along, kind="stable")
            self.order[a:b] = self.order[a:b][half]
            middle = (a + b) // 2
            self.children[at] = self._grow(a, middle), self._grow(middle, b)
        return at

    def bound(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        bound = queries @ self.centre[node] + norms * self.radius[node]
        return bound + np.abs(bound) * 1e-9 + 1e-6


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's index, id, score) of each query's k best rows of the shard that reach the query's floor; ties to smaller ids."""
    rows, queries = _aligned(rows, queries)
    reach = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    kind = np.float64 if reach < 2**53 else np.int64 if reach < 2**62 else object  # whatever holds the products exactly
    tree = BallTree(rows)
    exact, asked = rows.astype(kind), queries.astype(kind)
    real = queries.astype(np.float64)
    norms = np.sqrt((real**2).sum(axis=1))
    kth = floor.astype(np.float64)
    best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = np.zeros((3, 0), object if kind is object else np.int64)
    lowest = np.iinfo(np.int64).min if kind is np.int64 else -np.inf

    def settle() -> None:
        nonlocal held
        q, i, s = (np.concatenate([held[j], *(x[j] for x in best)]) for j in range(3))
        best.clear()
        order = np.lexsort((i, -s, q)) if held.dtype != object else np.array(sorted(range(len(q)), key=lambda r: (q[r], -s[r], i[r])), int)
        q, i, s = q[order], i[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        full = place == k - 1
        at = q[full].astype(int)
        kth[at] = np.maximum(kth[at], s[full].astype(np.float64))
        keep = place < k
        held = np.stack([q[keep], i[keep], s[keep]])

    def visit(node: int, active: np.ndarray) -> None:
        active = active[tree.bound(node, real[active], norms[active]) >= kth[active]]
        if not len(active):
            return
        if tree.children[node]:
            sides = sorted(tree.children[node], key=lambda c: -float(tree.bound(c, real[active], norms[active]).mean()))
            for side in sides:
                visit(side, active)
            return
        a, b = tree.span[node]
        for at in range(a, b, 4096):
            part = tree.order[at : min(b, at + 4096)]
            for some in np.array_split(active, -(-len(active) // 512)):
                scores = asked[some] @ exact[part].T
                least = kth[some]
                own = ids[part][None, :] == query_ids[some][:, None]
                if scores.shape[1] > k and kind is not object:
                    scores[own] = lowest  # however often the query's id stands here, it takes no place
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                r, c = np.nonzero((scores >= least[:, None]) & ~own)
                best.append((some[r], ids[part][c], scores[r, c].astype(held.dtype)))
                settle()

    visit(0, np.arange(len(queries)))
    return held[0].astype(int), held[1].astype(np.int64), held[2].astype(np.int64)


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots of the sample."""
    chosen = [sample[0]]
    d = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and d.max() > 0:
        chosen.append(sample[int(np.argmax(d))])
        d = np.minimum(d, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def topk(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows by integer inner product.

    Components are turned into floor(scale * x). is_query is a column over
    vectors. All rows but those of the query's own id are candidates; ties go
    to the smaller id. Null vectors and ids and vectors with a null or
    non-finite component take no part; vectors of unequal length are filled up
    with zeros. A repeated row is a candidate as often as it stands there, a
    repeated query is asked once. Fewer candidates than k give fewer rows, an
    empty table none. Other columns aren't read.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), is_query.alias("asked"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v")
    )
    drawn = [np.array(r["v"], np.float64) for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(map(len, drawn))
    wanted = max(PIVOTS, FINE * rows.count() // shard)
    pivots = _pivots(np.array([np.pad(d, (0, width - len(d))) for d in drawn]), wanted)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [np.asarray(v, np.int64) for v in pdf["v"]]
            cells, far = np.zeros(len(packed), np.int32), np.zeros(len(packed))
            for at in range(0, len(packed), 2048):
                some = packed[at : at + 2048]
                wide, rest = np.zeros((len(some), width)), np.zeros(len(some))
                for i, v in enumerate(some):
                    wide[i, : min(width, len(v))] = v[:width]
                    rest[i] = (v[width:].astype(np.float64) ** 2).sum()
                own = np.argmin((pivots**2).sum(axis=1) - 2 * wide @ pivots.T, axis=1)
                cells[at : at + len(some)] = own
                far[at : at + len(some)] = np.sqrt(((wide - pivots[own]) ** 2).sum(axis=1) + rest)
            yield pd.DataFrame({"id": pdf["id"], "asked": pdf["asked"], "cell": cells, "far": far, "v": [p.tobytes() for p in packed]})

    placed = checkpoint(rows.mapInPandas(place, "id long, asked boolean, cell int, far double, v binary"))
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most SAMPLE rows
    cells = sorted(counts)
    subs = np.array([-(-counts[c] // shard) for c in cells])
    first = np.cumsum(np.r_[0, subs])
    table = F.broadcast(spark.createDataFrame([(c, int(a), int(n)) for c, a, n in zip(cells, first, subs, strict=False)], "cell int, first int, subs int"))
    sharded = placed.join(table, "cell").select("id", "asked", "v", "far", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("subs"))).cast("int").alias("shard"))
    asked = checkpoint(sharded.where("asked").select("id", "v", "shard").dropDuplicates(["id", "v"]))
    # A shard's ball: its cell's pivot, and the farthest of its rows (a number a shard reaches the driver).
    radius = np.zeros(int(first[-1]))
    for r in sharded.groupBy("shard").agg(F.max("far").alias("far")).collect():
        radius[r["shard"]] = r["far"] * (1 + 1e-9) + 1e-6
    centre, reach = pivots[cells], np.array([radius[a:b].max() for a, b in zip(first, first[1:], strict=False)])
    n_blocks = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_blocks)).cast("int")
    schema = "query_id long, q binary, vec_id long, score long"
    lowest = F.lit(float("-inf"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []})
        q, i, s = search(left["id"].to_numpy(np.int64), _matrix(left["v"]), right["query_id"].to_numpy(np.int64), _matrix(right["q"]), right["floor"].to_numpy(np.float64), k)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[q], "q": right["q"].to_numpy()[q], "vec_id": i, "score": s})

    def against(queries: DataFrame) -> DataFrame:
        """Queries (query_id, q, shard, block, floor) searched in their shard, whose rows go to the blocks that ask for it."""
        queries = queries.select("query_id", "q", "floor", F.col("shard").alias("to_shard"), F.col("block").alias("of_block"))
        wanted = queries.select(F.col("to_shard").alias("shard"), F.col("of_block").alias("for_block")).distinct()
        rows = sharded.select("id", "v", "shard").join(wanted, "shard")
        return rows.groupBy("shard", "for_block").cogroup(queries.groupBy("to_shard", "of_block")).applyInPandas(run, schema)

    asked = asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"), "shard", block.alias("block"))
    home = checkpoint(against(asked.withColumn("floor", lowest)))
    started = home.groupBy("query_id", "q").agg(F.min("score").cast("double").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
    floors = asked.join(started, ["query_id", "q"], "left").select("query_id", "q", "shard", "block", F.coalesce("least", lowest).alias("floor"))

    def onward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each other shard whose ball may hold a score that reaches the query's floor."""
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512].reset_index(drop=True)
                q = _matrix(part["q"]).astype(np.float64)
                norms, floor = np.sqrt((q**2).sum(axis=1)), part["floor"].to_numpy(np.float64)
                q, c = _aligned(q, centre)
                inner = q @ c.T
                slack = (np.abs(inner) + norms[:, None] * reach) * 1e-9 + 1e-6
                query, cell = np.nonzero(inner + norms[:, None] * reach + slack >= floor[:, None])
                each = subs[cell]
                to = np.repeat(first[cell], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                query, inner, slack = np.repeat(query, each), np.repeat(inner[query, cell], each), np.repeat(slack[query, cell], each)
                go = (inner + norms[query] * radius[to] + slack >= floor[query]) & (to != part["shard"].to_numpy()[query])
                rows = part.iloc[query[go]]
                yield pd.DataFrame({"query_id": rows["query_id"].to_numpy(), "q": rows["q"].to_numpy(), "shard": to[go].astype(np.int32), "block": rows["block"].to_numpy(), "floor": rows["floor"].to_numpy()})

    spread = checkpoint(floors.mapInPandas(onward, "query_id long, q binary, shard int, block int, floor double"))
    found = home.union(against(spread))
    ranked = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
