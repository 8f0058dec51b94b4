"""SimHash near-dedup: exact Hamming links by vantage-point trees.

A tree over whole 64-bit fingerprints prunes almost nothing at radius 4: the
distances of unrelated fingerprints from any vantage point crowd around 32 with
a deviation of 4, so most queries overlap the boundary at every level (figures
in the README). The fingerprint is therefore cut into blocks, and every choice
of ``picked`` blocks gets a vantage-point tree of its own. Two fingerprints
within ``limit`` bits differ by few bits in one such choice at least; that is
the radius with which its tree is queried, and where the triangle bound lets a
boundary be crossed, the query goes to both sides. With five blocks the radius
is zero and every fingerprint visits one leaf a tree; with fewer blocks there
are fewer trees and overlapping leaves. Beyond CROWD distinct fingerprints a
tree is made for each pair of six blocks, beyond 256 times CROWD for each three
of seven: more trees, and with them cells that stay small. The links are the
same either way.

The trees are built on the driver from a bounded sample and decide only where
fingerprints meet, never whether they do. At radius zero only those with the
same bits in the tree's blocks can be linked through it, so a leaf falls into
cells of equal bits. A cell's fingerprints are sorted by their full distance
from the leaf's vantage point and compared only while those distances differ by
at most ``limit`` (the triangle bound again). Cells beyond LEAF are dealt out as
a triangle of pairs of parts, so no task holds more than two parts. Exact copies
of a fingerprint are folded before any of it, and a cell returns a spanning
forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import checkpoint, unused

SHINGLE, LIMIT, BLOCKS, SAMPLE, LEAF = 4, 4, 5, 20_000, 4096
#: Distinct fingerprints up to which trees over single blocks have small cells.
CROWD = 1 << 23
#: Rows of the table of crowded cells that may be broadcast.
MOST_CELLS = 50_000
#: A tree stops splitting at so many sampled fingerprints.
SPLIT = 8


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """SimHash of the text's k-word shingles (ASCII lower case, XXH64 seed 42): bit set where over half of the hashes have it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    if n <= k:
        return xxh64_intdigest(flat, 42)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - k + 1].tolist()
    hashes = np.array([xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, digest: bool = False) -> DataFrame:
    """id_col and fingerprint (the 64 bits as a signed long) of every row; with ``digest``, text_digest as well (text_digest() of its text)."""
    kind, more = dict(docs.dtypes)[id_col], ["text_digest"] if digest else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = np.array([fingerprint(t, k) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pdf[["id", *more]].assign(fingerprint=bits)

    digests = [text_digest(F.col(text_col)).alias("text_digest")] * digest
    ids = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), *digests)
    schema = "".join(f"{c} binary, " for c in more)
    return ids.mapInPandas(run, f"id string, {schema}fingerprint long").select(F.col("id").cast(kind).alias(id_col), "fingerprint", *more)


def text_digest(text: Column) -> Column:
    """MD5 of a text, null counting as empty: equal texts have one fingerprint, so a row is known by its identifier and this."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def reach(limit: int, blocks: int, picked: int) -> int:
    """Of ``limit`` differing bits over ``blocks`` blocks, how many fall at most into the ``picked`` blocks that have fewest."""
    each, more = divmod(limit, blocks)
    return picked * each + max(0, picked - (blocks - more))


class Forest:
    """A vantage-point tree for each choice of blocks of bits, as flat arrays that are sent to the executors."""

    def __init__(self, sample: np.ndarray, limit: int = LIMIT, blocks: int = BLOCKS, picked: int = 1, split: int = SPLIT):
        self.limit, self.radius = limit, reach(limit, blocks, picked)
        edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        self.masks = [np.uint64(sum(some)) for some in combinations(parts, picked)]
        self.roots, self.point, self.cut, self.near, self.far = [], [], [], [], []
        for mask in self.masks:
            self.roots.append(self._grow(np.unique(sample & mask), mask, split))
        self.point, self.cut = np.array(self.point, np.uint64), np.array(self.cut, np.int16)
        self.near, self.far = np.array(self.near, np.int32), np.array(self.far, np.int32)

    def _grow(self, points: np.ndarray, mask, split: int) -> int:
        at = len(self.point)
        self.point.append(points[len(points) // 2] if len(points) else np.uint64(0))
        for x in (self.cut, self.near, self.far):
            x.append(-1)
        if len(points) > split:
            d = np.bitwise_count(points ^ self.point[at]).astype(np.int16)
            cut = int(np.median(d))
            cut = cut if (d > cut).any() else cut - 1
            self.cut[at] = cut
            self.near[at] = self._grow(points[d <= cut], mask, split)
            self.far[at] = self._grow(points[d > cut], mask, split)
        return at

    def leaves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, leaf, cell) for every leaf that a ball of the radius around the point overlaps. A leaf is one cell, unless the radius is zero."""
        which, found, cells = [], [], []
        for mask, root in zip(self.masks, self.roots, strict=True):
            index, node = np.arange(len(points)), np.full(len(points), root, np.int32)
            while len(index):
                done = self.cut[node] < 0
                which.append(index[done])
                found.append(node[done])
                cells.append((points[index[done]] & mask).view(np.int64) if self.radius == 0 else np.zeros(int(done.sum()), np.int64))
                index, node = index[~done], node[~done]
                d = np.bitwise_count((points[index] & mask) ^ self.point[node]).astype(np.int16)
                near, far = d - self.radius <= self.cut[node], d + self.radius > self.cut[node]
                index, node = np.concatenate([index[near], index[far]]), np.concatenate([self.near[node[near]], self.far[node[far]]])
        return np.concatenate(which), np.concatenate(found), np.concatenate(cells)


def _links(group: np.ndarray, side: np.ndarray, bits: np.ndarray, vantage: np.ndarray, limit: int) -> np.ndarray:
    """A spanning forest of the pairs of one group within the limit, as (member, another member of its component). vantage: each row's vantage point; side: bit 1 and bit 2 tell whether a row is of the first and second of its group's two parts.

    Components are merged as pairs are found; the pairs aren't kept, so memory grows with the rows and not with their square.
    """
    n, step = len(bits), 1
    far = np.bitwise_count(bits ^ vantage).astype(np.int16)
    order = np.lexsort((far, group))
    group, side, bits, far = group[order], side[order], bits[order], far[order]
    alive, label = np.arange(n), np.arange(n)
    while True:
        alive = alive[alive + step < n]
        alive = alive[(group[alive] == group[alive + step]) & (far[alive + step] - far[alive] <= limit)]
        if not len(alive):
            break
        apart = alive[label[alive] != label[alive + step]]
        hit = apart[(np.bitwise_count(bits[apart] ^ bits[apart + step]) <= limit) & ((side[apart] | side[apart + step]) == 3)]
        label = _merged(label, hit, hit + step)
        step += 1
    member = np.flatnonzero(label != np.arange(n))
    return np.stack([order[member], order[label[member]]])


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, after the components of each a[i] and b[i] become one. A row's label is the first row of its component."""
    while len(a):
        x, y = label[a], label[b]
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while ((top := up[up]) != up).any():
            up = top
        label = up[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def near_links(points: DataFrame, limit: int = LIMIT, blocks: int | None = None, picked: int = 1, sample: int = SAMPLE, leaf_cap: int = LEAF) -> DataFrame:
    """links (a, b) between distinct fingerprints, enough to connect all that lie within ``limit`` bits of each other.

    points: distinct, non-null fingerprints in a column ``fingerprint``.
    Every link is a connection inside one cell, and every pair within the
    limit meets in some cell; the links of a cell form a spanning forest.
    blocks and picked are chosen by the number of points where blocks is None;
    they decide what the search costs, not what it finds.
    """
    if blocks is None:
        n = points.count()
        blocks, picked = (limit + 1, 1) if n <= CROWD else (limit + 2, 2) if n <= CROWD << 8 else (limit + 3, 3)
    drawn = points.orderBy(F.xxhash64("fingerprint")).limit(sample).collect()
    forest = Forest(np.array([r[0] for r in drawn], np.int64).view(np.uint64), limit, blocks, picked)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = pdf["fingerprint"].to_numpy(np.int64).view(np.uint64)
            which, leaf, cell = forest.leaves(bits)
            yield pd.DataFrame({"leaf": leaf, "cell": cell, "fingerprint": bits[which].view(np.int64)})

    placed = points.select("fingerprint").mapInPandas(place, "leaf int, cell long, fingerprint long")
    crowded = placed.groupBy("leaf", "cell").count().where(F.col("count") > leaf_cap).select("leaf", "cell", F.ceil(F.col("count") / leaf_cap).cast("int").alias("subs"))
    crowded = checkpoint(crowded)
    n = crowded.count()
    if n:
        crowded = F.broadcast(crowded) if n <= MOST_CELLS else crowded.hint("merge")
        mine = F.pmod(F.xxhash64("fingerprint"), F.col("subs")).cast("int")
        dealt = (
            placed.join(crowded, ["leaf", "cell"], "left")
            .withColumn("subs", F.coalesce("subs", F.lit(1)))
            .withColumn("mine", mine)
            .select("leaf", "cell", "fingerprint", "mine", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("other"))
            .select(
                "leaf",
                "cell",
                F.least("mine", "other").alias("p"),
                F.greatest("mine", "other").alias("q"),
                F.when(F.col("mine") == F.col("other"), 3).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("int").alias("side"),
                "fingerprint",
            )
        )
    else:
        dealt = placed.select("leaf", "cell", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(3).alias("side"), "fingerprint")
    group = ["leaf", "cell", "p", "q"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "fingerprint")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, group):
            new = np.logical_or.reduce([np.diff(pdf[c].to_numpy()) != 0 for c in group])
            values = pdf["fingerprint"].to_numpy(np.int64)
            member, other = _links(np.cumsum(np.r_[0, new]), pdf["side"].to_numpy(), values.view(np.uint64), forest.point[pdf["leaf"].to_numpy()], limit)
            if len(member):
                yield pd.DataFrame({"a": values[member], "b": values[other]})

    return dealt.mapInPandas(compare, "a long, b long")


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str], least: int = 20_000) -> Iterator[pd.DataFrame]:
    """The rows of a partition that is sorted by ``by``, in frames that hold whole groups."""
    held: list[pd.DataFrame] = []
    rows, floor = 0, least
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        rows += len(pdf)
        if rows < least:
            continue
        pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
        last = np.logical_and.reduce([pdf[c].to_numpy() == pdf[c].iloc[-1] for c in by])
        cut = int(np.argmax(last))
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        held, rows = [pdf.iloc[cut:].reset_index(drop=True)], len(pdf) - cut
        least = max(floor, 2 * rows)
    if held:
        yield pd.concat(held, ignore_index=True)


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node of links (a, b), both long.

    Rounds of hooking and contraction: each root takes the least root linked
    with it, pointers are halved, and the links are rewritten between roots.
    Minima are combined before they are shuffled; the joins on roots have
    plain scans on either side, so AQE can split a root with very many nodes.
    Each round's tables are checkpointed in the shared folder.
    """
    both = checkpoint(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = checkpoint(both.select(F.col("a").alias("node")).union(both.select("b")).distinct().withColumn("root", F.col("node")))
    while not both.isEmpty():
        turned = both.union(both.select("b", "a"))
        hook = checkpoint(turned.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("root"), F.least("a", "b").alias("up")))
        for _ in range(2):
            above = hook.select(F.col("root").alias("up"), F.col("up").alias("top"))
            hook = checkpoint(hook.join(above.hint("merge"), "up", "left").select("root", F.coalesce("top", "up").alias("up")))
        nodes = checkpoint(nodes.join(hook.hint("merge"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        left = hook.select(F.col("root").alias("a"), F.col("up").alias("x"))
        right = hook.select(F.col("root").alias("b"), F.col("up").alias("y"))
        moved = both.join(left.hint("merge"), "a", "left").join(right.hint("merge"), "b", "left")
        moved = moved.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b")
        both = checkpoint(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return nodes


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, limit: int = LIMIT, blocks: int | None = None, picked: int = 1) -> DataFrame:
    """Every row of docs as id_col, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``limit`` or fewer differing bits; component_id is
    the smallest identifier reachable over links, the row's own included. Null
    and empty texts have fingerprint zero and are linked like any other. Rows
    repeating an identifier each get a row; null identifiers are passed over
    when the smallest is taken. An empty table gives an empty result. Other
    columns of docs aren't read.
    """
    named = _named(checkpoint(fingerprints(docs, id_col, text_col, k)), id_col, limit, blocks, picked)
    return named.select(id_col, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def _named(prints: DataFrame, id_col: str, limit: int, blocks: int | None, picked: int) -> DataFrame:
    """prints, each row with its component_id."""
    firsts = checkpoint(prints.groupBy("fingerprint").agg(F.min(id_col).alias("first")))
    linked = components(near_links(firsts, limit, blocks, picked))
    least = linked.join(firsts.hint("merge"), F.col("node") == F.col("fingerprint")).groupBy("root").agg(F.min("first").alias("least"))
    small = linked.join(checkpoint(least).hint("merge"), "root").select(F.col("node").alias("fingerprint"), "least")
    named = checkpoint(firsts.join(small, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("component_id")))
    return prints.join(named.hint("merge"), "fingerprint")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, limit: int = LIMIT, blocks: int | None = None, picked: int = 1) -> DataFrame:
    """The rows of docs whose identifier is the smallest of their component, with all their columns.

    Rows that repeat that identifier are one document given more than once and
    all stay; a row with a null identifier stays only where its component has
    no other. Texts are joined to the verdicts by identifier and a digest of
    the text, so the verdict on one text never falls on another text of the
    same identifier, and fingerprints are computed once.
    """
    named = _named(checkpoint(fingerprints(docs, id_col, text_col, k, digest=True)), id_col, limit, blocks, picked)
    gone_id, lost, own = (unused(docs.columns, n) for n in ("_gone", "_lost", "_digest"))
    gone = named.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(gone_id), F.col("text_digest").alias(lost)).distinct()
    marked = docs.withColumn(own, text_digest(F.col(text_col)))
    same = marked[id_col].eqNullSafe(gone[gone_id]) & (marked[own] == gone[lost])
    return marked.join(gone.hint("merge"), same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
