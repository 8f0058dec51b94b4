"""Mixing sources to target weights by min-cost flow.

Documents that lie in the same set of sources share a membership pattern.
Patterns, not documents, are the nodes of a flow network: a pattern's words may
be taken once, twice, up to ``max_repeats`` times, each further time at a
higher cost, and are routed to the quotas of the sources it lies in. The
network has one node per pattern and source, however many documents there are,
and is solved on the driver; seeded selection of documents then runs on the
executors over 64-bit hashes and per-bin sums.
"""

from __future__ import annotations

import math
from collections import deque
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import WORD, checkpoint

BINS = 4096
#: Rounds of first-fit after the first prefix, each over the documents that still fit in what is missing.
ROUNDS = 4
#: A pattern whose missing words are under this share of the wanted ones is left at that.
CLOSE = 1e-4
#: Distinct sets of sources that the driver's network may have; beyond it mixing raises.
PATTERNS = 100_000


def targets(sizes: dict, weights: dict, total: int | None = None, max_repeats: int = 3) -> dict:
    """Per source, its share of all words (total, by default the sum of sizes) by weight, at most max_repeats times its size; the excess is shared anew by weight."""
    left, open_, out = Fraction(sum(sizes.values()) if total is None else total), {s for s in sizes if weights[s] > 0}, {s: Fraction(0) for s in sizes}
    while open_:
        shares = sum(Fraction(weights[s]) for s in open_)
        over = {s for s in open_ if left * Fraction(weights[s]) / shares > max_repeats * sizes[s]}
        if not over:
            out |= {s: left * Fraction(weights[s]) / shares for s in open_}
            break
        for s in over:
            out[s] = Fraction(max_repeats * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def route(capacity: dict, quotas: dict, max_repeats: int = 3) -> dict:
    """Words to take from each pattern for each source: {(pattern, source): words}.

    capacity: {pattern (a tuple of sources): words}. The r-th time a pattern's
    words are taken costs r, so repetition is spread before it deepens. Solved
    by successive shortest paths in exact fractions (Bellman-Ford over residual
    arcs), with at most max_repeats arcs from the start to each pattern.
    """
    start, end = ("start",), ("end",)
    arcs: list[list] = []  # to, residual, cost, reverse arc
    out: dict = {}

    def arc(a, b, room, cost):
        out.setdefault(a, []).append(len(arcs))
        arcs.append([b, Fraction(room), cost, len(arcs) + 1])
        out.setdefault(b, []).append(len(arcs))
        arcs.append([a, Fraction(0), -cost, len(arcs) - 1])

    between = {}
    for p in sorted(capacity, key=repr):
        for r in range(1, max_repeats + 1):
            arc(start, ("p", p), capacity[p], r)
        for s in p:
            between[p, s] = len(arcs)
            arc(("p", p), ("s", s), sum(quotas.values()) + 1, 0)
    for s in sorted(quotas, key=repr):
        arc(("s", s), end, quotas[s], 0)
    while True:
        cost, via, todo, waiting = {start: 0}, {}, deque([start]), {start}
        while todo:
            waiting.discard(a := todo.popleft())
            for i in out.get(a, ()):
                b, room, c, _ = arcs[i]
                if room > 0 and cost[a] + c < cost.get(b, math.inf):
                    cost[b], via[b] = cost[a] + c, i
                    if b not in waiting:
                        waiting.add(b)
                        todo.append(b)
        if end not in cost:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = arcs[arcs[via[at]][3]][0]
        flow = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= flow
            arcs[arcs[i][3]][1] += flow
    return {k: arcs[arcs[i][3]][1] for k, i in between.items() if arcs[arcs[i][3]][1]}


#: A source's name in a pattern: null's is NULL, any other's begins with MARK, so that no string can be taken for null.
NULL, MARK = "", "="


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """sources (sorted names), size and hash of each row, all that mixing needs of it, and the row itself as a struct, apart from which no name can clash.

    The hash that orders the documents covers identifier, text and seed.
    """
    members = F.col(source_col) if dict(docs.dtypes)[source_col].startswith("array") else F.array(F.col(source_col).cast("string"))
    members = F.coalesce(members.cast("array<string>"), F.array(F.lit(None).cast("string")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.sort_array(F.array_distinct(F.transform(members, lambda s: F.coalesce(F.concat(F.lit(MARK), s), F.lit(NULL))))).alias("sources"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text).alias("hash"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )


def _fit(spark, rows: DataFrame, want: dict[int, int]) -> dict[int, list[tuple[int, int, int]]]:
    """Per pattern, intervals (low, high, most): documents with low <= hash < high and size <= most are taken once more.

    In hash order, the longest prefix within the wanted words is taken, then
    among later documents that fit what is missing the longest prefix again,
    and so on: seeded first-fit. A prefix ends in a bin of hashes that is
    divided further until it holds one hash, so no task or driver ever sees
    more than BINS sums a pattern. At the end a pattern lacks fewer words than
    CLOSE of the wanted ones or than the document that its last prefix ended
    before, whichever is more; it never has more than it wants.
    """
    taken: dict[int, list[tuple[int, int, int]]] = {p: [] for p in want}
    missing, low = {p: w for p, w in want.items() if w > 0}, dict.fromkeys(want, -(2**63))
    for _ in range(ROUNDS + 1):
        if not missing:
            break
        most = dict(missing)
        base, width, room = {p: low[p] for p in missing}, {p: (2**63 - low[p] + BINS - 1) // BINS for p in missing}, dict(missing)
        open_ = dict.fromkeys(missing, True)
        met = {}
        while any(open_.values()):
            state = [(p, base[p], min(width[p], 2**63 - 1), most[p], room[p]) for p in open_ if open_[p]]
            plan = F.broadcast(spark.createDataFrame(state, "pattern int, base long, width long, most long, room long"))
            # A bin's number, without overflow: hashes and bases differ by up to 2**64, and narrow bins leave most hashes far beyond the last.
            gap = F.col("hash").cast("decimal(20,0)") - F.col("base").cast("decimal(20,0)")
            number = F.least(F.floor(gap / F.col("width").cast("decimal(20,0)")), F.lit(BINS)).cast("int")
            sums = (
                rows.join(plan, "pattern")
                .where((F.col("size") > 0) & (F.col("size") <= F.col("most")) & (F.col("hash") >= F.col("base")))
                .withColumn("bin", number)
                .where(F.col("bin") < BINS)
                .groupBy("pattern", "room", "bin")
                .agg(F.sum("size").alias("size"), F.min("hash").alias("first"), F.max("hash").alias("last"))
            )
            up = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ends = (
                sums.withColumn("upto", F.sum("size").over(up))
                .where(F.col("upto") > F.col("room"))
                .groupBy("pattern")
                .agg(F.min_by(F.struct("first", "last", "size", "upto", "bin"), "bin").alias("end"))
                .select("pattern", "end.*")
                .collect()
            )  # a row a pattern
            ended = {r["pattern"]: r for r in ends}
            for p in [p for p, o in open_.items() if o]:
                r = ended.get(p)
                if r is None:  # everything from here on fits
                    met[p], open_[p] = (None, None), False
                    continue
                room[p] -= r["upto"] - r["size"]
                if r["first"] == r["last"]:
                    met[p], open_[p] = (r["first"], room[p]), False
                else:
                    base[p], width[p] = r["first"], max(1, -(-(r["last"] - r["first"] + 1) // BINS))
        for p in list(missing):
            end, lacks = met[p]
            taken[p].append((low[p], 2**63 if end is None else end, most[p]))
            if end is None or end >= 2**63 - 1 or lacks <= 0 or lacks < want[p] * CLOSE:
                del missing[p]
            else:
                low[p], missing[p] = end + 1, lacks
    return taken


class Plan:
    """What a mix takes: times and spans by pattern (two small tables), sizes and targets by source."""

    def __init__(self, docs: DataFrame, weights: dict | None = None, seed: int = 17, max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        spark = docs.sparkSession
        self.names = id_col, text_col, source_col, seed
        rows = checkpoint(_rows(docs, *self.names).select("sources", "size", "hash"))
        # A row a pattern: as many as there are distinct sets of sources.
        found = rows.groupBy("sources").agg(F.sum("size").alias("size")).limit(PATTERNS + 1).collect()
        if len(found) > PATTERNS:
            raise ValueError(f"documents lie in more than {PATTERNS} distinct sets of sources")
        patterns = {tuple(r["sources"]): r["size"] for r in found}
        names = sorted({s for p in patterns for s in p}, key=lambda s: (s == NULL, s))
        weights = {NULL if s is None else MARK + s: w for s, w in weights.items()} if weights else {s: i % 3 + 1 for i, s in enumerate(names)}
        self.sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
        self.targets = targets(self.sizes, weights, sum(patterns.values()), max_repeats)
        flows = route({p: n for p, n in patterns.items() if n}, self.targets, max_repeats)
        self.patterns = sorted(patterns)
        by_pattern = dict.fromkeys(self.patterns, Fraction(0))
        for (p, _), f in flows.items():
            by_pattern[p] += f
        times, want = {}, {}
        for i, p in enumerate(self.patterns):
            times[i], want[i] = divmod(round(by_pattern[p]), patterns[p]) if patterns[p] else (0, 0)
        number = spark.createDataFrame([(list(p), i) for i, p in enumerate(self.patterns)], "sources array<string>, pattern int")
        chosen = _fit(spark, rows.join(F.broadcast(number), "sources"), want)  # at most PATTERNS rows are broadcast
        self.table = spark.createDataFrame(
            [(list(p), times[i], [(a, min(b, 2**63 - 1), b == 2**63, m) for a, b, m in chosen[i]]) for i, p in enumerate(self.patterns)],
            "sources array<string>, times long, spans array<struct<low: bigint, high: bigint, open: boolean, most: bigint>>",
        )

    def apply(self, docs: DataFrame) -> DataFrame:
        """sources, size, repeats (the times that a row is taken) and row, a struct of docs' columns; texts aren't shuffled."""
        more = F.exists("spans", lambda s: (F.col("hash") >= s["low"]) & (s["open"] | (F.col("hash") < s["high"])) & (F.col("size") <= s["most"]))
        marked = _rows(docs, *self.names).join(F.broadcast(self.table), "sources", "left")
        repeats = F.when(F.col("size") > 0, F.col("times") + more.cast("long")).otherwise(F.lit(0).cast("long"))
        return marked.select("sources", "size", repeats.alias("repeats"), "row")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per row of docs: id_col, size, source_size, target, taken (words the mix takes of it, repeats counted).

    source_col holds a string or an array of strings (overlapping sources);
    source_size and target are those of the row's source, or the sums over its
    sources. Options: weights by source (by default 1, 2, 3, repeating, in
    code-point order, null last), seed, max_repeats. taken is 0 or the size
    times 1 to max_repeats; how near a source comes to its target is said at
    _fit. Null and empty texts have size 0 and are never taken; rows that
    repeat identifier and text are taken alike; an empty table gives an empty
    result. Other columns aren't read.
    """
    docs = docs.select(*dict.fromkeys((id_col, text_col, source_col)))
    plan = Plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    sizes = docs.sparkSession.createDataFrame(
        [(list(p), sum(plan.sizes[s] for s in p), float(sum(plan.targets[s] for s in p))) for p in plan.patterns],
        "sources array<string>, source_size long, target double",
    )
    rows = plan.apply(docs).join(F.broadcast(sizes), "sources")
    return rows.select(F.col("row")[id_col].alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows and columns, a row as often as it is taken. Options and cases as of mix()."""
    taken = Plan(docs, **options).apply(docs).where(F.col("repeats") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("row.*")
