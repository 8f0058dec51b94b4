"""Suffix-array dedup on sparse suffix arrays.

Only suffixes that begin at content-selected positions are kept: of every
LENGTH - SEED + 1 consecutive word positions, the one whose SEED words have the
least hash. Any two equal passages of LENGTH words hold the same such position,
so a match can't fall between the kept suffixes. A suffix carries its words, as
32 bits of XXH64 each, as far right and left as windows of LENGTH words reach in
which it is the kept position. Suffixes are range-partitioned by the hash of
their seed, sorted by their words in each partition, and neighbours compared:
the common prefix to the right and, for the same suffixes sorted by the words
before them, the common words to the left tell which of them match over LENGTH
words, so many of these to the left and the rest to the right. Matches that
overlap are extended to maximal spans.

Two passes read the texts. The first finds the seeds that two documents share;
these set bits of a map of fixed size, and the second pass writes only
suffixes whose bit is set (a wrongly set bit costs a row, no result). The range
key has the document behind the seed, so a passage that very many documents
share spreads over partitions; suffixes whose seed stands at the edge of a
partition or of a chunk are settled by 128-bit hashes of their windows' words in
a second step.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import checkpoint, shared_folder, shuffle_partitions

LENGTH, SEED = 50, 16
#: Bits of the map of shared seeds: 8 MB.
BITS = 1 << 26
CHUNK = 20_000


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        self[word] = got = xxh64_intdigest(word)
        return got


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words, by doubling."""
    powers, width = {1: words}, 1
    while width * 2 <= length:
        p = powers[width]
        powers[width * 2] = _mix(p[: len(p) - width], p[width:])
        width *= 2
    out, have, n = powers[width], width, len(words) - length + 1
    out = out[:n]
    while have < length:
        width = max(w for w in powers if w <= length - have)
        out = _mix(out, powers[width][have : have + n])
        have += width
    return out


def suffixes(words: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, position, first window, number of windows) of each kept suffix. Its windows are those in which it is the selected position."""
    n = len(words) - length + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    seeds = grams(words, seed)
    width = length - seed + 1
    at = np.empty(n, np.int64)
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        at[a:b] = np.lib.stride_tricks.sliding_window_view(seeds[a : b + width - 1], width).argmin(axis=1) + np.arange(a, b)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return seeds[at[first]], at[first], first, np.diff(np.r_[first, n])


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows of word numbers, words that each shares with the one before it in that order)."""
    order = np.argsort(rows.view(f"S{rows.shape[1] * 4}").ravel(), kind="stable")
    rows = rows[order]
    differ = np.concatenate([rows[1:] != rows[:-1], np.ones((max(len(rows) - 1, 0), 1), bool)], axis=1)
    return order, np.r_[0, differ.argmax(axis=1)]


def matches(words: np.ndarray, before: np.ndarray, count: np.ndarray, left: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(suffix, words to the left, group, whether two documents are in the group) of each window of the suffixes.

    words: the carried words of all suffixes, flat, ``before`` of each standing
    to the left of it; count: how many it carries; left: the fewest words to
    the left that a window of its has (the most are ``before``). Windows are in
    one group if they have the same words.
    """
    n, most = len(before), length - 1
    start = np.cumsum(count) - count + before
    reach = lambda at, ok: np.where(ok, words[np.clip(at, 0, max(len(words) - 1, 0))], 0).astype(">u4")
    step = np.arange(length)
    after = reach(start[:, None] + step, step < (count - before)[:, None])
    ahead = reach(start[:, None] - 1 - step[:most], step[:most] < before[:, None])
    order, shared = _sorted(after)
    turn, common = _sorted(ahead)
    right_of, left_of = np.empty(n, np.int64), np.empty(n, np.int64)
    out = []
    for o in range(int(left.min(initial=length)), int(before.max(initial=-1)) + 1):
        some = np.flatnonzero((left <= o) & (o <= before))
        if not len(some):
            continue
        # Neighbours that share enough words are one class; a window's class is that of its right and of its left words.
        right_of[order] = np.cumsum(shared < length - o)
        left_of[turn] = np.cumsum(common < o)
        number = np.unique(right_of[some] * (n + 1) + left_of[some], return_inverse=True)[1]
        low, high = np.full(number.max() + 1, np.iinfo(np.int64).max), np.full(number.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, number, doc[some])
        np.maximum.at(high, number, doc[some])
        out.append((some, np.full(len(some), o), number + o * (n + 1), (low < high)[number]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """id_col, start_word, end_word, n_words: the maximal spans of docs that are covered by runs of ``length`` words found in another document too.

    Words are what ASCII white space separates, compared as they are. Rows
    that share an identifier are one document: a run that stands in them alone
    isn't reported. Each of its texts has spans of its own, and rows that
    repeat identifier and text give them once. Rows with a null identifier or
    text, or with fewer words than ``length``, have no spans. An empty table
    gives an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))

    def kept(batches: Iterator[pd.DataFrame]):
        known = Hashes()
        for pdf in batches:
            for doc, row, text in zip(pdf["doc"].tolist(), pdf["row"].tolist(), pdf["text"], strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) >= length:
                    numbers = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    yield doc, row, numbers, suffixes(numbers, length, seed)

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for doc, _, _, (s, *_) in kept(batches):
            own = np.unique(s).view(np.int64)
            held.append(pd.DataFrame({"seed": own, "doc": np.full(len(own), doc, np.int64)}))
            size += len(own)
            if size > 100_000:
                yield pd.concat(held)
                held, size = [], 0
        if held:
            yield pd.concat(held)

    shared = rows.select("doc", F.lit(0).cast("long").alias("row"), "text").mapInPandas(seeds, "seed long, doc long").groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
    bit = F.pmod("seed", F.lit(bits).cast("long"))
    words = shared.select(bit.alias("at")).selectExpr("cast(at div 64 AS int) AS word", "shiftleft(1L, cast(at % 64 AS int)) AS bit")
    # At most bits / 64 rows of a few bytes, whatever the size of docs.
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    flags = np.zeros(bits // 64, np.uint64)
    flags[table.column("word").to_numpy()] = table.column("bit").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(flags)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags, out = sent.value, []
        frame = lambda: pd.DataFrame(out, columns=["seed", "doc", "row", "at", "first", "windows", "words"])
        for doc, row, numbers, (s, at, first, count) in kept(batches):
            place = np.mod(s.view(np.int64), bits)
            hit = np.flatnonzero((flags[place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1))
            # 32 bits of a word's hash; zero stands for no word.
            flat = np.maximum(numbers.astype(np.uint32), 1).tobytes()
            for h, p, a, n in zip(s.view(np.int64)[hit].tolist(), at[hit].tolist(), first[hit].tolist(), count[hit].tolist(), strict=True):
                out.append((h, doc, row, p, a, n, flat[a * 4 : (a + n - 1 + length) * 4]))
            if len(out) > 20_000:
                yield frame()
                out = []
        if out:
            yield frame()

    # Written once, compressed: sampling for splitters would read and hash the texts another time.
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/suffixes-{uuid.uuid4()}")
    path = place.toString()
    rows.mapInPandas(contexts, "seed long, doc long, row long, at int, first int, windows int, words binary").write.option("compression", "zstd").parquet(path)
    placed = spark.read.parquet(path).repartitionByRange(shuffle_partitions(spark), "seed", "doc").sortWithinPartitions("seed", "doc", "row", "at")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunks of the sorted suffixes; seeds at a chunk's edges may go on elsewhere."""
        from xxhash import xxh3_128_digest

        for pdf in batches:
            for start in range(0, len(pdf), CHUNK):
                part = pdf.iloc[start : start + CHUNK]
                first, at, windows = (part[c].to_numpy(np.int64) for c in ("first", "at", "windows"))
                s, docs_, rows_, carried = part["seed"].to_numpy(np.int64), part["doc"].to_numpy(np.int64), part["row"].to_numpy(np.int64), part["words"].to_numpy()
                flat = np.frombuffer(b"".join(carried), np.uint32)
                suffix, o, group, found = matches(flat, at - first, windows - 1 + length, at - first - windows + 1, docs_, length)
                a = at[suffix] - o
                order = np.lexsort((docs_[suffix], group))
                suffix, a, group, found = suffix[order], a[order], group[order], found[order].astype(bool)
                doc, row = docs_[suffix], rows_[suffix]
                # Settled here: spans of consecutive windows of one text.
                some = np.flatnonzero(found)
                some = some[np.lexsort((a[some], row[some], doc[some]))]
                if len(some):
                    d, r, x = doc[some], row[some], a[some]
                    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (x[1:] > x[:-1] + 1)])
                    yield pd.DataFrame({"hash": None, "doc": d[cut], "row": r[cut], "a": x[cut], "b": x[np.r_[cut[1:], len(x)] - 1] + length, "open": False})
                # Left open: windows of edge seeds; of those settled, the first and last document stand for all.
                edge = ((s == s[0]) | (s == s[-1]))[suffix]
                ends = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
                left = np.flatnonzero(edge & (~found | ends | np.r_[ends[1:], True])) if len(group) else np.zeros(0, np.int64)
                if len(left):
                    skip = (a[left] - first[suffix[left]]) * 4
                    hashed = [xxh3_128_digest(carried[i][k : k + length * 4]) for i, k in zip(suffix[left].tolist(), skip.tolist(), strict=True)]
                    yield pd.DataFrame({"hash": hashed, "doc": doc[left], "row": row[left], "a": a[left], "b": a[left] + length, "open": True})

    both = checkpoint(placed.mapInPandas(compare, "hash binary, doc long, row long, a long, b long, open boolean"))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    edges = both.where("open")
    twice = edges.groupBy("hash").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("hash")
    spans = both.where("not open").select("doc", "row", "a", "b").union(edges.join(twice, "hash", "left_semi").select("doc", "row", "a", "b"))
    before = Window.partitionBy("doc", "row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy("doc", "row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = spans.withColumn("new", (F.col("a") > F.coalesce(F.max("b").over(before), F.lit(-1))).cast("int")).withColumn("island", F.sum("new").over(until))
    kind = dict(docs.dtypes)[id_col]
    merged = islands.groupBy("doc", "row", "island").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"))
    return merged.select(F.col("doc").cast(kind).alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
