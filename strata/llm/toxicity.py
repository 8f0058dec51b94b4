"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams it holds (present or not),
over lower-cased text with a space at either end. A feature's value is its
naive Bayes log-count ratio, ln of its smoothed share in toxic texts over that
in clean ones; a logistic regression is fitted over these values. Scoring is
one pass of table look-ups over whole texts.

The fit reads labelled rows only, at most SAMPLE toxic and 2 * SAMPLE clean
ones, those of least hash, and of them no more than SAMPLE_BYTES of text: these
bounds are what makes it independent of the size of the corpus. The n-grams of
those rows are counted over their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import within

SAMPLE, SAMPLE_BYTES = 2_500, 64 << 20
NGRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 20
#: So many features keep a weight: those with the largest chi-square.
FEATURES = 30_000
ALPHA, RIDGE, STEPS = 1.0, 1e-3, 200
#: Characters that are hashed at a time; a longer text is cut into overlapping spans, whose n-grams are then united.
SPAN = 1 << 20
#: Features of the sample that one step of the fit turns into numbers at a time.
BLOCK = 1 << 18


def grams(text: str, sizes: tuple[int, ...] = NGRAMS) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, in arrays of a position each."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    odd = np.isin(codes, (9, 10, 11, 12, 13))
    codes = np.where(odd, np.uint32(32), codes)
    for at in range(0, len(codes), SPAN):
        part = codes[at : at + SPAN + max(sizes) - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(sizes) + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] * np.uint32(0x01000193)) ^ (part[n - 1 :] * np.uint32(0x9E3779B1))
            if n in sizes:
                mixed = h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
                mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                yield (mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1)


def held(text: str | None) -> np.ndarray:
    """Buckets of the text's n-grams, each once, in order."""
    return once([*grams(text)]) if text else np.zeros(0, np.uint32)


def once(found: list[np.ndarray]) -> np.ndarray:
    """The distinct numbers of all arrays, in order; sorted, as np.unique takes five times as long over hashes."""
    every = np.sort(np.concatenate(found or [np.zeros(0, np.uint32)]))
    return every[np.append(True, every[1:] != every[:-1])[: len(every)]]


@dataclass
class Model:
    """weight: by bucket, log-count ratio times coefficient. bias: the score of a text without features, as a logit."""

    weight: np.ndarray
    bias: float

    def logit(self, text: str | None) -> float:
        found = [g[self.weight[g] != 0] for g in grams(text)] if text else []
        return self.bias + float(self.weight[once(found)].sum()) if found else self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -500, 500))))


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of labelled texts; with one class or none, the constant share of toxic rows (0 of none)."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    counts = np.zeros((2, BUCKETS), np.float64)
    for text, label in zip(texts, y.astype(int), strict=True):
        counts[label, held(text)] += 1
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())
    # 2 x 2 chi-square of a feature's presence against the label.
    a, b = counts[1], counts[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num((n0 + n1) * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n0 + n1 - a - b) * n0 * n1))
    chi[(a + b) < 3] = 0
    kept = np.argsort(-chi, kind="stable")[:FEATURES]
    kept = kept[chi[kept] > 6.6]
    ratio = np.log(((a + ALPHA) / (n1 + 2 * ALPHA)) / ((b + ALPHA) / (n0 + 2 * ALPHA)))
    number = np.full(BUCKETS, -1, np.int32)
    number[kept] = np.arange(len(kept))
    # The n-grams are hashed a second time rather than kept: only those with a weight are held for all texts at once,
    # four bytes each. A feature's value is its ratio, so neither values nor row numbers are stored beside it.
    cols = [(c := number[held(t)])[c >= 0] for t in texts]
    blocks, at = [], 0
    while at < len(cols):
        end, size = at, 0
        while end < len(cols) and (end == at or size + len(cols[end]) <= BLOCK):
            size, end = size + len(cols[end]), end + 1
        blocks.append((at, np.array([len(c) for c in cols[at:end]]), np.concatenate(cols[at:end])))
        cols[at:end] = [c[:0] for c in cols[at:end]]
        at = end
    ratio = ratio[kept]
    balance = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    w, bias = np.zeros(len(kept)), 0.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, STEPS + 1):  # Adam on the whole sample, in a fixed order: refits agree
        grad, wr = np.zeros(len(kept) + 1), w * ratio
        for at, lengths, col in blocks:
            own = slice(at, at + len(lengths))
            z = np.bincount(np.repeat(np.arange(len(lengths)), lengths), wr[col], len(lengths)) + bias
            error = balance[own] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[own]) / len(y)
            grad[:-1] += np.bincount(col, np.repeat(error, lengths), len(kept))
            grad[-1] += error.sum()
        grad[:-1] = grad[:-1] * ratio + RIDGE * w / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - float(step[-1])
    weight = np.zeros(BUCKETS, np.float32)
    weight[kept] = w * ratio
    return Model(weight, bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, keep=None, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the labelled rows of docs; ``keep`` (a column of the id) restricts them.

    A document labelled more than once counts as toxic if any label says so;
    null labels and ids are passed over; a text is learnt once, however often
    it stands there under one identifier. Where more rows are labelled than
    the bounds allow, those with the least hash of id and text are taken,
    ``sample`` toxic and twice as many clean ones; a text that doesn't fit
    what is left of ``sample_bytes`` is passed over.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.where(keep) if keep is not None else marks
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    order = F.xxhash64("id", "y")
    chosen = {y: marks.where(F.col("y") == y).orderBy(order, "id").limit(n) for y, n in ((1, sample), (0, 2 * sample))}
    text = F.coalesce(F.col(text_col), F.lit(""))
    # At most 3 * sample identifiers: a size that the parameter bounds.
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen[1].union(chosen[0])), "id").withColumn("h", F.xxhash64("text"))
    # Identifiers may repeat without bound: sizes first, of as many rows as the sample has, then the texts of those that fit.
    sizes = rows.select("id", "y", "h", F.octet_length("text").alias("bytes")).distinct().orderBy(F.xxhash64("id", "h"), "id", "h").limit(3 * sample).collect()
    fits = within(sizes, sample_bytes)
    if not fits:
        return fit([], [])
    some = docs.sparkSession.createDataFrame([(r["id"], r["h"]) for r in fits], f"id {dict(rows.dtypes)['id']}, h long")
    got = rows.join(F.broadcast(some), ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "text", "y").collect()
    got = sorted(got, key=lambda r: (r["id"], r["text"]))
    return fit([r["text"] for r in got], [r["y"] for r in got])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a double of 0 to 1 that is higher where toxic is likelier.

    Whole texts are scored; null and empty ones get the model's bias. A column
    of docs named like the score is replaced.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((np.flatnonzero(model.weight).astype(np.int32), model.weight[model.weight != 0], model.bias))
    cache: list[Model] = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not cache:
            at, w, bias = shared.value
            table = np.zeros(BUCKETS, np.float32)
            table[at] = w
            cache.append(Model(table, bias))
        return pd.Series([cache[0].score(t) for t in texts], dtype="float64")

    return docs.withColumn(score_col, scored(F.col(text_col)))
