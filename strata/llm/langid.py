"""Language ID by word-first backoff.

A word seen in training scores with its log frequency in each language; an
unseen word falls back to its longest character n-grams that were seen, and
from those to shorter ones, down to single letters. Log frequencies are
smoothed and summed over all words of the whole text.

The fit reads at most SAMPLE rows a language, those of least hash, and of them
no more than SAMPLE_BYTES of text over all languages, of which there may be
LANGS; the tables keep at most WORDS words and GRAMS n-grams of each length a
language, so both the driver and the model that goes to the executors have a
bounded size. Words that the sample holds once back off to their n-grams, and
a word adds at most 3 to the counts of its n-grams.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import unused, within

#: Languages that may be learnt, and bytes of text that the fit reads at most.
LANGS, SAMPLE_BYTES = 1_000, 64 << 20
SAMPLE, WORDS, GRAMS, LONGEST = 2_000, 40_000, 30_000, 4
UNKNOWN = "und"
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
#: Words whose scores a worker remembers.
CACHE = 300_000


def words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return LETTERS.findall(text.lower())


class Model:
    """Log frequencies by word and by n-gram, a row of numbers per language."""

    def __init__(self, samples: Iterable[tuple[str, str]], vocabulary: int = WORDS, grams: int = GRAMS, longest: int = LONGEST):
        counts: dict[str, Counter] = {}
        rows: Counter = Counter()
        for lang, text in samples:
            counts.setdefault(lang, Counter()).update(words(text))
            rows[lang] += 1
        self.langs = sorted(counts)
        self.longest = longest
        total = sum(rows.values())
        self.prior = np.array([math.log((rows[x] + 1) / (total + len(self.langs))) for x in self.langs])
        self.words = self._table([Counter({w: n for w, n in counts[x].items() if n > 1}) for x in self.langs], vocabulary)
        self.grams = {}
        for n in range(1, longest + 1):
            seen = []
            for x in self.langs:
                c: Counter = Counter()
                for w, k in counts[x].items():
                    for g in self._split(w, n):
                        c[g] += min(k, 3)
                seen.append(c)
            self.grams[n] = self._table(seen, grams)
        self.cache: dict[str, np.ndarray] = {}

    @staticmethod
    def _split(word: str, n: int) -> list[str]:
        word = f"<{word}>" if n > 1 else word
        return [word[i : i + n] for i in range(max(1, len(word) - n + 1))]

    @staticmethod
    def _table(counts: list[Counter], most: int) -> tuple[dict[str, int], np.ndarray]:
        kept = sorted({w for c in counts for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]})
        totals = [sum(c.values()) + 0.5 * (len(kept) + 1) for c in counts]
        table = np.array([[math.log((c[w] + 0.5) / t) for c, t in zip(counts, totals, strict=True)] for w in kept], np.float32)
        return {w: i for i, w in enumerate(kept)}, table.reshape(len(kept), len(counts))

    def word(self, word: str) -> np.ndarray:
        """Scores of a word: its own, or the mean of its n-grams' of the greatest length of which any was seen, or nought."""
        at, table = self.words
        if word in at:
            return table[at[word]]
        for n in range(self.longest, 0, -1):
            at, table = self.grams[n]
            known = [at[g] for g in self._split(word, n) if g in at]
            if known:
                return table[known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share of the posterior; ("und", 0.0) where there is no letter or no model."""
        found = Counter(words(text or ""))
        if not found or not self.langs or not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0
        rows, cache = [], self.cache
        for w in found:
            got = cache.get(w)
            if got is None:
                got = self.word(w)
                if len(cache) >= CACHE:
                    cache.clear()
                if len(w) <= 64:
                    cache[w] = got
            rows.append(got)
        total = self.prior + np.array([*found.values()], np.float64) @ np.array(rows, np.float64)
        share = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(share[best] / share.sum())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, keep=None, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of docs' rows with a language and a text, at most ``sample`` a language; ``keep`` restricts them.

    The rows are those of least hash of identifier and text; rows with a null
    identifier are passed over, and a text that repeats under its identifier
    counts once. A share of the hashes, set by the number of rows of a
    language, finds them without a sort of all rows, so no language lands in
    one task. A text that doesn't fit what is left of ``sample_bytes`` is
    passed over; over LANGS languages raise.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.where(keep) if keep is not None else rows
    text = F.col(text_col)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), text.alias("text"), F.octet_length(text).alias("bytes"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGS + 1).collect()}
    if len(counts) > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    chosen: dict[str, list] = {}
    share = 1.5
    while missing := [x for x in counts if x not in chosen]:
        # At most LANGS rows are broadcast; about share * sample rows a language come back.
        limits = [(x, -(2**63) + min(2**64 - 1, math.ceil(2**64 * share * sample / counts[x]))) for x in missing]
        limits = docs.sparkSession.createDataFrame(limits, "lang string, most long")
        found: dict[str, set] = {x: set() for x in missing}
        for r in rows.join(F.broadcast(limits), "lang").where("h <= most").select("lang", "h", "id", "bytes").distinct().collect():
            found[r["lang"]].add((r["h"], r["id"], r["bytes"]))
        for x, some in found.items():
            if len(some) >= sample or share * sample >= counts[x]:
                chosen[x] = sorted(some)[:sample]
        share *= 4
    # Languages take turns, so that none is left without texts when the bytes run out.
    turns = sorted((n, x, h, i, size) for x, some in chosen.items() for n, (h, i, size) in enumerate(some))
    fits = within([{"bytes": size, "row": (x, i, h)} for _, x, h, i, size in turns], sample_bytes)
    if not fits:
        return Model([])
    picked = docs.sparkSession.createDataFrame([r["row"] for r in fits], "lang string, id string, h long")
    got = rows.join(F.broadcast(picked), ["lang", "id", "h"]).dropDuplicates(["lang", "id", "h"]).select("lang", "id", "text").collect()
    return Model([(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["lang"], r["id"], r["text"]))])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1, the winner's share of the posterior).

    Null texts and texts without a letter give ``und`` and score 0, and so
    does a model that was given no rows. Columns of docs named lang_pred or
    score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    found = unused(docs.columns, "_found")
    out = docs.withColumn(found, predicted(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col(f"{found}.lang_pred"), "score": F.col(f"{found}.score")}).drop(found)
