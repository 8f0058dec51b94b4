"""Vector functions as columns."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.text import STOPWORDS, let, spaced

#: Words whose buckets a worker remembers.
MOST_WORDS = 200_000


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The inner product over the shorter width."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """v at length one; a zero vector as it is."""
    return let(v, lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def _hashed(text: Column, dims: int, hashed: Callable[[bytes], int]) -> Column:
    """How many tokens fall into each bucket of their hash, at length one; nulls for a null. An Arrow function: a worker hashes a word once, up to MOST_WORDS of them at a time."""
    known: dict[bytes, int] = {w.encode(): dims for w in STOPWORDS}  # a bucket that isn't kept

    @F.arrow_udf("array<double>")
    def of_batch(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), dims))
        for i, words in enumerate(texts.to_pylist()):
            counts = Counter((words or b"").split())
            if len(known) > MOST_WORDS:
                for w in [w for w, b in known.items() if b < dims]:
                    del known[w]
            for w in counts:
                if w not in known:
                    known[w] = hashed(w) % dims
            if counts:
                out[i] = np.bincount([known[w] for w in counts], list(counts.values()), dims + 1)[:dims]
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        out = np.divide(out, length, out=out, where=length > 0)
        flat = pa.array(out.ravel(), pa.float64(), mask=np.repeat(texts.is_null().to_numpy(zero_copy_only=False), dims))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dims, pa.int32()), flat)

    return of_batch(spaced(text).cast("binary"))


def _fnv1a(word: bytes) -> int:
    h = 2166136261
    for b in word:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def _md5(word: bytes) -> int:
    return int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big")


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """The offline embedding: counts of tokens by FNV-1a bucket, at length one."""
    return _hashed(text, dims, _fnv1a)


def md5_embedding(text: Column, dims: int = 64) -> Column:
    """Like hash_embedding, with a bucket that any SQL engine can compute: the first 32 bits of MD5."""
    return _hashed(text, dims, _md5)
