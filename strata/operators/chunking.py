"""Splitting documents into chunks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import ASCII_SPACES, SPACES, has_prose


PARAGRAPH_END = re.compile(rf"\n{ASCII_SPACES}*\n")
SENTENCE_END = re.compile(rf"([.!?]){ASCII_SPACES}+")
WHITE = re.compile(SPACES)
#: What SPACES holds, for str.strip.
WHITE_CHARS = "".join(c for c in map(chr, range(0x3001)) if WHITE.match(c))
#: White space to str.split but not to SPACES.
SEPARATORS = re.compile("[\x1c-\x1f]")


def sized_units(text: str, target: int) -> list[tuple[str, int]]:
    """The units of a text as functions.text.units has them, each with its tokens: every word is counted once or twice, whatever the nesting."""
    words = (lambda t: [w for w in WHITE.split(t) if w]) if SEPARATORS.search(text) else str.split
    out = []

    def add(part: str, smaller) -> None:
        part = part.strip(WHITE_CHARS)
        if part:
            found = words(part)
            n = len(found) * 4 // 3
            if n <= target:
                out.append((part, n))
            else:
                smaller(part, found)

    def windows(_: str, found: list[str]) -> None:
        size = max(target * 3 // 4, 1)
        for i in range(0, len(found), size):
            window = found[i : i + size]
            out.append((" ".join(window), len(window) * 4 // 3))

    def sentences(part: str, _: list[str]) -> None:
        for sentence in SENTENCE_END.sub("\\1\0", part).split("\0"):
            add(sentence, windows)

    for paragraph in PARAGRAPH_END.split(text):
        add(paragraph, sentences)
    return out


def tail_start(sizes: list[int], start: int, end: int, overlap: int) -> int:
    """Where the last units of start..end (end excluded) begin whose tokens fit the overlap: at least one, and none for an overlap of nought."""
    size, at = 0, end
    while at > start and size < overlap and (at == end or size + sizes[at - 1] <= overlap):
        at -= 1
        size += sizes[at]
    return at


def spans(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Where each chunk of units of these sizes begins and ends (b excluded)."""
    out, start, size = [], 0, 0
    for i, n in enumerate(sizes):
        if size + n > target and i > start:
            out.append((start, i))
            start = tail_start(sizes, start, i, overlap)
            size = sum(sizes[start:i])
        size += n
    return [*out, (start, len(sizes))] if sizes else out


def packs(text: Column, target: int = 800, overlap: int | None = 100) -> Column:
    """text and units (how many) of each chunk: units packed greedily to about ``target`` tokens, each chunk beginning with the tail of the one before. overlap None: none.

    An Arrow function: a text is split once, and a row's cost is that of its words.
    """
    target = target if target > 0 else 800
    overlap = 0 if overlap is None else 100 if overlap <= 0 else overlap
    overlap = target // 4 if overlap >= target else overlap

    def of_text(t: str) -> list[dict]:
        us = sized_units(t, target)
        return [{"text": "\n\n".join(u for u, _ in us[a:b]), "units": b - a} for a, b in spans([n for _, n in us], target, overlap)]

    kind = pa.list_(pa.struct([("text", pa.string()), ("units", pa.int32())]))

    @F.arrow_udf("array<struct<text: string, units: int>>")
    def of_batch(texts: pa.Array) -> pa.Array:
        return pa.array((None if t is None else of_text(t) for t in (x.as_py() for x in texts)), kind)

    return of_batch(text)


def packed(text: Column, target: int = 800, overlap: int | None = 100) -> Column:
    """The texts of packs."""
    return F.transform(packs(text, target, overlap), lambda c: c["text"])


def chunk(docs: DataFrame, target: int = 800, overlap: int | None = 100, least_words: int = 0) -> DataFrame:
    """chunk_id (<document>#<position>), doc_id, position, text of every chunk of docs (doc_id, text) with enough prose."""
    texts = F.filter(packed(F.col("text"), target, overlap), lambda c: has_prose(c, least_words))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(texts).alias("position", "text"))
    return rows.select(F.concat("doc_id", F.lit("#"), F.col("position").cast("string")).alias("chunk_id"), "doc_id", "position", "text")
