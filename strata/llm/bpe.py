"""BPE encoding and decoding over a contiguous rank array.

A word is held as two parallel arrays: the boundaries of its parts and the rank
of each part joined with its right neighbour. The least rank is found by a
scan, one boundary is deleted and the two ranks beside it are looked up again,
until no join has a rank. Words beyond SHORT symbols take a heap instead, which
gives the same joins without the quadratic scan.

Normalising, splitting and decoding follow the tokenizer file (NFC, white space,
lower case; a pattern whose matches are the pieces; byte-level symbols; a suffix
that ends a word; no decoder, hence tokens joined by one space).
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 64
NONE = 1 << 60
#: Distinct runs that a task remembers in each of two generations; a worker keeps none of them for later tasks, of this operator or another.
CACHE = 400_000
#: Letters that the installed regex module knows and the tokenizers library's tables don't yet.
TOO_NEW = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
)
#: Lower case that Unicode 16 and 17 added, after this Python's tables.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {0x16EA0 + i: 0x16EBB + i for i in range(25)} | {0x10D50 + i: 0x10D70 + i for i in range(22)} | {ord("Σ"): "σ"}
#: Code points of property White_Space, which the pattern's \s stands for.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Known(dict):
    """A function's results by key, in two generations of at most CACHE keys each: what isn't asked for goes with the older one."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> tuple[bytes, str]:
        found = self.older.get(key) or self.make(key)
        if len(key) <= SHORT:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Bpe:
    """A tokenizer read from a tokenizers JSON file of the word-end kind."""

    def __init__(self, spec: str | dict):
        import regex

        spec = json.loads(spec) if isinstance(spec, str) else spec
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.special.items()}
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        ids = self.vocab
        self.joins, self.made = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.joins[ids[a] << 32 | ids[b]] = rank
            self.made.append(ids[a + b])
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.final = [ids[s + self.suffix] for s in symbols]
        letter = rf"[\p{{L}}--[{TOO_NEW}]]"
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|\p{{N}}|[^{SPACE}\p{{N}}{letter}]+", regex.V1).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.odd = regex.compile("[" + "".join(map(chr, LOWER)) + "]").search
        # str.split() also splits at these four, which aren't of property White_Space.
        self.controls = regex.compile("[\x1c-\x1f]").search
        self.runs = regex.compile(f"[^{SPACE}]+").findall
        self.known = Known(self.run)

    def normal(self, text: str) -> str:
        """NFC and lower case, a character at a time: no final sigma."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = text.translate(LOWER) if self.odd(text) else text
        return text.lower()

    def merge(self, ids: list[int]) -> list[int]:
        """The ids after all joins, by least rank and, of equals, leftmost."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank_of, made = self.joins.get, self.made
        ids = [*ids]
        ranks = [rank_of(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == NONE:
                break
            at = ranks.index(rank)
            ids[at] = new = made[rank]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(new << 32 | ids[at + 1], NONE)
            if at:
                ranks[at - 1] = rank_of(ids[at - 1] << 32 | new, NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        ids, left, right = [*ids], [*range(-1, n - 1)], [*range(1, n + 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            k = right[i]
            if k < n and (rank := self.joins.get(ids[i] << 32 | ids[k])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[k]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            k = right[i]
            if ids[i] != a or k >= n or ids[k] != b:
                continue
            ids[i], ids[k], right[i] = self.made[rank], -1, right[k]
            if right[k] < n:
                left[right[k]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [t for t in ids if t >= 0]

    def piece(self, piece: str) -> tuple[bytes, str]:
        """A piece's ids as little-endian 32-bit words, and its tokens joined by spaces."""
        raw = piece.encode("utf-8", "replace")
        ids = [self.inner[b] for b in raw]
        # The suffix goes to the last symbol, each byte being one.
        ids[-1] = self.final[raw[-1]]
        ids = self.merge(ids)
        return array("I", ids).tobytes(), " ".join(map(self.tokens.__getitem__, ids))

    def run(self, run: str) -> tuple[bytes, str]:
        """The same of a run of characters without white space."""
        if run.isalpha() and max(run) < "\u0250":
            return self.piece(run)
        got = [*map(self.piece, self.pieces(run))]
        return got[0] if len(got) == 1 else (b"".join([a for a, _ in got]), " ".join([b for _, b in got]))

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The whole text's ids, packed, and what they decode to."""
        out: list[tuple[bytes, str]] = []
        for k, part in enumerate(self.parts(text or "")):
            if k % 2:
                out.append((array("I", [self.special[part]]).tobytes(), part))
                continue
            # No piece holds white space, so runs between it are encoded one by one and remembered.
            part = self.normal(part)
            out += map(self.known.__getitem__, self.runs(part) if self.controls(part) else part.split())
        if not out:
            return b"", ""
        ids, tokens = zip(*out, strict=True)
        return b"".join(ids), " ".join(tokens)

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, special ones among them; unknown ids are passed over."""
        return " ".join(t for i in ids if (t := self.tokens.get(i)) is not None)


@lru_cache(maxsize=2)
def _loaded(spec: str) -> Bpe:
    return Bpe(spec)


def bpe(docs: DataFrame, tokenizer_file: str | Path, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns ``keep`` (by default all but the text), with n_tokens, ids and decoded.

    ids is a binary of little-endian unsigned 32-bit token ids, decoded the
    text that those ids decode to, joined from them and not from the input.
    Null and empty texts have no ids and decode to "". Every row is encoded,
    whole; repeated rows repeat. A kept column whose name is n_tokens, ids or
    decoded is given up for the result's.

    The tokenizer file is read once on the driver and goes to the workers in
    the closure (about 1.7 MB), so executors need not see its path.
    """
    spec = Path(tokenizer_file).read_text(encoding="utf-8")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "n_tokens", "ids", "decoded")] if keep is None else keep
    broadcast = docs.sparkSession.sparkContext.broadcast(spec)
    others = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(others.alias("others"), F.col(text_col).alias("text"))
    kind = rows.schema["others"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = _loaded(broadcast.value)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    got = [model.encode(t) for t in part.column("text").to_pylist()]
                    ids = pa.array([a for a, _ in got], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("others"), pa.array([len(a) // 4 for a, _ in got], pa.int64()), ids, pa.array([b for _, b in got], pa.string())],
                        names=["others", "n_tokens", "ids", "decoded"],
                    )
        finally:
            model.known.forget()

    done = rows.mapInArrow(run, f"others {kind}, n_tokens bigint, ids binary, decoded string")
    return done.select(*[F.col("others")[c].alias(c) for c in keep], "n_tokens", "ids", "decoded")


def encoder(df: DataFrame, tokenizer_file: str | Path):
    """For use in tasks of df's session: makes a function from a text to packed ids."""
    sent = df.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))

    def make():
        model = _loaded(sent.value)
        return lambda text: model.encode(text)[0]

    return make


def unpack(ids: bytes) -> list[int]:
    """The token ids of a packed binary."""
    return array("I", ids).tolist()


def decode_column(model_file: str | Path):
    """A pandas UDF from packed ids to text."""
    spec = Path(model_file).read_text(encoding="utf-8")

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        model = _loaded(spec)
        return ids.map(lambda x: None if x is None else model.decode(unpack(x)))

    return decoded
