"""Main text of web pages: markup verdicts, and a host suffix array where markup is silent.

A page is read once into blocks. A block inside ``article`` or ``main`` is main
text, one inside a menu, footer, advert, form and the like is not. For pages on
which markup names no main text, the token streams of the host's pages (all of
them, main text apart) are concatenated and a suffix array is built with the
common prefixes of neighbours. Suffixes whose prefixes of MIN_TOKENS agree stand
together in it; where such a run of suffixes comes from MIN_PAGES distinct pages
and a SHARE of the host's, the substring is boilerplate, and overlapping ones
make up long ones. Shorter blocks are compared as a whole. A block that
boilerplate covers by more than half is left out, any other kept whole. Pages
with the same text are one page for that, so copies of an article are no
evidence against it.

Repeats are not held against blocks that markup names main text: mirrored
articles and passages that many pages share would lose their text by it
(figures in the README).

A host's pages are dealt to shards of about SHARD pages by a hash of the page,
so the most frequent host is no larger a task than others. What its shards
find is counted over the whole host before any of them removes it, whatever
their number.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from strata.llm.common import checkpoint
from strata.llm.simhash import whole_groups

SHARD, MIN_TOKENS, MIN_PAGES = 1024, 20, 3
#: Boilerplate stands on this share of a host's pages at least, and on MIN_PAGES.
SHARE = 0.05

OPEN, MAIN, OTHER = 0, 1, 2
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "title", "textarea", "select", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "fieldset", "search"}
SCOPE = {"article", "aside", "body", "div", "dl", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "td", "th", "ul"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog"}
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead"
    " cookie cookies consent gdpr notice newsletter subscribe comment comments disqus reply replies respond share sharing social related recommended popup modal overlay login"
    " signin signup pagination pager".split()
)
MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[a-z]+")


def _verdict(name: str, attributes: str, inside: int) -> int:
    """What an element says of its content, given what stands around it."""
    if inside == OTHER:
        return OTHER
    if name in DROPPED or name == "header" and inside != MAIN:
        return OTHER
    if attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "role":
                if value == "main":
                    return MAIN
                if value in ROLES:
                    return OTHER
            elif key == "hidden" and not value or key == "aria-hidden" and value == "true":
                return OTHER
            elif key in ("class", "id") and name not in ("html", "body", "article", "main") and not NAMES.isdisjoint(WORDS.findall(value)):
                return OTHER
    return MAIN if name in ("article", "main") else inside


def blocks(html: str | None) -> list[tuple[str, int]]:
    """(text, verdict) of each non-empty block in page order: references decoded, white space made one space, trimmed."""
    if not html:
        return []
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    verdict = OPEN

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, verdict))
            held.clear()

    at, end = 0, len(html)
    while at < end:
        m = MARK.search(html, at)
        if m is None:
            held.append(unescape(html[at:]))
            break
        if m.start() > at:
            held.append(unescape(html[at : m.start()]))
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    verdict = stack[-1][1] if stack else OPEN
                    break
                if stack[k][0] in SCOPE and name not in SCOPE:
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at) if not m[3].endswith("/") or name in ("script", "style", "title", "textarea") else None
            if close:
                at = (html.find(">", close.end()) + 1) or end
            elif name in ("script", "style", "title", "textarea", "noscript", "template") and not m[3].endswith("/"):
                at = end
            continue
        if name == "br":
            held.append("\n")
            continue
        if name in BLOCK:
            flush()
            # A block ends an open paragraph, an item the item before it.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "dt", "dd", "tr", "option"):
                    del stack[k:]
                    verdict = stack[-1][1] if stack else OPEN
                    break
                if stack[k][0] in SCOPE:
                    break
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        mine = _verdict(name, m[3], verdict)
        if mine != verdict:
            flush()
        stack.append((name, mine))
        verdict = mine
    flush()
    return out


def suffix_array(streams: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, tokens that each shares with the one before it), both as far as ``least`` tokens tell.

    Prefix doubling: the ranks by the first 1, 2, 4, ... tokens give the order;
    the same ranks, widest first, give the common prefixes of neighbours.
    """
    n, width = len(streams), 1
    ranks = {1: np.unique(streams, return_inverse=True)[1].astype(np.int64)}
    while width < least:
        step, rank = min(width, least - width), ranks[width]
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        width += step
        ranks[width] = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(ranks[width], kind="stable")
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for w in sorted(ranks, reverse=True):
        live = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[live] = ranks[w][a[live]] == ranks[w][b[live]]
        # A suffix that ends within w tokens equals no other by rank.
        same &= shared[1:] + w <= least
        shared[1:] += np.where(same, w, 0)
        a, b = a + np.where(same, w, 0), b + np.where(same, w, 0)
    return order, shared


def _starts(streams: np.ndarray, runs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(where it starts, number) of every substring of ``least`` tokens that stays in its block. Those with the same number are the same."""
    n = len(streams)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, shared = suffix_array(streams, least)
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(shared < least) - 1
    start = np.flatnonzero(runs[: n - least + 1] == runs[least - 1 :])
    return start, number[start]


def _covered(n: int, start: np.ndarray, least: int) -> np.ndarray:
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + least, -1)
    return np.cumsum(covered)[:n] > 0


def _often(rank: np.ndarray, pages: np.ndarray, on_pages: int) -> np.ndarray:
    """Which substrings have a rank that stands on ``on_pages`` distinct pages."""
    if not len(rank):
        return np.zeros(0, bool)
    pairs = np.unique(np.stack([rank, pages]), axis=1)
    return np.bincount(pairs[0], minlength=int(rank.max()) + 1)[rank] >= on_pages


def repeated(streams: np.ndarray, pages: np.ndarray, runs: np.ndarray, least: int = MIN_TOKENS, on_pages: int = MIN_PAGES) -> np.ndarray:
    """Of concatenated token streams, which tokens lie in a substring of ``least`` or more tokens found on ``on_pages`` distinct pages.

    streams: token numbers; pages and runs: the page and the block of each
    token. Suffixes are ranked by their first 1, 2, 4, ... tokens; those equal
    in the first ``least`` share a rank and stand together in suffix order. No
    substring crosses from one block to the next.
    """
    start, rank = _starts(streams, runs, least)
    return _covered(len(streams), start[_often(rank, pages[start], on_pages)], least)


def _least_pages(pages, on_pages: int = MIN_PAGES, share: float = SHARE) -> int:
    """On how many of so many distinct pages of a host a substring is boilerplate."""
    return max(on_pages, math.ceil(share * pages))


def undecided(page: list[tuple[str, int]]) -> bool:
    """Whether markup names no main text and leaves a block open."""
    return not any(v == MAIN for _, v in page) and any(v == OPEN for _, v in page)


def _content(page: list[tuple[str, int]]) -> int:
    """A hash of what the page says: its main text, else its open blocks, else whatever it has."""
    least = MAIN if any(v == MAIN for _, v in page) else OPEN if any(v == OPEN for _, v in page) else OTHER
    return xxh64_intdigest("\n".join(t for t, v in page if v == least).encode("utf-8", "surrogatepass")) - 2**63


class Streams:
    """The token streams of pages' blocks outside main text, and their substrings of ``least`` tokens."""

    def __init__(self, pages: list[list[tuple[str, int]]], least: int = MIN_TOKENS):
        self.pages, self.least = pages, least
        self.place: list[tuple[int, int, int, int]] = []
        number: dict[str, int] = {}
        stream, owner, run, blocks_seen = [], [], [], 0
        for i, p in enumerate(pages):
            open_page = undecided(p)
            for j, (text, verdict) in enumerate(p):
                if verdict == MAIN:
                    continue
                words = text.split(" ")
                if verdict == OPEN and open_page:
                    self.place.append((i, j, len(stream), len(words)))
                # A block that is too short for a substring is filled up, and thus compared whole.
                fill = max(0, least - len(words))
                stream += [number.setdefault(w, len(number) + 1) for w in words] + [0] * fill
                owner += [i] * (len(words) + fill)
                run += [blocks_seen] * (len(words) + fill)
                blocks_seen += 1
        self.words = ["", *number]
        #: Each page's content, and each token's.
        self.content = np.array([_content(p) for p in pages], np.int64)
        self.stream, self.said = np.array(stream, np.int64), self.content[np.array(owner, np.int64)]
        self.start, self.rank = _starts(self.stream, np.array(run, np.int64), least)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of its words, which of them it is for each substring) of the distinct substrings."""
        _, first, which = np.unique(self.rank, return_index=True, return_inverse=True)
        text = (" ".join(self.words[t] for t in self.stream[a : a + self.least].tolist()) for a in self.start[first].tolist())
        return np.array([xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in text], np.uint64).view(np.int64), which

    def texts(self, often: np.ndarray) -> list[str]:
        """The main text of each page; often: which substrings count as boilerplate."""
        flags = _covered(len(self.stream), self.start[often], self.least)
        kept: dict[tuple[int, int], str] = {}
        for i, j, at, n in self.place:
            if 2 * int(flags[at : at + n].sum()) <= n:
                kept[i, j] = self.pages[i][j][0]
        out = []
        for i, p in enumerate(self.pages):
            if any(v == MAIN for _, v in p):
                found = [t for t, v in p if v == MAIN]
            else:
                found = [kept[i, j] for j, (_, v) in enumerate(p) if v == OPEN and kept.get((i, j))]
            out.append("\n\n".join(found))
        return out


def main_texts(pages: list[list[tuple[str, int]]], least: int = MIN_TOKENS, on_pages: int = MIN_PAGES, share: float = SHARE) -> list[str]:
    """The main text of each of a host's pages, given their blocks."""
    if not any(map(undecided, pages)):
        return ["\n\n".join(t for t, v in p if v == MAIN) for p in pages]
    s = Streams(pages, least)
    return s.texts(_often(s.rank, s.said[s.start], _least_pages(len(np.unique(s.content)), on_pages, share)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of pages.

    Null and empty html give an empty text; a null url counts as one host.
    Blocks are joined by blank lines; nothing is cut short. Repeated rows each
    get a row, and count as one page. Other columns aren't read. An empty
    table gives an empty result.

    Pages are read once, without a shuffle; texts that markup decides are
    written there and then. Of hosts with a page that it doesn't decide, the
    blocks outside main text are dealt to shards.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    out = "page_id string, url string, text string, n_chars long"

    def told(pdf: pd.DataFrame, texts: list) -> pd.DataFrame:
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": np.array([len(t or "") for t in texts], np.int64)})

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256].reset_index(drop=True)
                found = [blocks(h) for h in part["html"]]
                yield told(part, [None if undecided(p) else main_texts([p])[0] for p in found]).assign(host=part["host"])

    read = checkpoint(rows.mapInPandas(parsed, out + ", host string"))
    asking = checkpoint(read.where("text is null").select("host").distinct())
    decided = read.where("text is not null").select("page_id", "url", "text", "n_chars")
    if asking.isEmpty():
        return decided.withColumn("page_id", F.col("page_id").cast(kind))
    # Pages of the hosts that ask, in full; hosts are many and one may be large: AQE splits such a join.
    shards = read.join(asking.hint("merge"), "host", "left_semi").groupBy("host").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    spread = rows.join(checkpoint(shards).hint("merge"), "host")
    spread = spread.select("page_id", "url", "html", "host", F.pmod(F.xxhash64("page_id", "url", "html"), "shards").cast("int").alias("shard"))
    spread = spread.repartition("host", "shard")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["host", "shard"], least=256):
            for (name, shard), group in pdf.groupby(["host", "shard"], sort=False):
                s = Streams([blocks(h) for h in group["html"]])
                hashed, which = s.hashes()
                pairs = np.unique(np.stack([which, s.said[s.start]]), axis=1)
                pages = np.split(pairs[1], np.flatnonzero(np.diff(pairs[0])) + 1) if len(hashed) else []
                # The row without a run has all the shard's pages.
                runs = pd.array([None, *hashed.tolist()], dtype="Int64")
                yield pd.DataFrame({"host": name, "shard": shard, "run": runs, "pages": [np.unique(s.content), *pages]})

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [blocks(h) for h in left["html"]]
        s = Streams(found)
        hashed, which = s.hashes()
        own = np.array([undecided(p) for p in found], bool)
        texts = s.texts(np.isin(hashed, right["run"].to_numpy(np.int64))[which])
        return told(left[own].reset_index(drop=True), [t for t, mine in zip(texts, own, strict=True) if mine])

    counted = spread.sortWithinPartitions("host", "shard", "page_id", "url").mapInPandas(count, "host string, shard int, run long, pages array<long>")
    # All runs are counted: one that a shard has on a single page may stand on a page of every shard.
    counted = checkpoint(counted)
    # Each run's pages are made distinct before they are counted, so a run on all of a host's pages spreads over tasks.
    each = counted.select("host", "run", F.explode("pages").alias("page")).distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("n"))
    each = checkpoint(each)
    of = each.where("run IS NULL").select("host", F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("n") * F.lit(SHARE))).alias("least"))
    often = each.where("run IS NOT NULL").join(of.hint("merge"), "host").where("n >= least").select("host", "run")
    found = counted.select("host", "shard", "run").join(often.hint("merge"), ["host", "run"])
    mended = spread.groupBy("host", "shard").cogroup(found.groupBy("host", "shard")).applyInPandas(lambda a, b: cut(a, b), out)
    return decided.union(mended).withColumn("page_id", F.col("page_id").cast(kind))
