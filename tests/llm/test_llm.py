"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from strata.llm import bpe, exact, html, langid, mixing, queries, simhash, suffix_dedup, token_scan, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append((i, words(rng, rng.randrange(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 0))
    rows += [(100 + i, rows[i % 7][1], "en", "a", 0) for i in range(30)]
    for i in range(20):
        parts = rows[10 + i % 3][1].split()
        parts[rng.randrange(len(parts))] = "changed"
        rows.append((200 + i, " ".join(parts), "en", "b", 0))
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "  \n", "de", "b", 0), (303, "one", "en", "a", 0), (304, "Two Words", "en", "a", 0)]
    rows += [(305, words(rng, 20_000), "en", "c", 0), (7, rows[7][1], "en", "a", 0)]
    return spark.createDataFrame(rows, DOCS), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact(spark, docs):
    df, rows = docs
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = sorted((r[0], max(g := groups[r[1] or ""]), len(g), r[0] == max(g), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted(map(tuple, exact.exact_dedup(df).collect())) == want
    assert {r["keep_id"] for r in exact.exact_dedup(df, keep="smallest").collect()} == {min(g) for g in groups.values()}
    kept = exact.drop_exact(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact.exact_dedup(empty(spark)).count() == 0 and exact.drop_exact(empty(spark)).count() == 0
    clash = df.withColumnRenamed("lang", "digest").withColumnRenamed("source", "keep_id")
    assert sorted(map(tuple, exact.exact_dedup(clash).collect())) == want and exact.drop_exact(clash).count() == len(groups)


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "x"), (3, "x"), (None, "y")], "doc_id long, text string")
    assert sorted((str(r[0]), str(r[1]), r[3]) for r in exact.exact_dedup(df).collect()) == [("3", "3", True), ("None", "3", False), ("None", "None", True)]


def brute_print(text):
    from xxhash import xxh64_intdigest

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(lower)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(points, limit):
    """doc ids by position; points: (doc_id, fingerprint)."""
    label = list(range(len(points)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(points):
        for j in range(i):
            if (a ^ points[j][1]).bit_count() <= limit:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(points):
        least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{p:016x}", least[root(i)]) for i, (d, p) in enumerate(points)]


def test_simhash(spark, docs):
    df, rows = docs
    points = [(r[0], brute_print(r[1])) for r in rows]
    want = sorted(brute_groups(points, 4))
    assert sorted(map(tuple, simhash.simhash_groups(df).collect())) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})
    assert simhash.simhash_groups(empty(spark)).count() == 0
    kept = simhash.drop_near(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {w[2] for w in want}


def test_drop_near_judges_each_text_of_an_identifier(spark):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 200, 5000) for _ in range(4))
    # Null is a copy of 1 and alone on b; 5 is alone on c and a copy of 2.
    rows = [(1, a), (None, a), (None, b), (5, c), (2, d), (5, d), (7, None)]
    kept = simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, a), (None, b), (5, c), (2, d), (7, None)])


@pytest.mark.parametrize(("blocks", "picked", "cap"), [(None, 1, 4096), (3, 1, 4096), (2, 1, 40), (5, 1, 3), (1, 1, 4096), (6, 2, 4096), (7, 3, 2), (6, 3, 4096)])
def test_links_are_complete(spark, blocks, picked, cap):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(4))])
    points = np.unique(near)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fingerprint long")
    links = simhash.near_links(df, 4, blocks, picked, sample=150, leaf_cap=cap)
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    want = brute_groups([(int(x), int(np.int64(x).view(np.uint64))) for x in points.view(np.int64)], 4)
    assert {w[0]: w[2] for w in want} == {w[0]: got.get(w[0], w[0]) for w in want}


def test_components_of_a_path(spark):
    n = 70
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (501, 500)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {500: 500, 501: 500}


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file())


def test_bpe_equals_the_library(spark, docs):
    t, model = library(), bpe.Bpe(Path(queries.tokenizer_file()).read_text())
    rng = random.Random(2)
    bits = ["a", "Σ", "ΑΣ ", "İ", "é", "é", " ", "\n", "\x1c", "\x85", "​", "1", "½", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", "😀", "日本", "_", "x" * 300, "the", "ſ", "\x00", "ﬁ", "٣", "Dž", "Ა", "꟝"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)] + [r[1] or "" for r in docs[1]]
    for text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        raw, decoded = model.encode(text)
        assert bpe.unpack(raw) == ids and decoded == t.decode(ids, skip_special_tokens=False) == model.decode(ids), text


def test_bpe_long_and_short_words_merge_alike():
    model, rng = bpe.Bpe(Path(queries.tokenizer_file()).read_text()), random.Random(4)
    for _ in range(300):
        ids = [model.inner[rng.choice(b"etaoinshrdlu")] for _ in range(rng.randrange(1, 60))]
        assert model.merge(ids) == model._merge_long(ids)


def test_bpe_table(spark, docs):
    df, rows = docs
    done = bpe.bpe(df.withColumnRenamed("lang", "ids"), queries.tokenizer_file())
    assert done.columns == ["doc_id", "source", "n_chars", "n_tokens", "ids", "decoded"]
    got, t = done.collect(), library()
    want = Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r["doc_id"], tuple(bpe.unpack(r["ids"]))) for r in got) == want
    assert bpe.bpe(empty(spark), queries.tokenizer_file()).count() == 0
    again = done.select("decoded", bpe.decode_column(queries.tokenizer_file())("ids").alias("d")).collect()
    assert all(r["d"] == r["decoded"] for r in again)


def test_targets():
    got = mixing.targets({"a": 100, "b": 10, "c": 50, "d": 0}, {"a": 1, "b": 2, "c": 3, "d": 1})
    assert got["b"] == 30 and got["d"] == 0 and sum(got.values()) == 160
    assert got["c"] / got["a"] == 3


def test_route_spreads_before_it_repeats():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15})
    by_pattern = Counter()
    for (p, _), f in flow.items():
        by_pattern[p] += f
    assert by_pattern == {("a",): 10, ("a", "b"): 10, ("b",): 10}
    assert sum(mixing.route({("a",): 10}, {"a": 100}).values()) == 30


def test_mixing(spark, docs):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(0, 60)), "en", rng.choice(["a", "b", "c", None, "é"]), 0) for i in range(3000)] + [(9000, None, None, "a", None), (5, "again", "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = [r.asDict() for r in mixing.mix(df).collect()]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    goal = mixing.targets({s: sizes[s] for s in names}, {s: i % 3 + 1 for i, s in enumerate(names)})
    source = {(r[0], len(WORDS.findall(r[1] or ""))): r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - float(goal[s])) < 1e-6
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 1 for s in names)
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixing.mix(df.repartition(3)).collect())
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want = Counter({(r["doc_id"], r["size"]): r["taken"] // r["size"] for r in got if r["taken"]})
    assert Counter((r["doc_id"], len(WORDS.findall(r["text"]))) for r in out.collect()) == want
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_fit_narrows_to_single_hashes(spark):
    """Neighbouring hashes share a bin until its width is 1, with other hashes up to 2**64 away."""
    hashes = [-(2**63), 1 - 2**63, 2 - 2**63, 0, 2**62, 2**63 - 1]
    rows = spark.createDataFrame([(0, h, 5) for h in hashes], "pattern int, hash long, size long")
    spans = mixing._fit(spark, rows, {0: 12})[0]
    assert sum(any(a <= h < b and 5 <= most for a, b, most in spans) for h in hashes) == 2


def test_mixing_overlapping_sources(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(1, 20)), rng.choice([["a"], ["a", "b"], ["b"], None, ["\0null"], ["b", "a", "b"]])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    patterns = Counter()
    for _, t, x in rows:
        patterns[tuple(sorted({"=" + y for y in x} if x else {""}))] += len(t.split())
    names = ["=\0null", "=a", "=b", ""]
    sizes = {x: sum(n for p, n in patterns.items() if x in p) for x in names}
    goal = mixing.targets(sizes, {x: i % 3 + 1 for i, x in enumerate(names)}, sum(patterns.values()))
    flow = mixing.route(dict(patterns), goal)
    for p, n in patterns.items():
        mine = [got[i] for i, _, x in rows if tuple(sorted({"=" + y for y in x} if x else {""})) == p]
        assert {(r["source_size"], r["target"]) for r in mine} == {(sum(sizes[x] for x in p), float(sum(goal[x] for x in p)))}
        wanted = float(sum(f for (q, _), f in flow.items() if q == p))
        assert wanted - 20 <= sum(r["taken"] for r in mine) <= wanted + 1


def brute_route(capacity, quotas, repeats):
    """(words routed, least cost) over all ways in whole numbers."""
    import itertools

    arcs = [(p, s) for p in capacity for s in p]
    best = (0, 0)
    for flow in itertools.product(*(range(min(quotas[s], repeats * capacity[p]) + 1) for p, s in arcs)):
        by_pattern, by_source = Counter(), Counter()
        for (p, s), f in zip(arcs, flow, strict=True):
            by_pattern[p] += f
            by_source[s] += f
        if any(by_source[s] > q for s, q in quotas.items()) or any(f > repeats * capacity[p] for p, f in by_pattern.items()):
            continue
        cost = sum(sum(min(capacity[p], max(0, f - r * capacity[p])) * (r + 1) for r in range(repeats)) for p, f in by_pattern.items())
        best = max(best, (sum(flow), -cost))
    return best[0], -best[1]


def test_route_is_the_cheapest_of_the_largest_flows():
    rng = random.Random(3)
    for _ in range(25):
        sources = ["a", "b", "c"][: rng.randrange(2, 4)]
        capacity = {p: rng.randrange(1, 3) for p in rng.sample([("a",), ("b",), ("a", "b")] + ([("b", "c"), ("a", "b", "c")] if len(sources) == 3 else []), rng.randrange(2, 4))}
        quotas = {s: rng.randrange(0, 4) for s in sources}
        flow = mixing.route(capacity, quotas, 2)
        by_pattern = Counter()
        for (p, _), f in flow.items():
            by_pattern[p] += f
        cost = sum(sum(min(capacity[p], max(0, f - r * capacity[p])) * (r + 1) for r in range(2)) for p, f in by_pattern.items())
        assert (sum(flow.values()), cost) == brute_route(capacity, quotas, 2)


def brute_mixed(rows, goal, sizes):
    """Times each (doc_id, text) is taken: rows are (doc_id, text, source, hash); every source is a pattern of its own."""
    times = {}
    for source, size in sizes.items():
        whole, left = divmod(round(goal[source]), size) if size else (0, 0)
        mine = sorted(((h, i, t, len(WORDS.findall(t or ""))) for i, t, s, h in rows if s == source))
        more, want, low, want0 = set(), left, 0, left
        for _ in range(mixing.ROUNDS + 1):
            if not want or want < want0 * mixing.CLOSE:
                break
            most, at = want, low
            while at < len(mine):
                h = mine[at][0]
                same = [k for k in range(at, len(mine)) if mine[k][0] == h]
                fits = [k for k in same if 0 < mine[k][3] <= most]
                at += len(same)
                if sum(mine[k][3] for k in fits) > want:
                    break
                more |= set(fits)
                want -= sum(mine[k][3] for k in fits)
            low = at
        for k, (_, i, t, n) in enumerate(mine):
            times[i, t] = (whole + (k in more)) if n else 0
    return times


def toxic_fixture(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        parts = words(rng, rng.randrange(5, 80)).split()
        if bad:
            parts[rng.randrange(len(parts))] = rng.choice(["zorkish", "Zorkful", "zorked"])
        rows.append((i, " ".join(parts), "en", "a", 0))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame([*rows, (700, None, None, None, None), (701, "", "en", "a", 0)], DOCS), spark.createDataFrame([*marks, (3, 1, None), (5, 0, 0)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    df, marks = toxic_fixture(spark)
    model = toxicity.train(df, marks, keep=queries.part("doc_id", 5) != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    import zlib

    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.98 * len(held) > 50
    assert 0 <= got[700] == got[701] < 0.5
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.train(empty(spark), marks)
    assert none.score("anything") < 0.01
    long = "w1 " * 800_000 + "zorkish"
    assert model.score(long) == pytest.approx(model.score("w1 w1 w1 zorkish"), abs=0.2)


def brute_grams(text):
    """Buckets of a text's n-grams, each hashed on its own."""
    chars = [32 if c in "\t\n\x0b\x0c\r" else ord(c) for c in f" {text.lower()} "]
    out = set()
    for n in toxicity.NGRAMS:
        for i in range(len(chars) - n + 1):
            h = 0
            for c in chars[i : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (c * 0x9E3779B1 & 0xFFFFFFFF)
            h ^= n * 0x85EBCA6B & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            out.add((h ^ h >> 13) & toxicity.BUCKETS - 1)
    return out


def test_toxicity_against_a_plain_fit():
    """Sets of buckets, a dense matrix of log-count ratios and the same descent, written out."""
    rng = random.Random(16)
    texts = [" ".join([words(rng, rng.randrange(1, 12), 40), *(["zork"] * (i % 3 == 0))]) for i in range(90)] + ["", "A\tB"]
    labels = [int(i % 3 == 0 or i % 17 == 0) for i in range(90)] + [0, 1]
    held = [brute_grams(t) for t in texts]
    y = np.array(labels, float)
    n1, n0 = y.sum(), (1 - y).sum()
    kept = []
    for g in sorted(set().union(*held)):
        a = sum(g in x for x, label in zip(held, labels, strict=True) if label)
        b = sum(g in x for x, label in zip(held, labels, strict=True) if not label)
        if a + b >= 3 and a + b < n0 + n1:
            chi = (n0 + n1) * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n0 + n1 - a - b) * n0 * n1)
            if chi > 6.6:
                kept.append((g, np.log((a + 1) / (n1 + 2) / ((b + 1) / (n0 + 2)))))
    x = np.array([[r if g in grams else 0.0 for g, r in kept] for grams in held])
    share = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0)) / len(y)
    w, m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, toxicity.STEPS + 1):
        error = share * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y)
        grad = np.r_[x.T @ error + toxicity.RIDGE * w[:-1] / len(y), error.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = toxicity.fit(texts, labels)
    assert len(kept) > 5 and {g for g, _ in kept} == set(np.flatnonzero(model.weight).tolist())
    for text, row in zip(texts, x, strict=True):
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-(row @ w[:-1] + w[-1]))), abs=1e-4)


def test_bounds_on_bytes_and_names_of_ones_own(spark):
    rows = [(1, "zork a"), (1, "zork a"), (1, "other"), (2, "b" * 500), (3, "c"), (None, "d"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS _score", "'mine' AS _found", "7 AS y", "'x' AS lang")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.train(df, marks, sample_bytes=100)
    seen = toxicity.fit(["zork a", "other", "c", ""], [1, 1, 0, 0])
    assert got.score("zork a") == pytest.approx(seen.score("zork a")) and got.bias == pytest.approx(seen.bias)
    told = langid.predict(df, langid.train(df, sample_bytes=100)).collect()
    assert {r["_found"] for r in told} == {r["_score"] for r in told} == {"mine"} and {r["lang_pred"] for r in told} == {"x", "und"}
    twice = spark.createDataFrame([(i, "w1 w2", "a", 7) for i in range(4)], "doc_id long, text string, source string, _mix_size long")
    assert {tuple(r)[2:] for r in mixing.mixed(twice).collect()} == {("a", 7)}
    odd = twice.selectExpr("doc_id", "text", "source", "1 AS size", "2 AS hash", "3 AS row", "4 AS sources", "5 AS _print", "6 AS _gone", "7 AS _digest", "8 AS far", "9 AS cell")
    for out in (mixing.mixed(odd), simhash.drop_near(odd), exact.drop_exact(odd)):
        assert out.columns == odd.columns and {tuple(r)[3:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8, 9)}
    vectors = spark.createDataFrame([(i, [float(i)], i, 1, 2) for i in range(3)], "vec_id long, embedding array<double>, far long, shard int, asked int")
    assert topk.topk(vectors, vectors.vec_id == 0).count() == 2


def brute_language(learn, texts, longest=4):
    """The likeliest language of each text and its share, from plain counts."""
    import math

    langs = sorted({x for x, _ in learn})
    count = {x: Counter(w for y, t in learn if y == x for w in langid.words(t)) for x in langs}
    cut = lambda w, n: [(f"<{w}>" if n > 1 else w)[i : i + n] for i in range(max(1, len(w) + 2 * (n > 1) - n + 1))]
    tables = [{x: Counter({w: n for w, n in count[x].items() if n > 1}) for x in langs}]
    for n in range(1, longest + 1):
        tables.append({x: Counter(g for w, k in count[x].items() for g in cut(w, n) for _ in range(min(k, 3))) for x in langs})
    known = [set().union(*t.values()) for t in tables]
    value = lambda t, g, x: math.log((tables[t][x][g] + 0.5) / (sum(tables[t][x].values()) + 0.5 * (len(known[t]) + 1)))
    for text in texts:
        found = langid.words(text or "")
        if not found or not any(c.isalpha() for c in "".join(found)):
            yield "und", 0.0
            continue
        total = {x: math.log((sum(y == x for y, _ in learn) + 1) / (len(learn) + len(langs))) for x in langs}
        for w in found:
            grams, table = [w], 0
            for t, gs in [(0, [w]), *((n, cut(w, n)) for n in range(longest, 0, -1))]:
                grams, table = [g for g in gs if g in known[t]], t
                if grams:
                    break
            for x in langs:
                total[x] += sum(value(table, g, x) for g in grams) / len(grams) if grams else 0
        best = min(langs, key=lambda x: (-total[x], x))
        yield best, 1 / sum(math.exp(total[x] - total[best]) for x in langs)


def test_language_against_plain_counts(spark):
    rng = random.Random(21)
    vocabulary = {"en": "the of and with this from ness wording", "de": "der und mit nicht schön für heit von", "fr": "le la avec être où ment des"}
    text = lambda x: " ".join(rng.choice(vocabulary[x].split()) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randrange(1, 9)))
    learn = [(x, text(x)) for x in rng.choices([*vocabulary], k=60)]
    asked = [text(rng.choice([*vocabulary])) for _ in range(60)] + [None, "", "12 34", "zzz qqq", "über-the 7 ÊTRE"]
    rows = [(i, t, x) for i, (x, t) in enumerate(learn)] + [(100 + i, t, None) for i, t in enumerate(asked)] + [(None, "der der", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, langid.train(df)).where("doc_id >= 100").collect()}
    for i, (lang, share) in enumerate(brute_language(learn, asked)):
        assert got[100 + i][0] == lang and got[100 + i][1] == pytest.approx(share, abs=1e-4)


def test_language_sample_is_that_of_least_hash(spark):
    rows = [(i, f"word{i} stays", "big" if i % 9 else "small") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    order = df.selectExpr("lang", "text", "xxhash64(cast(doc_id AS string), text) AS h").collect()
    want = {t for x in ("big", "small") for _, t in sorted((r["h"], r["text"]) for r in order if r["lang"] == x)[:50]}
    learnt = set()
    original = langid.Model
    try:
        langid.Model = lambda samples: learnt.update(t for _, t in samples)
        langid.train(df, sample=50)
    finally:
        langid.Model = original
    assert learnt == want


def test_language(spark):
    langs = {"en": "the of and with this from ness", "de": "der und mit nicht schön für heit", "fr": "le la avec être où ment"}
    rng, rows = random.Random(7), []
    for i in range(300):
        lang = rng.choice([*langs])
        rows.append((i, " ".join(rng.choice(langs[lang].split()) for _ in range(rng.randrange(3, 40))), lang, "a", 0))
    df = spark.createDataFrame([*rows, (400, None, "en", "a", 0), (401, "12 34 !", "en", "a", 0), (402, "schönheit", None, "a", 0)], DOCS)
    model = langid.train(df, keep=queries.part("doc_id", 3) != 1)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    assert sum(got[r[0]][0] == r[2] for r in rows) >= 0.98 * len(rows)
    assert got[400] == got[401] == ("und", 0.0) and got[402][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(empty(spark), langid.train(empty(spark))).count() == 0
    assert langid.Model([]).predict("words") == ("und", 0.0)


PAGE = '<html><head><title>T</title></head><body class="x"><header><h2>Site</h2></header><nav><ul><li>Home<li>News</ul></nav>{}<footer>&copy; x</footer></body></html>'


def test_html_blocks():
    page = PAGE.format('<script>var a="</p>";</script><article><h1>A &amp; B</h1><p>One<br>two &#233;<p><b>Three</b> \n four<div class="share-bar">Share</div><div id="comments"><p>me too</p></div><!-- <p>no</p> --><p hidden>h</p></article>')
    assert html.main_texts([html.blocks(page)]) == ["A & B\n\nOne two é\n\nThree four"]
    assert html.main_texts([html.blocks(None), html.blocks(""), html.blocks("<p>only"), html.blocks("<article><p>cut <b")]) == ["", "", "only", "cut"]


def test_html_suffix_array_removes_what_a_host_repeats():
    body = '<div>Welcome to our site dear reader</div><div>{}</div><div>Call us on five five five</div>'
    texts = [f"story number {i} about subject {i * 7} and more" for i in range(6)]
    pages = [html.blocks(f"<body>{body.format(t)}</body>") for t in texts]
    assert html.main_texts(pages) == texts
    assert html.main_texts(pages[:1]) == ["\n\n".join(["Welcome to our site dear reader", texts[0], "Call us on five five five"])]


def test_repeated_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        owner = np.sort(rng.integers(0, 5, 60))
        stream = rng.integers(0, 3, 60)
        got = html.repeated(stream, owner, owner, 5, 2)
        where = defaultdict(set)
        for i in range(56):
            if owner[i] == owner[i + 4]:
                where[tuple(stream[i : i + 5])].add(owner[i])
        want = np.zeros(60, bool)
        for i in range(56):
            if owner[i] == owner[i + 4] and len(where[tuple(stream[i : i + 5])]) > 1:
                want[i : i + 5] = True
        assert (got == want).all()


def test_html_table(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", PAGE.format(f"<article><p>text {i}</p></article>"), i, "t", 5) for i in range(50)]
    rows += [(90, None, None, 0, None, 0), (91, "bad", "", 0, None, 0), (1, "http://h1.org/1", PAGE.format("<article>again</article>"), 0, None, 0), (None, None, "<article>no id", 0, None, 0)]
    # Columns named like those that the operator makes for itself.
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host long, text string, shard int")
    got = html.extract(df).collect()
    want = [(i, f"text {i}", len(f"text {i}")) for i in range(50)] + [(90, "", 0), (91, "", 0), (1, "again", 5), (None, "no id", 5)]
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in got) == Counter(want)
    assert html.extract(df.limit(0)).count() == 0


def brute_main_texts(pages, least=20):
    """Of (id, blocks outside markup that names them) of one host: runs of words as tuples, whole short blocks too, against the pages that hold them."""
    where, said = defaultdict(set), {}
    runs = lambda t: [tuple(w[i : i + least]) for w in [t.split()] for i in range(max(1, len(w) - least + 1))]
    for i, parts in pages:
        said[i] = tuple(parts)
        for t in parts:
            for r in runs(t):
                where[r].add(said[i])
    need = max(3, -(-len(set(said.values())) // 20))
    out = {}
    for i, parts in pages:
        kept = []
        for t in parts:
            w = t.split()
            covered = set()
            for k, r in enumerate(runs(t)):
                if len(where[r]) >= need:
                    covered |= set(range(k, k + max(least, len(w)) if len(w) < least else k + least))
            if 2 * len([c for c in covered if c < len(w)]) <= len(w):
                kept.append(t)
        out[i] = "\n\n".join(kept)
    return out


@pytest.mark.parametrize("n", [900, 1030, 5000])
def test_html_of_a_host_of_any_size(spark, n):
    rng, pages = random.Random(n), []
    notice, other = words(rng, 26, 9000), words(rng, 8, 9000)
    for i in range(n):
        parts = [words(rng, 24, 9000)]
        # A notice on a tenth, a short block on a twelfth, a rare one on a fiftieth, and a notice within a longer block.
        parts += [notice] * (i % 10 == 0) + [other] * (i % 12 == 1) + ["seldom seen here"] * (i % 50 == 2) + [f"{words(rng, 3)} {notice} {words(rng, 2)}"] * (i % 30 == 3)
        pages.append((i, parts))
    pages += [(n + i, pages[5][1]) for i in range(n // 9)]
    rows = [(i, "https://one.org/x", "<body>" + "".join(f"<div>{t}</div>" for t in parts)) for i, parts in pages]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = brute_main_texts(pages)
    assert {r["page_id"]: r["text"] for r in got.collect()} == want
    assert notice not in want[10] and want[2].endswith("seldom seen here") and other not in want[1] and want[n] == want[5]


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, least = int(rng.integers(1, 40)), int(rng.integers(1, 24))
        stream = rng.integers(0, 3, n)
        order, shared = html.suffix_array(stream, least)
        found = [tuple(stream[i : i + least]) for i in order]
        assert found == sorted(found) and shared[0] == 0
        for a, b, k in zip(found, found[1:], shared[1:], strict=False):
            assert a[:k] == b[:k] and (k >= min(len(a), len(b)) or a[k] != b[k])


def test_html_counts_over_all_shards_of_a_host(spark, monkeypatch):
    monkeypatch.setattr(html, "SHARD", 4)
    notice = "<div>please accept the terms of this fine site before reading any further page of it or leave now for good</div>"
    story = lambda i: " ".join(f"s{i}x{n}" for n in range(30))
    rows = [(i, f"http://big.org/{i}", f"<body>{notice if i % 8 == 0 else ''}<div>{story(i)}</div></body>") for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: story(i) for i in range(40)}


def test_html_keeps_phrases_headings_and_copied_articles():
    story = lambda i: " ".join(f"s{i}x{n}" for n in range(30))
    page = lambda *b: html.blocks("<body>" + "".join(f"<div>{x}</div>" for x in b) + "</body>")
    notice = " ".join(f"n{n}" for n in range(25))
    pages, want = [], []
    for i in range(100):
        text = f"{story(i)} at the end of the day {story(-i - 1)}"
        head = ["Introduction"] if i < 3 else []
        pages.append(page(*head, text, f"{notice} page {i}"))
        want.append("\n\n".join([*head, text]))
    copied = [story(500), story(501)]
    pages += [page(*copied)] * 20
    want += ["\n\n".join(copied)] * 20
    assert html.main_texts(pages) == want


def test_html_copies_in_several_shards_are_one_page(spark, monkeypatch):
    monkeypatch.setattr(html, "SHARD", 4)
    article = " ".join(f"w{n}" for n in range(60))
    rows = [(i, f"http://big.org/{i}", f"<body><nav>{i} of 30</nav><div>{article}</div></body>") for i in range(30)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == dict.fromkeys(range(30), article)


@pytest.mark.parametrize(("tokens", "block"), [(4, 4), (7, 3), (64, 5), (1000, 1)])
def test_token_scan(spark, tmp_path, tokens, block):
    """Ranges and blocks of any length against one pass over each file; a file of many ranges spreads over tasks."""
    rng, want = random.Random(4), []
    for f in range(6):
        flat = [rng.choice([0, 1, 2, 3]) for _ in range(rng.randrange(0, 90) if f else 900)]
        (tmp_path / f"f{f}").write_bytes(np.array(flat, "<u4").tobytes())
        start, ordinal = 0, 0
        for i, t in enumerate([*flat, None]):
            if t == 0 or t is None and start < i:
                want.append((f"f{f}", ordinal, start, i - start))
                start, ordinal = i + 1, ordinal + 1
    spans = token_scan.token_files(spark, str(tmp_path), tokens=tokens)
    assert spans.where("file like '%f0'").count() == -(-900 // tokens)
    got = token_scan.count_tokens(spans, 0, block=block).collect()
    assert sorted((Path(r["file"]).name, *r[1:]) for r in got) == sorted(want)


def test_token_rows_list_few_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_scan, "LISTED", 5)
    (tmp_path / "a.bin").write_bytes(np.array([5, 9, *[9] * 23, 7, 7, 7, 9, 1], "<u2").tobytes())
    got = token_scan.count_tokens(token_scan.token_files(spark, str(tmp_path), 2), 9, 2).collect()
    assert sorted((r["ordinal"], r["n_tokens"]) for r in got) == [(0, 1), *((i, 0) for i in range(1, 24)), (24, 3), (25, 1)]
    (tmp_path / "b.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        token_scan.token_files(spark, str(tmp_path), 2).collect()


def test_token_counts_query(spark, sf_dir):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op6_token_counts(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: r["n_tokens"] for r in queries.op2_bpe(spark, sf_dir).collect()}


def brute_spans(rows, length=50):
    where, out = defaultdict(set), []
    texts = {(d, t): WORDS.findall(t) for d, t in rows if d is not None and t}
    for (d, _), w in texts.items():
        for i in range(len(w) - length + 1):
            where[tuple(w[i : i + length])].add(d)
    for (d, _), w in texts.items():
        end = None
        for i in range(len(w) - length + 1):
            if len(where[tuple(w[i : i + length])]) > 1:
                if end is not None and i <= end:
                    end = i + length
                else:
                    if end is not None:
                        out.append((d, start, end, end - start))
                    start, end = i, i + length
        if end is not None:
            out.append((d, start, end, end - start))
    return sorted(out)


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_suffix_dedup(spark, chunk, monkeypatch):
    rng, rows = random.Random(11), []
    shared = [words(rng, n, 5000) for n in (49, 50, 51, 80, 200)]
    for i in range(120):
        rows.append((i, " ".join([words(rng, rng.randrange(0, 60), 5000), rng.choice(shared), words(rng, rng.randrange(0, 60), 5000), rng.choice(shared)])))
    rows += [(200, shared[1]), (201, words(rng, 60, 1)), (202, words(rng, 300, 5000) + " " + shared[3] + " " + shared[3]), (203, None), (204, ""), (None, shared[4])]
    # One identifier on two texts, with repeats at different places, once more as it stands, and a passage in its texts alone.
    base, own = words(rng, 90, 5000).split(), words(rng, 70, 5000)
    rows += [(5, " ".join(base[:60]) + " x " + own), (5, " ".join(["y"] * 30 + base[30:])), (5, own), (5, own), (206, " ".join(base))]
    # The same words with one changed in the middle, and passages that agree to the left in one pair and to the right in another.
    rows += [(210, " ".join(base[:40] + ["z"] + base[41:])), (211, " ".join(base[20:70])), (212, " ".join(base[40:] + base[:45]))]
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.repeats(df).collect()))
    assert got == brute_spans(rows)
    assert (5, 0, 60, 60) in got and (5, 30, 90, 60) in got and not any(r[0] in (201, 203, 204, None) for r in got)
    assert suffix_dedup.repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [8192, 40])
def test_topk(spark, shard):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)).round(1))] + [(300 + i, [0.5] * 6) for i in range(40)]
    rows += [(400, None), (450, [float("nan")] + [0.0] * 5), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("inf")] * 6), (450, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in good if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.topk(df, df.vec_id % 50 == 0, shard=shard).collect())) == sorted(want)
    assert topk.topk(df.limit(0), df.vec_id % 50 == 0).count() == 0
    two = topk.topk(df.where("vec_id in (0, 1, 2)"), df.vec_id % 50 == 0).collect()
    assert [r["rank"] for r in sorted(two)] == [1, 2]


@pytest.mark.parametrize("scale", [1, 1 << 22])
@pytest.mark.parametrize("copies", [2, 10])
def test_topk_of_a_query_id_that_repeats(copies, scale):
    rng = np.random.default_rng(copies)
    ids = np.r_[np.zeros(copies, np.int64), np.arange(1, 257 - copies)]
    rows = rng.integers(-90, 90, (256, 8)) * scale
    rows[:copies] = 100 * scale
    q, i, s = topk.search(ids, rows, np.array([0, 300]), rows[[0, 20]], np.full(2, -np.inf), 5)
    for n, (own, asked) in enumerate([(0, rows[0]), (300, rows[20])]):
        want = sorted((-int(a @ asked), int(x)) for x, a in zip(ids, rows, strict=True) if x != own)[:5]
        assert [(-int(b), int(a)) for a, b in zip(i[q == n], s[q == n], strict=True)] == want


def test_oracles(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        got = sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())
        cols = ", ".join(sorted(df.columns))
        assert got == sorted(con.execute(f"SELECT {cols} FROM ({sql})").fetchall())


def test_pipeline_against_plain_stages(spark, sf_dir):
    """run() row for row: each stage written out in Python over the model, hashes and tokenizer that the operators share."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r["text"]) < 0.5]
    keep = {}
    for r in rows:
        keep[r["text"] or ""] = max(keep.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    rows = [r for r in rows if r["doc_id"] == keep[r["text"] or ""]]
    least = {w[2] for w in brute_groups([(r["doc_id"], brute_print(r["text"])) for r in rows], 4)}
    rows = [r for r in rows if r["doc_id"] in least]
    hashed = {r[0]: r[1] for r in spark.createDataFrame([(r["doc_id"], r["text"] or "") for r in rows], "i long, t string").selectExpr("i", "xxhash64(17, cast(i AS string), t) AS h").collect()}
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    goal = mixing.targets({s: sizes[s] for s in names}, {s: i % 3 + 1 for i, s in enumerate(names)})
    times = brute_mixed([(r["doc_id"], r["text"], r["source"], hashed[r["doc_id"]]) for r in rows], goal, {s: sizes[s] for s in names})
    t, want = library(), Counter()
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), np.array(ids, "<u4").tobytes()] += times[r["doc_id"], r["text"]]
    got = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in got.collect()) == +want
    assert len(rows) < docs.count() and sum(want.values()) > 50


def test_pipeline_stages_on_odd_tables(spark, sf_dir):
    """Nulls, empties, repeats, clashing columns and an empty table, stage by stage."""
    import corpus_pipeline

    rows = [(1, "a b c", None, None, 3), (1, "a b c", None, None, 3), (None, None, None, "x", None), (2, "", "en", "x", 0), (None, "d e", "en", "y", 3)]
    odd = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS _score", "2 AS _digest", "3 AS hash", "4 AS n_tokens")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert "_score" in out.columns and out.columns.count("n_tokens") == 1 and out.where("_score <> 1 OR hash <> 3").count() == 0
        none = stage(spark, odd.limit(0), sf_dir)
        assert none.count() == 0 and none.columns == out.columns, name
    kept = {name: stage(spark, odd, sf_dir).count() for name, stage in corpus_pipeline.STAGES}
    assert kept["toxicity"] == 5 and kept["exact dedup"] == 3 and kept["BPE encoding and decoding"] == 5


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert k == 3 or len(ids) == len(set(ids)) <= n
            n = len(ids)
    assert out.count() == n
    texts = [r["text"] for r in docs.collect()]
    t = library()
    assert sorted(r["n_tokens"] for r in out.collect()) == sorted(len(t.encode(x or "", add_special_tokens=False).ids) for x in texts)


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 90))
        group, side = np.sort(rng.integers(0, 3, n)), rng.integers(1, 4, n)
        base = rng.integers(0, 2**63, 3).astype(np.uint64)
        bits = base[rng.integers(0, 3, n)].copy()
        for _ in range(int(rng.integers(0, 5))):
            bits ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)

        def least(pairs, n=n):
            up = list(range(n))

            def root(x):
                return x if up[x] == x else root(up[x])

            for a, b in pairs:
                up[max(root(a), root(b))] = min(root(a), root(b))
            return [root(i) for i in range(n)]

        pairs = [(i, j) for i in range(n) for j in range(i) if group[i] == group[j] and (side[i] | side[j]) == 3 and int(bits[i] ^ bits[j]).bit_count() <= 4]
        member, other = simhash._links(group, side, bits, np.full(n, base[0]), 4)
        assert least(zip(member.tolist(), other.tolist(), strict=True)) == least(pairs)
        assert len(set(member.tolist())) == len(member)  # a forest: a link a row at most


def test_links_of_a_crowded_cell_take_memory_by_rows():
    import tracemalloc

    n, rng = 8192, np.random.default_rng(5)
    bits = np.full(n, np.uint64(99)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    tracemalloc.start()
    member, _ = simhash._links(np.zeros(n, int), np.full(n, 3), bits, np.full(n, np.uint64(99)), 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(member) == n - 1 and most < 16 << 20  # all pairs would take over 500 MB
