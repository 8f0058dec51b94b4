"""Queries over the driver's tables, one or more per operator, and the same in SQL.

Roles: documents are the corpus, benchmark the questions, embeddings the vector
index (with the mean of each label as a question), conversations the memory,
customer, nation and region the graph, orders and lineitem the structured tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.functions.vectors import doubles, dot, md5_embedding, unit
from strata.operators import chunking, cluster, evidence, graph, lexical, memory, router, search
from strata.operators.sized import spread
from strata.plans import compat, guard
from strata.sources import cache, tables
from strata.streaming.ingest import windowed_counts

STOP = ", ".join(f"'{w}'" for w in sorted(T.STOPWORDS))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toks(x: str) -> str:
    return f"[t FOR t IN string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+') IF t <> '' AND t NOT IN ({STOP})]"


def flds(x: str) -> str:
    return f"[w FOR w IN string_split_regex({x}, '\\s+') IF w <> '']"


def key(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^the ', '')"


# --- structured ---


def strings(spark, sf_dir, *names):
    return {n: tables.as_strings(read(spark, sf_dir, n)) for n in names}


@query("SELECT CAST(count(*) AS VARCHAR) AS n, CAST(sum(o_custkey) AS VARCHAR) AS total FROM orders WHERE lower(o_orderstatus) = 'f' AND o_custkey > 100")
def sql_count_sum_where(spark, sf_dir):
    """COUNT and SUM over a conjunction: text compared whatever its case, numbers as numbers."""
    return compat.run("SELECT COUNT(*) AS n, SUM(o_custkey) AS total FROM orders WHERE o_orderstatus = 'f' AND o_custkey > 100", strings(spark, sf_dir, "orders"))


@query("SELECT CAST(min(c_custkey) AS VARCHAR) AS low, CAST(max(c_custkey) AS VARCHAR) AS high, min(c_name) AS first, max(c_name) AS last FROM customer")
def sql_min_max(spark, sf_dir):
    """MIN and MAX as numbers where all cells are, else as text."""
    return compat.run("SELECT MIN(c_custkey) AS low, MAX(c_custkey) AS high, MIN(c_name) AS first, MAX(c_name) AS last FROM customer", strings(spark, sf_dir, "customer"))


@query("SELECT round(avg(l_linenumber), 6) AS mean FROM lineitem WHERE l_returnflag <> 'N'")
def sql_avg(spark, sf_dir):
    """AVG over rows of a string table."""
    return compat.run("SELECT AVG(l_linenumber) AS mean FROM lineitem WHERE l_returnflag <> 'n'", strings(spark, sf_dir, "lineitem")).select(F.round(F.col("mean").cast("double"), 6).alias("mean"))


@query("SELECT c_mktsegment AS segment, CAST(count(*) AS VARCHAR) AS n, CAST(max(c_custkey) AS VARCHAR) AS newest FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4")
def sql_group_order_limit(spark, sf_dir):
    """GROUP BY, ORDER BY a label as numbers, LIMIT."""
    return compat.run("SELECT c_mktsegment AS segment, COUNT(*) AS n, MAX(c_custkey) AS newest FROM customer GROUP BY c_mktsegment ORDER BY n DESC LIMIT 4", strings(spark, sf_dir, "customer"))


@query("SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation WHERE n_regionkey >= 2")
def sql_project(spark, sf_dir):
    """Projection with an alias."""
    return compat.run("SELECT n_name AS name, n_regionkey FROM nation WHERE n_regionkey >= 2", strings(spark, sf_dir, "nation"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def sql_star(spark, sf_dir):
    """SELECT * with its header spelt out."""
    return compat.run("SELECT * FROM region ORDER BY r_regionkey", strings(spark, sf_dir, "region"))


@query(
    "SELECT c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey"
    " WHERE o_orderstatus = 'F' GROUP BY 1"
)
def sql_native_join(spark, sf_dir):
    """A guarded read with a join, which Spark plans; the views are gone before the result is read."""
    text = "SELECT c_mktsegment AS segment, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total FROM {customer} JOIN {orders} ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment"
    guard.check_text(text)
    return spark.sql(text, customer=read(spark, sf_dir, "customer"), orders=read(spark, sf_dir, "orders"))


STATEMENTS = [
    "SELECT a FROM t", "select 'drop; it''s' FROM t;", "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT a FROM t; DROP TABLE t", "DROP TABLE t", "SELECT a -- b", "SELECT a INTO b FROM t",
    "SELECT 'open FROM t", "UPDATE t SET a = 1", "", "SELECTED", "select created_at from t", "SELECT a FROM t WHERE b = 'delete'", "EXPLAIN SELECT 1", "SELECT /* x */ 1",
]
VALUES = ", ".join(f"({i}, '{s.replace(chr(39), chr(39) * 2)}')" for i, s in enumerate(STATEMENTS))


@query(
    f"""WITH s(id, q) AS (VALUES {VALUES}), b AS (SELECT id, q, regexp_replace(regexp_replace(trim(q), ';$', ''), '''([^'']|'''')*''', '', 'g') AS bare FROM s)
    SELECT CAST(id AS INTEGER) AS id, q <> '' AND NOT regexp_matches(q, '--|/\\*|#') AND NOT contains(bare, '''') AND NOT contains(bare, ';')
      AND regexp_matches(bare, '^(?i)\\s*(select|with)\\b') AND NOT regexp_matches(lower(bare), '\\b({'|'.join(sorted(guard.FORBIDDEN))})\\b') AS accepted FROM b"""
)
def sql_guard(spark, sf_dir):
    """The read-only guard over a list of statements."""

    def passes(q):
        try:
            guard.check_text(q)
            return True
        except guard.NotReadOnly:
            return False

    return spark.createDataFrame([(i, passes(s)) for i, s in enumerate(STATEMENTS)], "id int, accepted boolean")


# --- lexical ---


@query(f"WITH d AS (SELECT doc_id, list_distinct({toks('text')}) AS ts FROM documents), u AS (SELECT unnest(ts) AS term FROM d) SELECT term, count(*) AS df FROM u GROUP BY term")
def token_df(spark, sf_dir):
    """Document frequency of every term."""
    return lexical.document_frequency(read(spark, sf_dir, "documents"), "doc_id")


@query(f"SELECT count(*) AS n, CAST(coalesce(sum(len({toks('text')})), 0) AS BIGINT) AS total_len FROM documents")
def doc_len_stats(spark, sf_dir):
    """Number of documents and of their tokens."""
    return lexical.corpus_stats(read(spark, sf_dir, "documents"))


BM25 = f"""
    d AS (SELECT doc_id, {toks('text')} AS ts FROM documents),
    p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
    q AS (SELECT item_id, unnest({toks('text')}) AS term FROM benchmark), qf AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY 1, 2),
    sc AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
           FROM qf JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
    bm AS (SELECT item_id AS query_id, doc_id AS id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


def questions(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM25} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    """The 20 best documents of every benchmark passage by BM25."""
    return lexical.bm25(spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), questions(spark, sf_dir), 20, "doc_id")


# --- vectors and fusion ---

CENTRES = """
    e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
    x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2),
    c AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM m GROUP BY label),
    s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v, q), 6) AS score FROM e, c),
    vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def centres(spark, sf_dir):
    parts = read(spark, sf_dir, "embeddings").select("label", F.posexplode(doubles(F.col("embedding"))).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def units(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", unit(doubles(F.col("embedding"))).alias("vector"))


@query(f"WITH {CENTRES} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM vr WHERE rank <= 20")
def vector_topk(spark, sf_dir):
    """The 20 vectors nearest to the mean of each label."""
    return search.vector_topk(read(spark, sf_dir, "embeddings"), centres(spark, sf_dir), 20, "vec_id", "embedding")


@query(
    f"WITH {CENTRES}, o AS (SELECT label AS query_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings),"
    " l AS (SELECT query_id, id, rank FROM vr WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM o WHERE rank <= 50),"
    " f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score FROM l GROUP BY 1, 2),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)"
    " SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"
)
def rrf_fusion(spark, sf_dir):
    """Reciprocal-rank fusion of nearness with order of arrival among the label's vectors."""
    rows = read(spark, sf_dir, "embeddings")
    near = search.vector_topk(rows, centres(spark, sf_dir), 50, "vec_id", "embedding")
    first = Window.partitionBy("label").orderBy("vec_id")
    old = rows.select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), F.row_number().over(first).alias("rank")).where("rank <= 50")
    return search.fuse([near, old], 10)


@query(
    f"""WITH {BM25}, b AS (SELECT doc_id AS id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS k, sum(tf) AS x FROM tf GROUP BY 1, 2),
    bn AS (SELECT id, sqrt(sum(x * x)) AS n FROM b GROUP BY id),
    qb AS (SELECT item_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS k, sum(qtf) AS x FROM qf GROUP BY 1, 2),
    qn AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM qb GROUP BY item_id),
    cs AS (SELECT item_id AS query_id, b.id, round(sum(b.x * qb.x / (bn.n * qn.n)), 6) AS score FROM b JOIN qb USING (k) JOIN bn ON bn.id = b.id JOIN qn USING (item_id) GROUP BY 1, 2),
    cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs),
    l AS (SELECT query_id, id, rank FROM cr WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM bm WHERE rank <= 50),
    f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score FROM l GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)
    SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def hybrid_topk(spark, sf_dir):
    """Hybrid search: vectors of hashed tokens and BM25, fused."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn("vector", md5_embedding(F.col("text")))
    asked = questions(spark, sf_dir).withColumn("vector", md5_embedding(F.col("text")))
    return search.hybrid(docs, asked, 10, "doc_id")


@query(
    f"WITH {CENTRES}, h AS (SELECT query_id, id, rank FROM vr WHERE rank <= 20), g AS (SELECT *, CASE WHEN rank % 3 = 0 THEN CAST(id % 7 AS DOUBLE) ELSE -1.0 END AS score FROM h),"
    " r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM g) SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"
)
def rerank(spark, sf_dir):
    """A reranker that scores every third hit: scored ones first, the others in their order."""
    hits = search.vector_topk(read(spark, sf_dir, "embeddings"), centres(spark, sf_dir), 30, "vec_id", "embedding")
    given = hits.where("rank % 3 = 0").select("query_id", (F.col("rank") - 1).alias("position"), (F.col("id") % 7).alias("score"))
    return search.rerank(hits, given, 5)


@query(
    f"WITH {CENTRES}, a AS (SELECT id, query_id AS cluster, row_number() OVER (PARTITION BY id ORDER BY score DESC, query_id) AS n FROM s) SELECT id AS vec_id, cluster FROM a WHERE n = 1"
)
def kmeans_assign(spark, sf_dir):
    """Each vector's nearest mean, by cosine; the lower label of equals."""
    means = centres(spark, sf_dir).orderBy("query_id").select("query_id", unit(F.col("vector")).alias("q")).collect()  # a row a label
    found = cluster.assign(units(spark, sf_dir), [r["q"] for r in means], "vec_id", digits=6)
    labels = spark.createDataFrame([([r["query_id"] for r in means],)], "labels array<int>")
    return found.crossJoin(F.broadcast(labels)).select(F.col("ord").alias("vec_id"), F.get("labels", F.col("cluster")).alias("cluster"))


CHOSEN = "e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), c0 AS (SELECT 0 AS cluster, vec_id, v FROM e ORDER BY vec_id LIMIT 1)" + "".join(
    f", n{i} AS (SELECT e.vec_id, any_value(e.v) AS v, max(list_cosine_similarity(e.v, c.v)) AS near FROM e, c{i - 1} c GROUP BY e.vec_id),"
    f" c{i} AS (SELECT * FROM c{i - 1} UNION ALL SELECT * FROM (SELECT {i}, vec_id, v FROM n{i} ORDER BY near, vec_id LIMIT 1))"
    for i in range(1, 5)
)


@query(
    f"WITH {CHOSEN}, x AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i, sqrt(list_inner_product(v, v)) AS n FROM c4)"
    " SELECT cluster, CAST(i - 1 AS INTEGER) AS dim, round(x / n, 6) AS x FROM x"
)
def kmeans_init(spark, sf_dir):
    """Five first centroids: the first vector, then the farthest from those chosen, component by component."""
    first = cluster.first_centroids(units(spark, sf_dir), 5, "vec_id")
    rows = spark.createDataFrame(list(enumerate(first)), "cluster int, v array<double>")
    return rows.select("cluster", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


def kmeans_run(spark, sf_dir):
    """Five clusters of all vectors. SQL has no loop that stops when no vector moves, so none stands beside it."""
    return cluster.kmeans(units(spark, sf_dir), 5, ord_col="vec_id").select(F.col("ord").alias("vec_id"), "cluster")


# --- text units ---

SENTENCES = "[trim(s, chr(9) || chr(10) || chr(12) || chr(13) || ' ') FOR s IN string_split(regexp_replace(text, '([.!?])[\\t\\n\\f\\r ]+', '\\1' || chr(1), 'g'), chr(1))]"


@query(f"WITH s AS (SELECT doc_id, [x FOR x IN {SENTENCES} IF x <> ''] AS s FROM documents) SELECT doc_id, CAST(len(s) AS INTEGER) AS n, CAST(list_max([length(x) FOR x IN s]) AS INTEGER) AS longest FROM s")
def sentence_units(spark, sf_dir):
    """Sentences of every document, and the longest."""
    s = read(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.array_max(F.transform("s", F.length)).alias("longest"))


@query(
    "WITH p AS (SELECT doc_id, [trim(x, chr(9) || chr(10) || chr(12) || chr(13) || ' ') FOR x IN string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n[\\t\\n\\f\\r ]*\\n')] AS p FROM documents)"
    " SELECT doc_id, CAST(len([x FOR x IN p IF x <> '']) AS INTEGER) AS n FROM p"
)
def paragraph_units(spark, sf_dir):
    """Paragraphs, each line of a document being one."""
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))).alias("n"))


@query(
    f"WITH w AS (SELECT doc_id, {flds('text')} AS w FROM documents), r AS (SELECT doc_id, w, unnest(range(0, len(w), 75)) AS a FROM w)"
    " SELECT doc_id, CAST(a // 75 AS INTEGER) AS position, array_to_string(w[a + 1 : a + 75], ' ') AS part FROM r"
)
def word_windows(spark, sf_dir):
    """Windows of 75 words: three quarters of 100 tokens."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.word_windows(F.col("text"), 100)).alias("position", "part"))


PACKED = f"""
    s AS (SELECT doc_id, [x FOR x IN {SENTENCES} IF x <> ''] AS s, text FROM documents),
    k AS (SELECT doc_id, CASE WHEN len({flds('text')}) * 4 // 3 <= 400 THEN [trim(text, chr(9) || chr(10) || chr(12) || chr(13) || ' ')] ELSE s END AS s FROM s),
    u AS (SELECT doc_id, unnest(s) AS u, generate_subscripts(s, 1) AS i FROM k),
    v AS (SELECT doc_id, i, 0 AS j, u, len({flds('u')}) * 4 // 3 AS n FROM u WHERE len({flds('u')}) * 4 // 3 <= 400 UNION ALL
          SELECT doc_id, i, a, array_to_string(w[a + 1 : a + 300], ' '), len(w[a + 1 : a + 300]) * 4 // 3 FROM (SELECT doc_id, i, {flds('u')} AS w, unnest(range(0, len({flds('u')}), 300)) AS a FROM u WHERE len({flds('u')}) * 4 // 3 > 400)),
    o AS (SELECT doc_id, u, n, row_number() OVER d AS k, sum(n) OVER d AS upto FROM v WHERE u <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY i, j)),
    t AS (SELECT a.doc_id, a.k, coalesce(min(b.k), a.k - 1) AS tail FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.k < a.k AND a.upto - a.n - (b.upto - b.n) <= {{overlap}} GROUP BY 1, 2),
    p AS (SELECT o.*, t.tail FROM o JOIN t USING (doc_id, k)),
    f AS (SELECT doc_id, k, 1 AS start, 0 AS chunk, upto - upto AS gone FROM p WHERE k = 1 UNION ALL
          SELECT p.doc_id, p.k, CASE WHEN p.upto - f.gone > 400 THEN greatest(f.start, p.tail) ELSE f.start END, CASE WHEN p.upto - f.gone > 400 THEN f.chunk + 1 ELSE f.chunk END,
                 CASE WHEN p.upto - f.gone > 400 THEN (SELECT x.upto - x.n FROM o x WHERE x.doc_id = p.doc_id AND x.k = greatest(f.start, p.tail)) ELSE f.gone END
          FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
    c AS (SELECT doc_id, chunk, min(start) AS a, max(k) AS b FROM f GROUP BY 1, 2)
    SELECT c.doc_id, CAST(chunk AS INTEGER) AS position, CAST(count(*) AS INTEGER) AS units, md5(string_agg(o.u, chr(10) || chr(10) ORDER BY o.k)) AS digest FROM c JOIN o ON o.doc_id = c.doc_id AND o.k BETWEEN a AND b GROUP BY 1, 2"""


def packed_chunks(spark, sf_dir, overlap):
    """Per chunk, how many units it holds and the digest of its text."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")  # identifiers may be null or repeat
    chunks = docs.select("doc_id", F.posexplode(chunking.packs(F.col("text"), 400, overlap)).alias("position", "c"))
    return chunks.select("doc_id", "position", "c.units", F.md5("c.text").alias("digest"))


@query("WITH RECURSIVE " + PACKED.replace("{overlap}", "0").replace("coalesce(min(b.k), a.k - 1)", "a.k"))
def chunk_pack(spark, sf_dir):
    """Chunks of about 400 tokens, without overlap: their units and their texts."""
    return packed_chunks(spark, sf_dir, None)


@query("WITH RECURSIVE " + PACKED.replace("{overlap}", "60"))
def chunk_overlap(spark, sf_dir):
    """Chunks of about 400 tokens, each beginning with the units that end the one before, 60 tokens or one unit of them."""
    return packed_chunks(spark, sf_dir, 60)


@query(
    "WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '\\s+') IF x <> '' AND NOT regexp_matches(x, '[<>=\"/]') AND NOT starts_with(x, '!') AND NOT starts_with(x, '[!')"
    " AND strlen(regexp_replace(x, '^[#*`|\\-_()\\[\\]]+|[#*`|\\-_()\\[\\]]+$', '', 'g')) >= 2] AS w FROM documents) SELECT doc_id, CAST(len(w) AS INTEGER) AS n, len(w) >= 40 AS prose FROM w"
)
def prose_filter(spark, sf_dir):
    """Words of prose, and whether there are 40."""
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.prose_words(text).alias("n"), T.has_prose(text, 40).alias("prose"))


@query(f"SELECT doc_id, CAST(len({flds('text')}) * 4 // 3 AS INTEGER) AS tokens FROM documents")
def estimated_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256('tag' || chr(0) || CAST(doc_id AS VARCHAR) || chr(0) || text) AS key FROM documents")
def cache_key(spark, sf_dir):
    """Content address of every document."""
    return cache.keyed(read(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string")), "tag", doc_col="id").select("doc_id", "key")


CACHE = "h AS (SELECT DISTINCT sha256('tag' || chr(0) || source || chr(0) || text) AS key FROM documents WHERE lang = 'en'), d AS (SELECT doc_id, sha256('tag' || chr(0) || source || chr(0) || text) AS key FROM documents)"


def cached(spark, sf_dir):
    docs = cache.keyed(read(spark, sf_dir, "documents"), "tag", doc_col="source")
    return docs, docs.where("lang = 'en'").select("key", F.lit("x").alias("value")).dropDuplicates(["key"])


@query(f"WITH {CACHE} SELECT doc_id FROM d WHERE key NOT IN (SELECT key FROM h)")
def cache_misses(spark, sf_dir):
    """Documents that a cache of the English ones lacks."""
    return cache.misses(*cached(spark, sf_dir)).select("doc_id")


@query(f"WITH {CACHE} SELECT count(*) AS chunks, count(h.key) AS cached, count(*) - count(h.key) AS calls FROM d LEFT JOIN h USING (key)")
def ingest_plan(spark, sf_dir):
    """What ingesting would call for."""
    return cache.plan(*cached(spark, sf_dir))


# --- graph ---

RELATIONS = """r AS (
    SELECT c_name AS a, n_name AS b, 'lives in' AS rel, CAST(c_custkey AS VARCHAR) AS chunk_id, c_custkey AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
    SELECT n_name, r_name, 'Part of', 'n' || n_nationkey, 10000000 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
    SELECT n_name, r_name, 'part of', 'n' || n_nationkey, 20000000 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
    SELECT s_name, s_name, 'is', 's' || s_suppkey, 30000000 + s_suppkey FROM supplier)"""
GRAPH = f"""{RELATIONS}, k AS (SELECT {key('a')} AS src, {key('b')} AS dst, rel, chunk_id, ord FROM r),
    g AS (SELECT src, dst, arg_min(rel, ord) AS relation, chunk_id, min(ord) AS ord FROM k WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst, lower(rel), chunk_id)"""


def relations(spark, sf_dir):
    c, n, r, s = (read(spark, sf_dir, t) for t in ("customer", "nation", "region", "supplier"))
    lives = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("from"), F.col("n_name").alias("to"), F.lit("lives in").alias("relation"), F.col("c_custkey").cast("string").alias("chunk_id"), F.col("c_custkey").alias("ord"))
    part = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    parts = [
        part.select(F.col("n_name").alias("from"), F.col("r_name").alias("to"), F.lit(word).alias("relation"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("chunk_id"), (F.lit(base) + F.col("n_nationkey")).cast("long").alias("ord"))
        for word, base in (("Part of", 10_000_000), ("part of", 20_000_000))
    ]
    own = s.select(F.col("s_name").alias("from"), F.col("s_name").alias("to"), F.lit("is").alias("relation"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("chunk_id"), (F.col("s_suppkey") + 30_000_000).alias("ord"))
    return lives.union(parts[0]).union(parts[1]).union(own)


@query(f"SELECT p_partkey, {key('p_name')} AS key, contains(p_name, ',') OR contains(lower(p_name), ' and ') AS listed FROM part")
def entity_normalize(spark, sf_dir):
    """Keys of part names."""
    return read(spark, sf_dir, "part").select("p_partkey", T.entity_key(F.col("p_name")).alias("key"), T.is_enumeration(F.col("p_name")).alias("listed"))


@query(f"WITH {GRAPH} SELECT src, dst, relation, chunk_id, ord FROM g")
def edge_dedupe(spark, sf_dir):
    """Edges stated twice, in another case, once; self-loops dropped."""
    return graph.edges_of(relations(spark, sf_dir))


@query(f"WITH {RELATIONS}, e AS (SELECT {key('a')} AS key, trim(a) AS name, ord FROM r WHERE a <> b UNION ALL SELECT {key('b')}, trim(b), ord FROM r WHERE a <> b) SELECT key, arg_min(name, ord) AS name, min(ord) AS ord FROM e GROUP BY key")
def entity_table(spark, sf_dir):
    """Entities in the form first seen."""
    none = spark.createDataFrame([], "name string, type string, ord long")
    return graph.entities_of(none, relations(spark, sf_dir)).select("key", "name", "ord")


NAMES = f"""n AS (SELECT DISTINCT {key('p_name')} AS key FROM part UNION SELECT DISTINCT {key("regexp_replace(p_name, '^[^ ]+ ', '')")} FROM part)"""


@query(
    f"WITH {NAMES}, p AS (SELECT a.key AS variant, b.key AS canonical FROM n a JOIN n b ON string_split(a.key, ' ')[-1] = string_split(b.key, ' ')[-1] AND b.key LIKE '% ' || a.key"
    " WHERE len(string_split(b.key, ' ')) - len(string_split(a.key, ' ')) BETWEEN 1 AND 2) SELECT variant, min(canonical) AS canonical FROM p GROUP BY variant HAVING count(*) = 1"
)
def coref_candidates(spark, sf_dir):
    """Part names without their first word, and the one full name that ends with them; many share their last word."""
    part = read(spark, sf_dir, "part")
    short = part.select(T.entity_key(F.regexp_replace("p_name", "^[^ ]+ ", "")).alias("key"))
    return graph.merge_candidates(part.select(T.entity_key(F.col("p_name")).alias("key")).union(short).distinct())


ASKED = "q AS (SELECT r_regionkey AS query_id, 'Who lives in ' || n.n_name || ' of the ' || r_name || '?' AS text FROM region JOIN (SELECT n_regionkey, min(n_name) AS n_name FROM nation GROUP BY 1) n ON n_regionkey = r_regionkey)"


def asked(spark, sf_dir):
    first = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("n_name"))
    both = read(spark, sf_dir, "region").join(first, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("Who lives in "), "n_name", F.lit(" of the "), "r_name", F.lit("?")).alias("text"))


ENTITIES = f"""n AS (SELECT DISTINCT {key('n_name')} AS key FROM nation UNION SELECT DISTINCT {key('r_name')} FROM region)"""
SEEDS = f"""{ASKED}, {ENTITIES}, f AS (SELECT query_id, key FROM q JOIN n ON contains(' ' || {key('text')} || ' ', ' ' || key || ' ')),
    sd AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.query_id = a.query_id AND b.key <> a.key AND contains(' ' || b.key || ' ', ' ' || a.key || ' ')))"""


def places(spark, sf_dir):
    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(read(spark, sf_dir, "region").select("r_name"))
    return graph.entities_of(names.select("name", F.lit("place").alias("type"), F.lit(0).cast("long").alias("ord")))


@query(f"WITH {SEEDS} SELECT query_id, key FROM sd")
def graph_seeds(spark, sf_dir):
    """Places that questions name."""
    return graph.seeds(places(spark, sf_dir), asked(spark, sf_dir))


BFS = f"""{SEEDS}, {GRAPH}, t AS (SELECT src AS node, dst AS next FROM g UNION SELECT dst, src FROM g),
    b AS (SELECT query_id, key AS node, 0 AS hop FROM sd UNION SELECT query_id, next, hop + 1 FROM b JOIN t USING (node) WHERE hop < 1),
    m AS (SELECT query_id, node, min(hop) AS hop FROM b GROUP BY 1, 2),
    h AS (SELECT query_id, src, dst, relation, chunk_id, CAST(min(hop) + 1 AS INTEGER) AS hop FROM g JOIN m ON node = src OR node = dst GROUP BY 1, 2, 3, 4, 5)"""


@query(f"WITH RECURSIVE {BFS} SELECT query_id, src, dst, relation, chunk_id, hop FROM h")
def graph_bfs(spark, sf_dir):
    """Edges within two hops of the places a question names."""
    return graph.traverse(graph.edges_of(relations(spark, sf_dir)), graph.seeds(places(spark, sf_dir), asked(spark, sf_dir)), 2)


@query(
    f"WITH RECURSIVE {BFS}, c AS (SELECT query_id, chunk_id, min(hop) AS min_hop, count(*) AS paths FROM h GROUP BY 1, 2),"
    " o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY min_hop, chunk_id) AS rank FROM c) SELECT query_id, chunk_id, min_hop, CAST(paths AS INTEGER) AS paths, 1.0 / CAST(min_hop AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 5"
)
def graph_chunk_groups(spark, sf_dir):
    """The five nearest chunks of each question, by the edges they state."""
    hits = graph.rendered(graph_bfs(spark, sf_dir), places(spark, sf_dir))
    return graph.chunk_groups(hits).withColumn("paths", F.size("paths"))


@query("SELECT doc_id AS pair FROM (SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, toxic FROM labels) GROUP BY doc_id HAVING sum(quality) * 2 > 3")
def majority_vote(spark, sf_dir):
    """Three votes on each labelled document, two of them equal."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("pair"), F.explode(F.array("quality", "quality", "toxic")).alias("same"))
    return graph.majority(rows)


# --- routing, evidence, evaluation, memory ---

QUESTIONS = "q AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT 1000000 + item_id, 0, 'How many themes recur across all: ' || text FROM benchmark UNION ALL SELECT 2000000 + n_nationkey, 0, 'Who owns the total revenue of ' || n_name || ' per year?' FROM nation)"


def routed(tier: str) -> str:
    return f"len(regexp_extract_all(lower(text), '\\b({'|'.join(router.VOCABULARY[tier])})\\b'))"


def mixed_questions(spark, sf_dir):
    talk = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    bench = read(spark, sf_dir, "benchmark").select(F.col("item_id") + 1_000_000, F.lit(0).cast("long"), F.concat(F.lit("How many themes recur across all: "), "text"))
    places_ = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2_000_000).cast("long"), F.lit(0).cast("long"), F.concat(F.lit("Who owns the total revenue of "), "n_name", F.lit(" per year?")))
    return talk.union(bench).union(places_)


@query(
    f"WITH {QUESTIONS}, m AS (SELECT conv_id, turn, {routed('structured')} AS s, {routed('relational')} AS r, {routed('hierarchical')} AS h FROM q)"
    " SELECT conv_id, turn, array_to_string([x.t FOR x IN list_sort([{'n': -s, 't': 'structured'}, {'n': -r, 't': 'relational'}, {'n': -h, 't': 'hierarchical'}]) IF x.n < 0] || ['semantic'], ',') AS tiers FROM m"
)
def route_keywords(spark, sf_dir):
    """Tiers of every question and turn, by vocabulary."""
    return mixed_questions(spark, sf_dir).select("conv_id", "turn", F.array_join(router.route(F.col("text")), ",").alias("tiers"))


@query(f"WITH {QUESTIONS}, m AS (SELECT {routed('structured')} AS s, {routed('relational')} AS r, {routed('hierarchical')} AS h FROM q) SELECT count(*) AS n, CAST(sum((s = 0 AND r = 0 AND h = 0)::INT) AS BIGINT) AS top1, CAST(sum(((s > 0)::INT + (r > 0)::INT + (h > 0)::INT <= 1)::INT) AS BIGINT) AS top2 FROM m")
def routing_accuracy(spark, sf_dir):
    """How many questions have the semantic tier first, or among the first two."""
    return router.accuracy(mixed_questions(spark, sf_dir).select(F.col("text").alias("question"), F.lit("semantic").alias("expect")))


@query(
    "WITH a AS (SELECT conv_id AS query_id, role AS tier, CAST(length(text) % 5 AS VARCHAR) AS source_id, turn AS arrival FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier, source_id ORDER BY arrival) AS n FROM a),"
    " p AS (SELECT query_id, tier, source_id, arrival, row_number() OVER (PARTITION BY query_id ORDER BY arrival) AS place FROM f WHERE n = 1) SELECT query_id, tier, source_id, arrival, CAST(place AS INTEGER) AS place FROM p WHERE place <= 3"
)
def evidence_merge(spark, sf_dir):
    """Arrivals without repeats, capped at three a query."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("tier"), (F.length("text") % 5).cast("string").alias("source_id"), F.col("turn").alias("arrival"))
    return evidence.merge(rows, 3)


ANSWERS = "a AS (SELECT item_id AS query_id, text || ' [semantic:' || item_id || '#0, memory:m' || item_id % 3 || '] so [relational:x]' AS answer FROM benchmark)"


def answers(spark, sf_dir):
    i = F.col("item_id").cast("string")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" [semantic:"), i, F.lit("#0, memory:m"), (F.col("item_id") % 3).cast("string"), F.lit("] so [relational:x]")).alias("answer"))


MARKERS = "m AS (SELECT DISTINCT query_id, '[' || unnest(flatten([regexp_extract_all(s, '[a-z]+:[^\\s,\\]]+') FOR s IN regexp_extract_all(answer, '\\[[^\\]]+\\]')])) || ']' AS marker FROM a)"


@query(f"WITH {ANSWERS}, {MARKERS} SELECT query_id, marker FROM m")
def citation_extract(spark, sf_dir):
    """Every citation, also of several in one bracket."""
    return answers(spark, sf_dir).select("query_id", F.explode(T.citations(F.col("answer"))).alias("marker")).distinct()


@query(f"WITH {ANSWERS}, {MARKERS} SELECT query_id, marker FROM m WHERE marker <> '[semantic:' || query_id || '#0]' AND NOT (marker = '[memory:m1]' AND query_id % 2 = 0)")
def fabricated_citations(spark, sf_dir):
    """Citations that no evidence bears."""
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    found = rows.select("query_id", F.lit("semantic").alias("tier"), F.concat(F.col("query_id").cast("string"), F.lit("#0")).alias("source_id"))
    found = found.union(rows.where("query_id % 2 = 0").select("query_id", F.lit("memory"), F.lit("m1")))
    return evidence.fabricated(answers(spark, sf_dir), found)


META = ", ".join(f"'{p}'" for p in T.META_PHRASES)


@query(f"WITH {QUESTIONS} SELECT conv_id, turn, len([p FOR p IN [{META}] IF contains(lower(text), p)]) > 0 AS meta FROM (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'What does This Passage say of ' || text ELSE text END AS text FROM q)")
def meta_questions(spark, sf_dir):
    """Questions that speak of their source."""
    rows = mixed_questions(spark, sf_dir)
    said = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("What does This Passage say of "), "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", T.is_meta_question(said).alias("meta"))


@query(
    f"WITH {BM25}, t AS (SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id), o AS (SELECT t.item_id, bm.rank FROM t LEFT JOIN bm ON bm.query_id = t.item_id AND bm.id = t.doc_id AND rank <= 20)"
    " SELECT count(*) AS probes, CAST(coalesce(sum((rank = 1)::INT), 0) AS BIGINT) AS at_1, CAST(coalesce(sum((rank <= 20)::INT), 0) AS BIGINT) AS at_k FROM o"
)
def recall_at_k(spark, sf_dir):
    """Recall of the documents that passages stand in, as one batch of searches."""
    docs, passages = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), questions(spark, sf_dir)
    probes = evidence.holders(docs, passages).groupBy("query_id").agg(F.min("id").alias("source_id"))
    return evidence.recall(lexical.bm25(docs, passages, 20, "doc_id"), probes, 20)


@query("WITH s AS (SELECT conv_id, turn AS seq, text, sum(strlen(text) + 3) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, seq FROM s WHERE b <= 2000 OR n = 1")
def memory_evict(spark, sf_dir):
    """The newest turns of each conversation that fit 2000 bytes."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "text")
    return memory.survivors(rows, 2000, ["conv_id"]).select("conv_id", "seq")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Hourly counts as the stream computes them, over the table at once. An extension."""
    return windowed_counts(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | {"kmeans_run": kmeans_run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
