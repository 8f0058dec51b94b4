"""What a model adds to an index: context sentences, entity graph, summary tree and probe questions, each reply kept by content.

Replies are asked for on the executors, for keys that the cache lacks; a task
calls the model for a few rows at once and keeps their order.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import embedded, is_meta_question
from strata.operators import cluster, graph, index
from strata.operators.search import hybrid
from strata.operators.sized import kept
from strata.sources import cache
from strata.sources.providers import Model, offline_embedded

JOBS, VOTES = 4, 3
CONTEXT = "In one or two sentences, place the chunk within its document, so that a search for its subject finds it. Reply with the sentences alone."
EXTRACT = (
    "List the entities that the excerpt names and the relations that it states between them, nothing that it leaves unsaid, each name as it is written there."
    ' Reply as JSON: {"entities": [{"name": "", "type": "person, org, system, document or other"}], "relations": [{"from": "", "relation": "a short verb phrase", "to": ""}]}'
)
SAME = 'Do both names stand for one and the same thing, so that a text could use either? If a text might mean two things by them, they do not. Reply as JSON: {"same": true or false}'
SUMMARY = "Sum up the excerpts in prose: what they have in common, and the names, figures and dates that bear it out."
NEEDLE = 'Write one question that the passage alone answers. Name its subject; do not speak of a passage, text or document. Reply as JSON: {"question": ""}'
EXTRACTION = "entities array<struct<name: string, type: string>>, relations array<struct<`from`: string, relation: string, `to`: string>>"


def ordered_map(f: Callable, items: Iterable, jobs: int = JOBS) -> list:
    """f of every item, at most ``jobs`` at a time, in the items' order."""
    with ThreadPoolExecutor(max(1, jobs)) as pool:
        return list(pool.map(f, items))


def said(system: str, user: str) -> list[dict]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def answered(rows: DataFrame, known: DataFrame, make: Callable[[], Model], ask: Callable[[Model, dict], str | None], valid=None, jobs: int = JOBS, partitions: int | None = None) -> DataFrame:
    """rows (with a column key) with value, fresh and error: the cached value, or what ask(model, row) says.

    valid: a column over the value that a cached one must fulfil to count. A
    call that fails gives a null value and its error; null means no value. The
    result is kept, so that no question is asked twice.
    """
    held = known.select("key", F.col("value").alias("value"))
    joined = rows.join(held if valid is None else held.where(valid), "key", "left")
    old = joined.where("value is not null").select(*rows.columns, "value", F.lit(False).alias("fresh"), F.lit(None).cast("string").alias("error"))
    schema = old.schema
    columns = rows.columns

    def run(frames):
        model = make()

        def one(row: dict) -> tuple:
            try:
                return ask(model, row), None
            except Exception as e:  # noqa: BLE001  one reply's failure is its row's result
                return None, str(e)[:300]

        for pdf in frames:
            told = ordered_map(one, pdf[columns].to_dict("records"), jobs)
            yield pdf[columns].assign(value=[v for v, _ in told], fresh=True, error=[e for _, e in told])

    missing = joined.where("value is null").select(*columns)
    missing = missing.repartition(partitions) if partitions else missing
    return kept(old.unionByName(missing.mapInPandas(run, schema)))


def learnt(known: DataFrame, told: DataFrame) -> DataFrame:
    """The cache with what was newly said."""
    return cache.added(known, told.where("fresh AND value is not null").select("key", "value"))


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with ord, a number that keeps a document's chunks together and in order, without a sort of all of them."""
    return chunks.withColumn("ord", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 42)) * (1 << 20) + F.col("position"))


def contexts(chunks: DataFrame, docs: DataFrame, known: DataFrame, make: Callable[[], Model], tag: str = "default", **how) -> DataFrame:
    """Chunks with their context sentence; a failed call raises, as an index half without contexts would mislead."""
    rows = cache.keyed(chunks, tag).join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("whole")), "doc_id")
    ask = lambda model, r: model.chat(said(CONTEXT, f"<document>\n{r['whole']}\n</document>\n<chunk>\n{r['text']}\n</chunk>")).strip()
    told = answered(rows.select("key", "chunk_id", "text", "whole"), known, make, ask, **how)
    failed = told.where("error is not null").limit(1).collect()
    if failed:
        raise RuntimeError(f"no context for {failed[0]['chunk_id']}: {failed[0]['error']}")
    return told.drop("whole")


def extracted(chunks: DataFrame, known: DataFrame, make: Callable[[], Model], tag: str = "default", **how) -> DataFrame:
    """Chunks with what a model reads from them as JSON; cached values that aren't JSON of that form are asked for again."""
    body = embedded(F.col("context"), F.col("text"))
    rows = cache.keyed(chunks.withColumn("body", body), tag, "graph", text_col="body")
    ask = lambda model, r: json.dumps(model.chat_json(said(EXTRACT, f"<excerpt>\n{r['body'].strip()}\n</excerpt>")), ensure_ascii=False)
    whole = F.coalesce(F.from_json("value", EXTRACTION)["entities"].isNotNull() | F.from_json("value", EXTRACTION)["relations"].isNotNull(), F.lit(False))
    return answered(rows.select("key", "chunk_id", "text", "body"), known, make, ask, whole, **how)


def confirmed(candidates: DataFrame, known: DataFrame, make: Callable[[], Model], tag: str = "default", votes: int = VOTES, **how) -> DataFrame:
    """candidates (variant, canonical) with the verdict "true" or "false" of ``votes`` calls: true if over half of them say so. Failed calls count as no; where all fail there is no verdict."""
    rows = cache.keyed(candidates, tag, "coref", "variant", "canonical")

    def ask(model: Model, r: dict) -> str:
        yes, failures = 0, []
        for _ in range(votes):
            try:
                yes += model.chat_json(said(SAME, f"First name: {r['variant']}\nSecond name: {r['canonical']}")).get("same") is True
            except Exception as e:  # noqa: BLE001  counted below
                failures.append(e)
        if len(failures) == votes:
            raise failures[0]
        return "true" if 2 * yes > votes else "false"

    return answered(rows.select("key", "variant", "canonical"), known, make, ask, **how)


def build_graph(chunks: DataFrame, known: DataFrame, make: Callable[[], Model], tag: str = "default", coreference: bool = True, **how) -> tuple[tuple[DataFrame, ...], DataFrame, dict]:
    """((entities, edges, excerpts, aliases), cache, figures) of chunks (chunk_id, doc_id, position, text, context).

    A chunk whose extraction fails is passed over and counted. Figures: chunks,
    cached, calls, skipped, error, entities, relations, merges (variant,
    canonical), undecided.
    """
    told = extracted(chunks, known, make, tag, **how)
    placed = told.where("value is not null").select("chunk_id", "text", F.from_json("value", EXTRACTION).alias("x"))
    placed = placed.join(numbered(chunks).select("chunk_id", "ord"), "chunk_id")
    named = placed.select("ord", F.explode("x.entities").alias("e")).select("e.name", F.coalesce("e.type", F.lit("")).alias("type"), "ord")
    stated = placed.select("chunk_id", "ord", F.explode("x.relations").alias("r")).select("r.from", "r.to", "r.relation", "chunk_id", "ord").na.drop()
    entities, edges = kept(graph.entities_of(named.na.drop(), stated)), kept(graph.edges_of(stated))
    aliases, undecided, merges = chunks.sparkSession.createDataFrame([], "variant string, canonical string"), 0, []
    grown = learnt(known, told)
    if coreference:
        verdicts = confirmed(graph.merge_candidates(entities), known, make, tag, **how)
        entities, edges, aliases = graph.canonicalize(entities, edges, verdicts.where("value = 'true'").select("variant", "canonical"))
        undecided, grown = verdicts.where("error is not null").count(), learnt(grown, verdicts)
        merges = sorted((r["variant"], r["canonical"]) for r in aliases.collect())  # the audit list; as many as were confirmed
    counts = told.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(~F.col("fresh")).alias("cached"), F.count_if(F.col("fresh") & F.col("value").isNotNull()).alias("calls"),
        F.count_if(F.col("value").isNull()).alias("skipped"), F.first("error", ignorenulls=True).alias("error"),
    )
    figures = counts.collect()[0].asDict() | {"merges": merges, "undecided": undecided} | graph_figures(entities, edges)
    return (entities, edges, placed.select("chunk_id", "text"), aliases), grown, figures


def graph_figures(entities: DataFrame, edges: DataFrame) -> dict:
    return {"entities": entities.count(), "relations": edges.count()}


def build_tree(chunks: DataFrame, known: dict[str, str], model: Model, tag: str = "default", branching: int = 5, embed=offline_embedded) -> tuple[DataFrame, dict]:
    """(summary nodes, figures) over chunks (chunk_id, text, vector) in order. known: summaries by the digest of tag and texts, which grows; a blank one is made again."""
    from hashlib import sha256

    figures = {"leaves": chunks.count(), "cached": 0, "calls": 0}

    def summarise(level: int, i: int, texts: list[str]) -> str:
        key = sha256("\0".join([f"summary|{tag}", *texts]).encode()).hexdigest()
        if known.get(key, "").strip():
            figures["cached"] += 1
        else:
            figures["calls"] += 1
            known[key] = model.chat(said(SUMMARY, "\n\n".join(f"<excerpt {n}>\n{t.strip()}\n</excerpt {n}>" for n, t in enumerate(texts, 1)))).strip()
        return known[key]

    leaves = numbered(chunks).select("ord", "text", "vector")
    nodes = cluster.tree(leaves, summarise, embed, branching).persist()
    return nodes, figures | tree_figures(nodes)


def tree_figures(nodes: DataFrame) -> dict:
    return nodes.agg(F.count(F.lit(1)).alias("summaries"), F.coalesce(F.max("level"), F.lit(0)).alias("levels")).collect()[0].asDict()


def hierarchical(nodes: DataFrame, queries: DataFrame, k: int = 10, embed=offline_embedded) -> DataFrame:
    """Evidence of the hierarchical tier: summaries of all levels, searched at once."""
    hits = hybrid(nodes, embed(queries), k, "node_id", "text", "vector").withColumnRenamed("id", "node_id").join(nodes.select("node_id", "text", "level", "members"), "node_id")
    meta = F.create_map(F.lit("level"), F.col("level").cast("string"), F.lit("members"), F.col("members").cast("string"))
    return hits.select("query_id", F.lit("hierarchical").alias("tier"), F.col("node_id").alias("source_id"), "text", "score", meta.alias("meta"), "rank")


def artifact(path: str, name: str) -> str:
    """Where an index's artifact of that name stands: beside it, its own name first."""
    folder, base = posixpath.split(path.rstrip("/"))
    return posixpath.join(folder, f"{posixpath.splitext(base)[0]}-{name}")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def save_tree(nodes: DataFrame, path: str, model: str = "") -> None:
    index.save(nodes, path, model)


def load_tree(spark: SparkSession, path: str, model: str = "") -> DataFrame:
    return index.load(spark, path, model)


def needles(chunks: DataFrame, known: DataFrame, make: Callable[[], Model], tag: str = "default", **how) -> DataFrame:
    """chunks with a question that each answers (value). One that speaks of its source is asked for once more and then left out (null); a cached one of that kind counts as none."""
    from strata.functions.text import META_PHRASES

    rows = cache.keyed(chunks, tag, "needle")

    def ask(model: Model, r: dict) -> str | None:
        for _ in range(2):
            q = str(model.chat_json(said(NEEDLE, f"<passage>\n{r['text'].strip()}\n</passage>")).get("question") or "").strip()
            if q and not any(p in q.lower() for p in META_PHRASES):
                return q
        return None

    fine = (F.trim("value") != "") & ~is_meta_question(F.col("value"))
    return answered(rows.select("key", "chunk_id", "doc_id", "text"), known, make, ask, fine, **how)


def needle_recall(told: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int) -> tuple[dict, DataFrame]:
    """(figures, missed chunks) of questions as of needles(): search takes all of them at once and returns query_id, source_id, rank."""
    from strata.operators.evidence import recall

    probes = told.where("value is not null").select(F.col("chunk_id").alias("query_id"), F.col("value").alias("text"), F.col("chunk_id").alias("source_id"))
    ranked = search(probes.select("query_id", "text"), k).select("query_id", F.col("source_id").alias("id"), "rank").persist()
    counts = told.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("value").isNull()).alias("skipped"), F.count_if(F.col("fresh") & F.col("value").isNotNull()).alias("generated"), F.count_if(~F.col("fresh")).alias("cached"))
    figures = counts.collect()[0].asDict() | recall(ranked, probes, k).collect()[0].asDict()
    if not figures["probes"]:
        raise ValueError("no chunk could be probed")
    missed = probes.join(ranked.select("query_id", F.col("id").alias("source_id")), ["query_id", "source_id"], "left_anti").select("source_id", "text")
    return figures, missed
