"""Merging evidence and checking answers against it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strata.functions.text import citations, cite, fact_found, fields
from strata.operators.ranked import numbered
from strata.operators.sized import MOST_ROWS, pair_with_all, small

CAP = 12
#: Words in a row by which a passage is looked for.
RUN = 5
#: Bytes of passages that may be sent to every executor.
MOST_BYTES = 64 << 20


def merge(arrivals: DataFrame, cap: int = CAP) -> DataFrame:
    """arrivals without repeats of (tier, source_id) within a query, in order of arrival, at most ``cap`` a query.

    arrivals: query_id, tier, source_id, arrival and anything else; the first arrival of a source stays.
    """
    first = Window.partitionBy("query_id", "tier", "source_id").orderBy("arrival")
    kept = arrivals.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy("arrival")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def fabricated(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, marker: citations in answers (query_id, answer) that no evidence of the query bears."""
    marked = answers.select("query_id", F.explode(citations(F.col("answer"))).alias("marker")).distinct()
    cited = evidence.select("query_id", cite(F.col("tier"), F.col("source_id")).alias("marker"))
    return marked.join(cited, ["query_id", "marker"], "left_anti")


def formatted(evidence: DataFrame) -> DataFrame:
    """query_id, block: each query's evidence as numbered by its place, a citation before each text."""
    line = F.concat(cite(F.col("tier"), F.col("source_id")), F.lit("\n"), F.col("text"))
    rows = evidence.select("query_id", "place", line.alias("line"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n\n").alias("block"))


def scored(cases: DataFrame, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, status, facts_found, facts_total, retrieved, bad_citations.

    cases: query_id, must_include (array of arrays of alternatives),
    expect_sources; answers: query_id, answer, error. Status is the first that
    holds of ERROR, RETRIEVAL, FACTS, CITATION, else PASS.
    """
    sources = cases.select("query_id", F.explode("expect_sources").alias("want"))
    met = evidence.join(sources, "query_id").where(F.col("source_id").startswith(F.col("want"))).select("query_id").distinct().withColumn("retrieved", F.lit(True))
    bad = fabricated(answers, evidence).groupBy("query_id").agg(F.count(F.lit(1)).alias("bad_citations"))
    rows = cases.join(answers, "query_id", "left").join(met, "query_id", "left").join(bad, "query_id", "left")
    found = F.size(F.filter("must_include", lambda f: F.coalesce(fact_found(F.col("answer"), f), F.lit(False))))
    rows = rows.select(
        "query_id",
        F.when(F.col("error").isNotNull(), 0).otherwise(found).alias("facts_found"),
        F.size("must_include").alias("facts_total"),
        F.coalesce("retrieved", F.lit(False)).alias("retrieved"),
        F.coalesce("bad_citations", F.lit(0)).alias("bad_citations"),
        "error",
    )
    status = (
        F.when(F.col("error").isNotNull(), "ERROR").when(~F.col("retrieved"), "RETRIEVAL").when(F.col("facts_found") < F.col("facts_total"), "FACTS").when(F.col("bad_citations") > 0, "CITATION")
    )
    return rows.withColumn("status", status.otherwise("PASS")).drop("error")


def totals(scores: DataFrame) -> DataFrame:
    """One row: cases, retrieved, facts_found, facts_total, cited (without fabricated markers), passed."""
    fine = (F.col("status") != "ERROR").cast("long")
    return scores.agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum(F.col("retrieved").cast("long") * fine).alias("retrieved"),
        F.sum("facts_found").alias("facts_found"),
        F.sum("facts_total").alias("facts_total"),
        F.sum((F.col("bad_citations") == 0).cast("long") * fine).alias("cited"),
        F.sum((F.col("status") == "PASS").cast("long")).alias("passed"),
    )


def recall(ranked: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """One row: probes, at_1, at_k. ranked: query_id, id, rank; probes: query_id, source_id (the chunk it was made from)."""
    own = probes.join(ranked.select("query_id", F.col("id").alias("source_id"), "rank"), ["query_id", "source_id"], "left")
    return own.agg(
        F.count(F.lit(1)).alias("probes"),
        F.coalesce(F.sum((F.col("rank") == 1).cast("long")), F.lit(0)).alias("at_1"),
        F.coalesce(F.sum((F.col("rank") <= k).cast("long")), F.lit(0)).alias("at_k"),
    )


def holders(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, id: the documents in which each passage (query_id, text) stands as it is.

    A batch of passages goes to every executor and each text is read once: a
    passage is held against the texts that have its longest inner word (the
    first and the last may be parts of a document's words), one without inner
    words against every text. Batches beyond MOST_ROWS passages or MOST_BYTES
    are joined by runs of words.
    """
    asked = passages.where(F.col("text").isNotNull())
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()[0]
    if size["n"] > MOST_ROWS or size["bytes"] > MOST_BYTES:
        return _holders_joined(docs, passages, id_col, text_col)
    batch = [(r["query_id"], r["text"].encode()) for r in asked.select("query_id", "text").collect()]
    anchored, bare = {}, []
    for i, (_, passage) in enumerate(batch):
        inner = passage.split()[1:-1]
        (anchored.setdefault(max(inner, key=len), []) if inner else bare).append((i, passage))

    def standing(batches):
        for part in batches:
            row, query = [], []
            for at, text in enumerate(part.column(1).to_pylist()):
                if text is not None:
                    met = [p for w in anchored.keys() & text.split() for p in anchored[w]]
                    there = [i for i, passage in met + bare if passage in text]
                    row += [at] * len(there)
                    query += there
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), part.column(0).take(pa.array(row, pa.int64()))], ["query", "id"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    found = texts.mapInArrow(standing, StructType([StructField("query", IntegerType()), StructField("id", texts.schema["id"].dataType)]))
    return found.join(numbered(passages, [q for q, _ in batch]), "query").select("query_id", "id").distinct()


def _holders_joined(docs: DataFrame, passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A passage's words after its first (which may be the end of a document's
    word) meet the documents' runs of RUN words by a hash; what meets is then
    held against the whole passage. Passages with fewer words are held against
    every document.
    """
    asked = passages.select("query_id", F.col("text").alias("passage"), fields(F.col("text")).alias("w"))
    run = lambda w, i: F.xxhash64(F.array_join(F.slice(w, i, RUN), " "))
    long = asked.where(F.size("w") >= RUN + 2).select("query_id", "passage", run(F.col("w"), F.lit(2)).alias("run"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), fields(F.col(text_col)).alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - RUN + 1), lambda i: run(F.col("w"), i))
    met = rows.where(F.size("w") >= RUN).select("id", F.explode(F.array_distinct(runs)).alias("run")).join(small(long.select("query_id", "run")), "run").select("id", "query_id")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(small(met.distinct()), "id").join(small(long.select("query_id", "passage")), "query_id")
    found = found.where(F.col("t").contains(F.col("passage"))).select("query_id", "id")
    short = asked.where(F.size("w") < RUN + 2).select("query_id", "passage")
    return found.union(pair_with_all(rows.select("id", "t"), short).where(F.col("t").contains(F.col("passage"))).select("query_id", "id")).distinct()
