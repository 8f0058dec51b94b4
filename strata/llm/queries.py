"""One query per operator of this subpackage, over whole driver tables, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, exact, html, langid, mixing, simhash, suffix_dedup, token_scan, topk, toxicity
from strata.llm.common import checkpoint, read, shared_folder

TOKENIZER = "word_bpe_49k.json"


def tokenizer_file(name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file is; the driver reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def part(column: str, folds: int):
    """The fold of an identifier: crc32 of its decimal text, modulo folds."""
    return F.crc32(F.col(column).cast("string")) % folds


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.bpe(read(spark, sf_dir, "documents"), tokenizer_file(), keep=["doc_id"])
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), keep=part("doc_id", 5) != 0)
    held_out = F.coalesce(part("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files: doc_id, n_tokens, file, ordinal, start.

    The documents are encoded into files without an index, closed by the first
    id beyond the vocabulary, so that no text can hold a separator (16 bits an id); the files
    are then read in ranges and searched. doc_id comes from the order in which
    the documents were written. The files go when they have been scanned. Null
    and empty texts have no tokens; rows that repeat an identifier each have a
    row; an empty table gives an empty result.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    separator, width = 49_408, 2
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tokens-{uuid.uuid4()}")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    # A row of a few bytes a document is kept here; the ids stand in the files only.
    written = checkpoint(token_scan.write_files(docs, system.makeQualified(place).toString(), separator, bpe.encoder(docs, tokenizer_file()), width=width))
    counts = token_scan.count_tokens(token_scan.ranges(written.where("bytes is not null").select("file", "bytes"), width), separator, width)
    system.delete(place, True)
    names = written.select("file", "ordinal", F.col("doc").cast("long").alias("doc_id"))
    return counts.join(names, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, keep=part("doc_id", 3) != 1)
    held_out = F.coalesce(part("doc_id", 3) == 1, F.lit(False))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_html_extraction, op2_bpe, op3_mixing, op4_toxicity, op5_simhash, op6_token_counts, op7_suffix_dedup, op8_language_id, op9_topk, op10_exact_dedup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_topk": """
            WITH v AS (
                SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
            ), p AS (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
            ), r AS (
                SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op10_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
            SELECT doc_id,
                   max(doc_id) OVER (PARTITION BY t) AS keep_id,
                   count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
                   sha256(t) AS text_sha256
            FROM d""",
    }
