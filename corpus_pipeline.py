"""From documents to training tokens: STAGES, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, exact, mixing, simhash, toxicity
from strata.llm.common import read, shared_folder, unused
from strata.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, with their own columns.

    The classifier is fitted on all labels (at most toxicity.SAMPLE toxic rows
    and twice as many clean ones, and toxicity.SAMPLE_BYTES of their texts). Null and empty texts have the score of
    a text without features and stay unless that is 0.5; rows that repeat go
    or stay alike; an empty table stays empty.
    """
    model, score = toxicity.train(docs, read(spark, sf_dir, "labels")), unused(docs.columns, "_score")
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each text, the row with the largest doc_id. Null counts as empty; a null doc_id stays only where its text has no other; of rows that repeat both, one stays."""
    return exact.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, the row with the smallest doc_id. Empty texts are near one another; a null doc_id stays only where its component has no other."""
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sources weighing 1, 2, 3, repeating. Null is a source of its own, the last; texts without a word aren't taken."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (packed little-endian 32-bit) of each row, with digests of ids and decoded text, and docs' other columns but the text.

    Null and empty texts have no tokens; rows repeat as they stand; a column
    named like one of the results gives way to it.
    """
    own = ["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
    keep = [c for c in docs.columns if c != "text" and c.lower() not in own]
    done = bpe.bpe(docs, tokenizer_file(), keep=keep)
    return done.select(*(F.col(f"`{c}`") for c in keep), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL has neither the classifier nor XXH64 nor BPE; tests/llm holds run() against a pipeline of the operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage's result written below spark.checkpoint.dir. A stage's input goes once the next stage's result is written; the last one's stays, as the result reads it."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{base}/{k}")
            docs = spark.read.parquet(path)
            if before:
                old = spark._jvm.org.apache.hadoop.fs.Path(before)
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            before = path
    return docs
