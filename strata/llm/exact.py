"""Exact dedup by content sort, in DataFrame functions only.

Rows are range-partitioned on sampled splitters, each partition is sorted
externally so that equal texts stand next to each other, and a sort aggregate
compares neighbouring texts in full and folds each run into its size, its
digest and the identifier that stays.

The range key is bounded, however long the texts are: a 16-character prefix,
the text's 64-bit hash, and a salt from the identifier. The salt stands last,
so the copies of a text are contiguous in the range order and a splitter may
fall between them: copies of one text, be they a third of all rows, spread over
as many partitions as they would fill. The runs of one text (at most SALTS)
are then added up by SHA-256 digest; they carry no text any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import shuffle_partitions, unused

SALTS = 256
KEEP = {"largest": F.max, "smallest": F.min}


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per distinct text: digest (binary), prefix, keep_id, group_size.

    The text isn't among the columns, so that nothing after the sort carries it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.substring(text, 1, 16).alias("prefix"),
        F.xxhash64(text).alias("hash"),
        F.coalesce(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(SALTS)), F.lit(0)).cast("int").alias("salt"),
    )
    placed = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "prefix", "hash", "salt")
    # max() of a binary has no fixed-width buffer: Spark plans a sort aggregate, whose grouping needs no exchange here,
    # as rows that agree in text agree in the range key.
    runs = placed.groupBy("prefix", "hash", "salt", "text").agg(
        F.max(F.unhex(F.sha2("text", 256))).alias("digest"), KEEP[keep]("id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    return runs.groupBy("digest", "prefix").agg(KEEP[keep]("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical, null counting as empty. The row with the
    largest identifier stays (``keep="smallest"``: the smallest). Rows that
    repeat that identifier are one document given twice and are all kept; a
    null identifier stays only where its text has no other. An empty table
    gives an empty result. Other columns of docs don't appear in the result,
    so their names can't clash.

    Only (identifier, digest) of the rows is shuffled to meet the groups. The
    groups are aggregated by digest and prefix but joined by digest alone: the
    join then gets its own exchange on either side, which lets AQE split the
    partition of a text with very many copies.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))
    groups = content_groups(docs, id_col, text_col, keep).drop("prefix")
    return rows.join(groups.hint("merge"), "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns and no others.

    Rows that repeat both the text and the identifier that stays are one
    document given more than once; one of them stays.
    """
    digest, twin = unused(docs.columns, "_digest"), unused(docs.columns, "_keep")
    groups = content_groups(docs, id_col, text_col, keep).select(F.col("digest").alias(digest), F.col("keep_id").alias(twin))
    marked = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    # Digest and identifier together are the key, so a hot text's rows fall apart by identifier; dropping rows that
    # repeat both needs no further exchange.
    stays = groups.select(digest, twin)
    kept = marked.join(stays.hint("merge"), (marked[digest] == stays[digest]) & marked[id_col].eqNullSafe(stays[twin]), "left_semi")
    return kept.dropDuplicates([digest, id_col]).select(*(F.col(f"`{c}`") for c in docs.columns))
