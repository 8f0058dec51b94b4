"""Token counts by separator scan.

A flat token file is a run of fixed-width token ids in which an end-of-document
id closes each document; there is no index. Files are cut into byte ranges, so
that one file of any size spreads over tasks. A task reads its range in blocks,
searches each block for the separator in one vectorised comparison and stitches
the blocks of its range; it yields the range's size, its number of separators,
the tokens before its first and after its last, and the documents in between.
A prefix scan over the ranges' summaries, a row a range, then stitches the
documents that cross ranges and gives every document its ordinal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import checkpoint

#: Tokens that are searched at a time, and those of a range.
BLOCK, RANGE = 1 << 18, 1 << 23
#: Tasks that a scan is dealt to at most.
TASKS = 50_000
#: Documents that a row of the scan lists at most; a range has as many rows as it needs.
LISTED = 1 << 14
WIDTHS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def _opened(uri: str):
    """(file system, path) of a URI that driver and executors see alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and uri[6:7] != "/" else uri)


def token_files(spark: SparkSession, path: str, width: int = 4, tokens: int = RANGE) -> DataFrame:
    """file, range (from 0), at (byte), size (bytes) of the flat files below path, as Spark's file system lists them; empty files have no range.

    A file whose length isn't a multiple of the width raises.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], system.listFiles(root, True)
    while files.hasNext():
        status = files.next()
        if not status.getPath().getName().startswith(("_", ".")):
            found.append((status.getPath().toString(), status.getLen()))
    return ranges(spark.createDataFrame(sorted(found), "file string, bytes long"), width, tokens)


def ranges(files: DataFrame, width: int = 4, tokens: int = RANGE) -> DataFrame:
    """The ranges of files (file, bytes), as of token_files()."""
    odd = F.raise_error(F.concat("file", F.lit(": "), F.col("bytes").cast("string"), F.lit(f" bytes aren't a whole number of {width}-byte tokens")))
    size = F.when(F.col("bytes") % width == 0, F.col("bytes")).otherwise(odd.cast("long"))
    step = tokens * width
    cut = files.select("file", size.alias("bytes")).where("bytes > 0")
    cut = cut.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))).alias("range"))
    return cut.select("file", "range", (F.col("range") * step).alias("at"), F.least(F.lit(step).cast("long"), F.col("bytes") - F.col("range") * step).alias("size"))


FOUND = "file string, range long, size long, ends long, head long, tail long, first long, inner array<struct<at: bigint, n: bigint>>"


def _scanned(blocks: Iterator[bytes], separator: int, kind: np.dtype) -> Iterator[tuple]:
    """(size, ends, head, tail, first, inner): a row for the range whose inner is null, and before it rows that list its inner documents, of which ``first`` have gone before.

    The state between blocks is the number of tokens read and the place of the last separator.
    """
    size, ends, head, last = 0, 0, None, None
    for raw in blocks:
        ids = np.frombuffer(raw, kind)
        at = np.flatnonzero(ids == separator) + size
        size += len(ids)
        if not len(at):
            continue
        if last is None:
            head, last, ends, at = int(at[0]), int(at[0]), 1, at[1:]
            if not len(at):
                continue
        start = np.r_[last, at[:-1]] + 1
        n = at - start
        for k in range(0, len(at), LISTED):
            yield None, None, None, None, ends - 1 + k, [{"at": a, "n": b} for a, b in zip(start[k : k + LISTED].tolist(), n[k : k + LISTED].tolist(), strict=True)]
        ends, last = ends + len(at), int(at[-1])
    yield size, ends, size if head is None else head, size if last is None else size - last - 1, None, None


def scan(spans: DataFrame, separator: int, width: int = 4, block: int = BLOCK) -> DataFrame:
    """What _scanned says of each range (file, range, at, size) of the files, which are read a block at a time."""
    kind = WIDTHS[width]

    def read(file: str, at: int, size: int) -> Iterator[bytes]:
        system, path = _opened(file)
        with system.open_input_file(path) as source:
            while size:
                raw = source.read_at(min(size, block * width), at)
                if not raw:
                    raise OSError(f"{file} ends before byte {at + size}")
                whole = len(raw) - len(raw) % width
                yield raw[:whole]
                at, size = at + whole, size - whole

    def run(batches: Iterator) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, number, at, size in zip(pdf["file"], pdf["range"], pdf["at"].tolist(), pdf["size"].tolist(), strict=True):
                for row in _scanned(read(file, at, size), separator, kind):
                    yield pd.DataFrame([(file, number, *row)], columns=["file", "range", "size", "ends", "head", "tail", "first", "inner"], dtype=object)

    # A range is a task's worth of work. The number of partitions is given, as rows this small would otherwise be put into one.
    return spans.repartition(max(1, min(spans.count(), TASKS)), "file", "range").mapInPandas(run, FOUND)


def count_tokens(spans: DataFrame, separator: int, width: int = 4, block: int = BLOCK) -> DataFrame:
    """file, ordinal (from 0), start (token offset), n_tokens (without the separator) of every document.

    spans: ranges of files as of token_files(). Tokens after a file's last
    separator are a document of their own, unless there are none; two
    separators in a row hold an empty document.
    """
    return stitch(checkpoint(scan(spans, separator, width, block)))


def stitch(found: DataFrame) -> DataFrame:
    """The documents of scanned ranges, those that cross ranges among them.

    The prefix scan has a row of a few numbers a range, 32 MB of tokens: a file
    of a petabyte has 32 million. Offsets and ordinals are running sums; what a
    document brings from earlier ranges is the distance to the last separator
    before. Documents inside a range meet their range's sums by a join.
    """
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = (
        found.where("inner is null").select("file", "range", "size", "ends", "head", "tail")
        .withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("ordinal", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("open_at", F.when(F.col("ends") > 0, F.col("offset") + F.col("size") - F.col("tail")))
        .withColumn("begun", F.coalesce(F.last("open_at", ignorenulls=True).over(before), F.lit(0)))
        .withColumn("last_open", F.coalesce(F.last("open_at", ignorenulls=True).over(until), F.lit(0)))
        .withColumn("final", F.lead("range").over(Window.partitionBy("file").orderBy("range")).isNull())
    )
    end = F.col("offset") + F.col("size")
    crossing = sums.where("ends > 0").select("file", "ordinal", F.col("begun").alias("start"), (F.col("offset") + F.col("head") - F.col("begun")).alias("n_tokens"))
    rest = sums.where(F.col("final") & (end > F.col("last_open")))
    rest = rest.select("file", (F.col("ordinal") + F.col("ends")).alias("ordinal"), F.col("last_open").alias("start"), (end - F.col("last_open")).alias("n_tokens"))
    inside = found.where("inner is not null").select("file", "range", "first", "inner").join(sums.select("file", "range", "offset", "ordinal"), ["file", "range"])
    inside = inside.select("file", (F.col("ordinal") + F.col("first") + 1).alias("base"), "offset", F.posexplode("inner").alias("i", "doc"))
    inside = inside.select("file", (F.col("base") + F.col("i")).alias("ordinal"), (F.col("offset") + F.col("doc.at")).alias("start"), F.col("doc.n").alias("n_tokens"))
    return crossing.union(rest).union(inside)


def write_files(docs: DataFrame, folder: str, separator: int, encoder, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """docs as flat files of ids of ``width`` bytes below folder, one per task; file, bytes, ordinal, doc (the identifier as a string) of every document.

    folder is a URI that all executors see. encoder: makes, in a task, a
    function from a text to packed 32-bit ids, none above the separator. A document ends with the separator;
    nothing else marks its border. Every attempt of a task writes a file of its
    own name, and only the rows of the attempt that counts name its file, so
    the result must be kept (checkpointed) before it is read twice. bytes
    stands on a file's last document alone.
    """
    end = np.array([separator], WIDTHS[width]).tobytes()
    if int.from_bytes(end, "little") != separator:
        raise ValueError(f"{width} bytes don't hold {separator}")

    def run(batches: Iterator) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, target = encoder(), f"{folder}/stream-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        system, path = _opened(target)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        held, ordinal, written = None, 0, 0
        with system.open_output_stream(path, buffer_size=1 << 20) as out:
            for pdf in batches:
                for at in range(0, len(pdf), 2000):
                    part = pdf.iloc[at : at + 2000]
                    for text in part["text"]:
                        ids = encode(text)
                        ids = ids if width == 4 else np.frombuffer(ids, "<u4").astype(WIDTHS[width]).tobytes()
                        out.write(ids)
                        out.write(end)
                        written += len(ids) + width
                    if held is not None:
                        yield held
                    held = pd.DataFrame({"file": target, "bytes": pd.array([None] * len(part), dtype="Int64"), "ordinal": np.arange(ordinal, ordinal + len(part)), "doc": part["id"].to_numpy(object)})
                    ordinal += len(part)
        if held is not None:
            held.loc[held.index[-1], "bytes"] = written
            yield held

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "file string, bytes long, ordinal long, doc string")
