"""Tokens per document in flat, unindexed token files.

A flat file is a run of fixed-width little-endian ids in which an end-of-document
id closes each document; nothing says where documents lie. The scan cuts files
into blocks, finds the end ids of a block with one vector comparison, and stitches
documents that cross block borders with prefix scans over one summary row a
block: a running sum of ids and of end ids, and a running maximum of the last end
seen. No document is gathered, whatever blocks it crosses. A file is the unit of
reading; the writer's files are as large as what one task of its input holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import sliced
from tidemark.llm.bpe import encoder
from tidemark.llm.scratch import Scratch
from tidemark.sources.shared import exists

BLOCK = 1 << 18
WORDS = 150_000  # of a generation of the encoder's cache


def _encoded(tokenizer: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, pattern, np.uint16, True, WORDS)
        for b in sliced(batches):
            yield pa.record_batch([pa.array(coder.batch(b.column(0).to_pylist()), pa.binary())], ["ids"])

    return run


def _numbered(tokenizer: str, pattern: str):
    """Each document twice: its ids (kind 0), and its place in the task with its
    doc_id (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at = encoder(tokenizer, pattern, np.uint16, True, WORDS), 0
        for b in sliced(batches):
            ids, n = coder.batch(b.column(1).to_pylist()), b.num_rows
            names = [f"{at + i} {'' if d is None else d}".encode() for i, d in enumerate(b.column(0).to_pylist())]
            places = np.arange(at, at + n)
            kinds = np.repeat(np.array([0, 1], np.int32), n)
            yield pa.record_batch([pa.array(kinds), pa.array(np.concatenate((places, places))), pa.array([*ids, *names], pa.binary())], ["kind", "place", "value"])
            at += n

    return run


def _separator(end_id: int) -> str:
    return end_id.to_bytes(2, "little").decode("latin-1")


def write_flat(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int) -> None:
    """One flat file of 16-bit ids a partition of ``docs`` (text), in row order.
    The text writer puts its line separator, here the end id, behind each row's
    bytes, so the files are written by Spark's own commit protocol to any store;
    it passes bytes that are no UTF-8 through, which the tests hold it to. Null text
    is an empty document: its end id alone; no rows give files without ids."""
    (
        docs.select(F.col("text").cast("string"))
        .mapInArrow(_encoded(tokenizer, pattern), "ids binary")
        .select(F.col("ids").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", _separator(end_id))
        .text(path)
    )


def write_numbered(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int) -> None:
    """The flat files of ``docs`` (doc_id, text) below kind=0 and, written by the same
    tasks, what document stands at which place of a file below kind=1. So the names
    hold whatever deals the rows out, and a task that runs twice writes both again."""
    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(_numbered(tokenizer, pattern), "kind int, place long, value binary")
        .sortWithinPartitions("kind", "place")
        .select("kind", F.col("value").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", _separator(end_id))
        .partitionBy("kind")
        .text(path)
    )


def _scan(end_id: int, dtype: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_buffer()
                ids = np.frombuffer(raw, dtype, count=raw.size // np.dtype(dtype).itemsize)
                for k in range(0, max(len(ids), 1), block):
                    part = ids[k : k + block]
                    ends = np.flatnonzero(part == end_id).astype(np.int64)
                    n = len(ends) + 1
                    yield pa.record_batch(
                        [
                            pa.array([file] * n, pa.string()),
                            pa.array(np.full(n, k // block, np.int64)),
                            pa.array(np.arange(-1, n - 1)),
                            pa.array(np.concatenate(([ends[-1] if n > 1 else -1], ends))),
                            pa.array(np.concatenate(([len(part)], np.concatenate(([-1], ends[:-1])) if n > 1 else [])).astype(np.int64)),
                            pa.array(np.full(n, n - 1, np.int64)),
                        ],
                        ["file", "block", "k", "at", "prior", "ends"],
                    )

    return run


def scan_flat(spark: SparkSession, path: str, end_id: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in the flat
    files under ``path``. ordinal counts documents within the file, start the ids
    before it in the file; n_tokens includes the end id. Ids behind a file's last
    end id are one document with closed false. Empty files have none; bytes short
    of an id are ignored. Documents do not run on from one file into the next.
    Files should stay well under 2 GB, which is what one row can hold."""
    scratch = Scratch(spark, "separators")
    raw = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    seen = scratch.stage(
        raw.mapInArrow(_scan(end_id, dtype, block), "file string, block long, k long, at long, prior long, ends long"), "ends"
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("block") * block
    blocks = seen.where("k = -1").select(
        "file",
        "block",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ends_before"),
        F.coalesce(F.max(F.when(F.col("ends") > 0, start + F.col("at"))).over(before), F.lit(-1)).alias("last_before"),
        (start + F.col("prior")).alias("n_after"),
        (F.lead("block").over(order).isNull()).alias("final"),
        F.when(F.col("ends") > 0, start + F.col("at")).alias("last_here"),
        "ends",
    )
    ends = seen.where("k >= 0").join(blocks.select("file", "block", "ends_before", "last_before"), ["file", "block"])
    previous = F.when(F.col("prior") >= 0, start + F.col("prior")).otherwise(F.col("last_before"))
    closed = ends.select(
        "file",
        (F.col("ends_before") + F.col("k")).alias("ordinal"),
        (previous + 1).alias("start"),
        (start + F.col("at") - previous).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    tail_from = F.coalesce("last_here", "last_before")
    tail = blocks.where(F.col("final") & (tail_from + 1 < F.col("n_after"))).select(
        "file", (F.col("ends_before") + F.col("ends")).alias("ordinal"), (tail_from + 1).alias("start"), (F.col("n_after") - 1 - tail_from).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionAll(tail)


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, file_no, ordinal, start, n_tokens) of every row of ``docs``
    (doc_id, text), by writing flat files and scanning them. ``docs`` is read once,
    and may be any table.

    Defined cases: null and empty texts have their end id alone; very long texts
    cross blocks; rows that share a doc_id, null ones included, are documents of
    their own; no rows give none; columns other than the two are not read."""
    spark = docs.sparkSession
    path = Scratch(spark, "flat").path("ids")
    write_numbered(docs, path, tokenizer, pattern, end_id)
    if not exists(spark, f"{path}/kind=0"):  # no documents
        return spark.createDataFrame([], "doc_id long, file_no long, ordinal long, start long, n_tokens long")
    number = lambda c: F.regexp_extract(c, r"part-(\d+)", 1).cast("long").alias("file_no")
    found = scan_flat(spark, f"{path}/kind=0", end_id, block=block).select(number(F.col("file")), "ordinal", "start", "n_tokens")
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", _separator(end_id)).text(f"{path}/kind=1")
    parts = F.split("value", " ")
    named = lines.select(number(F.col("_metadata.file_path")), parts[0].cast("long").alias("ordinal"), F.nullif(parts[1], F.lit("")).cast("long").alias("doc_id"))
    return named.join(found, ["file_no", "ordinal"], "full").select("doc_id", "file_no", "ordinal", "start", "n_tokens")
