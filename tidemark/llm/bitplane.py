"""Token ids in a bit-plane file format.

A folder holds one record a chunk (a Parquet row, so that every store and the
commit protocol of the writer apply). A chunk has whole documents of one shard,
``CHUNK`` ids or a little more. Its ids are cut into blocks of ``BLOCK``, the last
one shorter; each block is transposed into byte planes (or bit planes) and each
plane is compressed with zstandard on its own. The record's other fields are the
index: shard, chunk number, position of the first id in the shard, number of ids,
bytes of each plane of each block, and the documents and where they begin. Shards
hold ascending doc_id; a chunk, and within it a block, can be read without others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.batches import sliced
from tidemark.llm.bpe import encoder

CHUNK = 1 << 16
BLOCK = 1 << 14
LEVEL = 1
SHARD = 32 << 20  # bytes of text in a shard
SCHEMA = (
    "shard int, chunk int, first long, n_ids int, block int, width int, kind string, plane_bytes array<int>, payload binary, "
    "doc_ids array<long>, doc_starts array<int>"
)


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Ids (unsigned, little-endian) -> byte planes or bit planes, low first."""
    width = ids.dtype.itemsize
    octets = np.ascontiguousarray(ids).view(np.uint8).reshape(-1, width).T
    if kind == "byte":
        return [np.ascontiguousarray(p).tobytes() for p in octets]
    bits = np.unpackbits(np.ascontiguousarray(octets), axis=1, bitorder="little").reshape(width, -1, 8)
    return [np.packbits(bits[w, :, b], bitorder="little").tobytes() for w in range(width) for b in range(8)]


def from_planes(planes: list[bytes], n: int, width: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(bits.reshape(n, width, 8), axis=2, bitorder="little").reshape(n, width)
    return np.ascontiguousarray(octets).reshape(-1).view(f"<u{width}")


def _writer(path: str, pattern: str, end_id: int, chunk: int, block: int, kind: str, dtype: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        coder, press = encoder(path, pattern, dtype), zstandard.ZstdCompressor(level=LEVEL)
        shard, width = TaskContext.get().partitionId(), np.dtype(dtype).itemsize
        end = np.array([end_id], coder.dtype).tobytes()
        held, starts, doc_ids, n, first, number = [], [], [], 0, 0, 0

        def record() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), coder.dtype)
            planes = [press.compress(p) for i in range(0, n, block) for p in to_planes(ids[i : i + block], kind)]
            row = {
                "shard": shard, "chunk": number, "first": first, "n_ids": n, "block": block, "width": width, "kind": kind,
                "plane_bytes": [len(p) for p in planes], "payload": b"".join(planes), "doc_ids": doc_ids, "doc_starts": starts,
            }
            return pa.RecordBatch.from_pylist([row], schema=_arrow())

        for b in sliced(batches):
            for doc_id, ids in zip(b.column(0).to_pylist(), coder.batch(b.column(1).to_pylist()), strict=True):
                starts.append(n)
                doc_ids.append(doc_id)
                held += (ids, end)
                n += len(ids) // width + 1
                if n >= chunk:
                    yield record()
                    first, number = first + n, number + 1
                    held, starts, doc_ids, n = [], [], [], 0
        if n:
            yield record()

    return run


def _arrow() -> pa.Schema:
    i, j, s = pa.int32(), pa.int64(), pa.string()
    kinds = (i, i, j, i, i, i, s, pa.list_(i), pa.binary(), pa.list_(j), pa.list_(i))
    return pa.schema(list(zip((x.split()[0] for x in SCHEMA.split(", ")), kinds, strict=True)))


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    pattern: str,
    end_id: int = 2,
    chunk: int = CHUNK,
    block: int = BLOCK,
    kind: str = "byte",
    dtype: type = np.uint16,
) -> None:
    """Encodes ``docs`` (doc_id, text), appends ``end_id`` to each document and
    writes all ids in ascending doc_id order, null first. Null text is empty; rows
    that share a doc_id all stay, next to each other; no rows give no files of ids;
    columns other than these two are not read. Shards follow the size of the texts,
    ``SHARD`` bytes each, smaller ones where there are fewer of them than tasks. A
    very long text stays in one chunk, which may hold at most 2^31 - 1 ids."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    shards = max(1, -(-size // SHARD), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (SHARD >> 5))))
    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_writer(tokenizer, pattern, end_id, chunk, block, kind, dtype), SCHEMA)
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for b in sliced(batches, 1):
        row = b.to_pylist()[0]
        n, size, width, kind = row["n_ids"], row["block"], row["width"], row["kind"]
        sizes, each, at, parts = iter(row["plane_bytes"]), width * (1 if kind == "byte" else 8), 0, []
        for i in range(0, n, size):
            planes = []
            for _ in range(each):
                length = next(sizes)
                planes.append(expand.decompress(row["payload"][at : at + length]))
                at += length
            parts.append(from_planes(planes, min(size, n - i), width, kind))
        ids = np.concatenate(parts).astype("<u4")
        offsets = np.append(np.array(row["doc_starts"], np.int32), n) * np.int32(4)
        texts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
        at = np.array(row["doc_starts"], np.int64) + row["first"] + row["base"]
        yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(at), texts], ["doc_id", "start", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in a folder of
    ``write_ids``: start counts the ids of all documents before it, ids are
    little-endian unsigned 32-bit integers, the end id included. The shards' places
    are broadcast: 16 bytes for 32 MB of text."""
    chunks = spark.read.schema(SCHEMA).parquet(path)
    sums = chunks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    base = sums.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = chunks.join(F.broadcast(base), "shard").select("first", "base", "n_ids", "block", "width", "kind", "plane_bytes", "payload", "doc_ids", "doc_starts")
    docs = placed.mapInArrow(_documents, "doc_id long, start long, ids binary")
    return docs.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
