"""Token ids in a fixed-width bit-packed block file.

Every id takes the fewest bits that the vocabulary needs. A file is a folder
of Parquet parts whose rows are blocks::

    shard     int     range of doc_id that the block belongs to, ascending
    block     int     place inside the shard
    first_id  long    ids of the shard before the block
    n_ids     long    ids in the block
    width     int     bits of an id
    doc_ids   list    documents of the block, in order (null ids kept)
    offsets   list    first id of each document in the block, then n_ids
    payload   binary  the ids, id i at bits [i*width, (i+1)*width), low bit first

Documents never cross blocks, so a block is decoded alone; id ``i`` of a block
is found by arithmetic, without decoding what is before it. Spark's committer
writes the parts, so a lost executor or a second attempt leaves no torn file.

Null text counts as empty, repeated doc_ids are kept as rows of their own
(ordered by id, then by a hash of the text), a null doc_id sorts first, an
empty table gives an empty file. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptlens.llm import tokens
from promptlens.llm.common import table
from promptlens.session import scratch_path

IDS_PER_BLOCK = 1 << 16
BLOCK_SCHEMA = ("shard int, block int, first_id long, n_ids long, width int, doc_ids array<long>, "
                "offsets array<long>, payload binary")
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
IDS_SCHEMA = "doc_id long, start long, ids array<long>"


def bit_width(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` as a bit string, low bit first; no padding between ids."""
    ids = np.asarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype="<u4")) & 1
    return np.packbits(bits.astype("u1").ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive): one 64-bit window per id, read
    at its byte, shifted and masked; nothing before ``first`` is touched."""
    if last <= first:
        return np.zeros(0, "<u4")
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(payload, f"<u{size}", last - first, first * size).astype("<u4")
    low, high = first * width // 8, (last * width + 7) // 8
    data = payload[low:high] + bytes(8)
    at = np.arange(first, last, dtype=np.int64) * width - low * 8
    windows = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return ((windows[at >> 3] >> (at & 7).astype("<u8")) & ((1 << width) - 1)).astype("<u4")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int,
              ids_per_block: int = IDS_PER_BLOCK, shards: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the block file to ``path``.

    One shuffle: the texts are range-partitioned by doc_id (a hash of the
    text splits a repeated id), sorted, and encoded where they lie.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        enc = tokens.encoder(tokenizer)
        width = bit_width(max(enc.vocab_size, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, ends = [], [], [0]

        def row():
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                 "first_id": [first], "n_ids": [len(ids)], "width": pa.array([width], pa.int32()),
                 "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                 "offsets": pa.array([ends], pa.list_(pa.int64())),
                 "payload": pa.array([pack(ids, width)], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = enc.encode(text.as_py()) + end
                if doc_ids and ends[-1] + len(data) // 4 > ids_per_block:
                    yield row()
                    block, first = block + 1, first + ends[-1]
                    doc_ids, parts, ends = [], [], [0]
                doc_ids.append(doc_id)
                parts.append(data)
                ends.append(ends[-1] + len(data) // 4)
        if doc_ids:
            yield row()
        enc.forget()

    (docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("_h"))
     .repartitionByRange(shards, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
     .select("doc_id", "text").mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path))


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``base``, the ids of all shards before theirs. The shard
    totals are one row per shard of the writer: a bound fixed by its number of
    partitions, not by the data, so they are broadcast."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return blocks.join(F.broadcast(before), "shard")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: its global start and length, and
    the crc32 of its ids, or the ids themselves."""

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ends = r["offsets"]
                ids = unpack(r["payload"], r["width"], 0, ends[-1])
                pairs = list(zip(ends, ends[1:]))
                out = {"doc_id": pa.array(r["doc_ids"], pa.int64()),
                       "start": [r["base"] + r["first_id"] + a for a, _ in pairs]}
                if with_ids:
                    out["ids"] = pa.array([ids[a:b].astype("i8") for a, b in pairs], pa.list_(pa.int64()))
                else:
                    out["n_tokens"] = [b - a for a, b in pairs]
                    out["ids_crc32"] = [zlib.crc32(ids[a:b]) for a, b in pairs]
                yield pa.RecordBatch.from_pydict(out)

    blocks = _blocks(spark, path)
    return blocks.mapInArrow(decode, IDS_SCHEMA if with_ids else DOC_SCHEMA)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Ids at global places [first, last): only the blocks that overlap are
    kept, and in them only the wanted ids are unpacked."""

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                start = r["base"] + r["first_id"]
                a, b = max(0, first - start), min(r["n_ids"], last - start)
                ids = unpack(r["payload"], r["width"], a, b)
                yield pa.RecordBatch.from_pydict({
                    "position": np.arange(start + a, start + b, dtype="i8"), "id": ids.astype("i8")})

    start = F.col("base") + F.col("first_id")
    return _blocks(spark, path).filter((start < last) & (start + F.col("n_ids") > first)).mapInArrow(
        decode, "position long, id long")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path, tokens.default_path(), end_id=2)
    return read_documents(spark, path)
