"""Best-fit packing of documents into sequences, bulk-synchronously.

1. Documents are encoded and cut into pieces of at most ``capacity`` tokens
   (only longer ones are cut); the pieces, not the texts, are written.
2. The pieces are range-sorted by length, longest first. Each range reports
   its runs, (range, length, count): at most one row per length and range
   border. Runs of one length are interchangeable, so gaps are kept as runs as
   well: so many sequences with so much room.
3. Supersteps, longest length first: the run of pieces sweeps over the gaps in
   ascending order from its successor (the smallest gap that holds the length)
   and takes them as far as they reach; what is left opens new sequences. The
   gaps are then updated. Every superstep matches all pieces of a length at
   once; its output is a segment, (length, ranks, first sequence, offset).
4. Conflicts are resolved by rank: the piece with rank r of its length takes
   the r-th place of the length's segments. Pieces look their segment up where
   they lie, without a further shuffle.

The result is exact best-fit decreasing. The sweep works on run descriptors,
of which there are at most ``capacity`` lengths and as many gap sizes whatever
the number of documents; no document passes through the driver.

Null text counts as empty (one end token), repeated doc_ids are rows of their
own, null doc_ids are kept, an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm import tokens
from promptlens.llm.common import parted, stored, table

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANKED = PIECES + ", range int, place long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text) with the crc32 of its ids."""

    def encode(batches):
        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in parted(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = memoryview(enc.encode(text.as_py()) + end)
                for k, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a:a + 4 * capacity]
                    for column, value in zip(rows, (doc_id, k, a // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], list(names))
        enc.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


def ranked(parts: DataFrame) -> DataFrame:
    """Range-sort by length, longest first, and number the pieces of a length
    inside each range. ``parts`` must be stored: the sort reads it twice."""
    spark = parts.sparkSession
    order = [F.desc("length"), F.asc("doc_id"), F.asc("piece"), F.asc("start"), F.asc("ids_crc32")]

    def number(batches):
        here, last, n = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column("length").to_numpy()
            if not len(length):
                continue
            place = np.arange(len(length), dtype="i8")
            starts = np.flatnonzero(np.r_[True, length[1:] != length[:-1]])
            base = np.repeat(starts, np.diff(np.r_[starts, len(length)]))
            place -= base
            place[: starts[1] if len(starts) > 1 else len(place)] += n if length[0] == last else 0
            last, n = int(length[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(length), here, "i4")), pa.array(place)],
                [*batch.schema.names, "range", "place"])

    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartitionByRange(count, *order).sortWithinPartitions(*order).mapInArrow(number, RANKED)


def sweep(runs: list[tuple[int, int]], capacity: int = CAPACITY) -> np.ndarray:
    """Supersteps over runs (length, count), longest first. Returns segments
    (length, first rank, first sequence, pieces per sequence, offset)."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)
    rooms: list[int] = []
    segments, opened = [], 0

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in gaps:
                gaps[room] = []
                insort(rooms, room)
            gaps[room].append((first, count))

    for length, count in sorted(runs, reverse=True):
        rank, at = 0, bisect_left(rooms, length)
        updated = []
        while rank < count and at < len(rooms):
            room = rooms[at]
            each, waiting = room // length, gaps[room]
            while waiting and rank < count:
                first, n = waiting.pop()
                segments.append((length, rank, first, each, capacity - room))
                full, rest = divmod(count - rank, each)
                if n <= full:
                    rank += n * each
                    updated.append((room - each * length, first, n))
                    continue
                rank = count
                updated += [(room - each * length, first, full), (room - rest * length, first + full, 1)]
                if n - full > 1:
                    waiting.append((first + full + 1, n - full - 1))
            if not waiting:
                del gaps[room], rooms[at]
        if rank < count:
            each = capacity // length
            segments.append((length, rank, opened, each, 0))
            full, rest = divmod(count - rank, each)
            updated.append((capacity - each * length, opened, full))
            if rest:
                updated.append((capacity - rest * length, opened + full, 1))
            opened += full + bool(rest)
        for run in updated:
            leave(*run)
    return np.array(segments, dtype="i8").reshape(-1, 5)


def best_fit(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack stored ``parts`` (see :func:`pieces`) into sequences."""
    spark = parts.sparkSession
    sorted_parts = stored(ranked(parts), "ranked-pieces")
    # One row per length and range border: bounded by capacity and partitions.
    runs = sorted_parts.groupBy("range", "length").count().collect()
    totals: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(runs):
        before[r["range"], r["length"]] = totals.get(r["length"], 0)
        totals[r["length"]] = totals.get(r["length"], 0) + r["count"]
    plan = sweep(list(totals.items()), capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast((plan, before))

    def place(batches):
        plan, before = shared.value
        # ranks stay below 2**48, so (length, rank) is one sortable number
        keys = (plan[:, 0] << 48) | plan[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rng = batch.column("length").to_numpy(), batch.column("range").to_numpy()
            pair, back = np.unique(rng.astype("i8") << 32 | length, return_inverse=True)
            base = np.array([before[int(p >> 32), int(p & 0xFFFFFFFF)] for p in pair], dtype="i8")[back]
            rank = batch.column("place").to_numpy() + base
            hit = plan[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            k = rank - hit[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(hit[:, 2] + k // hit[:, 3]), pa.array(hit[:, 4] + k % hit[:, 3] * length)],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    return sorted_parts.mapInArrow(place, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    return best_fit(stored(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=0)
