"""Exact top-k by integer inner product, as tiled matrix products.

Every component x becomes floor(1024 * x). The corpus is packed into blocks
of vectors where it lies, the queries into blocks of their own; a query block
meets every corpus shard, and each (query block, corpus block) pair is one
tile: a matrix product of bounded size, from which each query keeps its k best
(partial selection). There are a few shards per core, whatever the data, and
more groups of query blocks only when they outgrow ``HELD_BYTES``: a task holds
a group and lets its shard's blocks pass by, so a query travels once per shard
and nothing is broadcast. The lists of a query are merged by a tree of fan-in
``FAN_IN`` over the shards, so no task ever holds more than a few lists.

Defined results: a vector that is null or holds a null or non-finite component
takes no part, nor does a row without an id; vectors of different dimension
never meet; ties go to the smaller id; a query's own id is no candidate;
repeated candidate rows count each, of repeated query ids the smallest vector
is searched; components beyond the long range are clipped to it. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptlens.llm.common import stored, table

SCALE = 1024
QUERY_BLOCK = 1024
CORPUS_BLOCK = 4096
FAN_IN = 8
#: Corpus shards per core, so that all cores end at about the same time.
SHARDS_PER_CORE = 4
#: Bytes of query vectors that one task holds.
HELD_BYTES = 64 << 20
BLOCKS = "dim int, ids binary, vectors binary"
_EXACT = 2.0 ** 53


def usable(vector: str | Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _packer(block: int):
    def pack(batches):
        held: dict[int, list] = {}

        def row(dim):
            ids, vectors = zip(*held.pop(dim))
            order = np.argsort(np.array(ids, "i8"), kind="stable")
            scaled = np.floor(SCALE * np.array(vectors, "f8").reshape(len(ids), dim)[order])
            whole = np.clip(scaled, -(2.0 ** 63), 2.0 ** 63 - 1024).astype("<i8")
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array(ids, "<i8")[order].tobytes()], pa.binary()),
                "vectors": pa.array([whole.tobytes()], pa.binary())})

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(len(vector), []).append((vec_id, vector))
                if len(held[len(vector)]) >= block:
                    yield row(len(vector))
        for dim in list(held):
            yield row(dim)

    return pack


def _scores(queries: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no partial sum can reach
    2**53, else in Python integers cut to the long range."""
    most = float(np.abs(queries.astype("f8")).max(initial=0)) * float(np.abs(corpus.astype("f8")).max(initial=0))
    if most * max(1, queries.shape[1]) < _EXACT:
        return (queries.astype("f8") @ corpus.astype("f8").T).astype("i8")
    exact = queries.astype(object) @ corpus.astype(object).T
    return np.clip(exact, -(2 ** 63) + 1, 2 ** 63 - 1).astype("i8")


def select(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int):
    """(query row, corpus row) of the k best of each query; ``ids`` ascend."""
    for i, own in enumerate(query_ids):
        line = scores[i]
        at = np.flatnonzero(ids != own)
        if len(at) > k:
            least = np.partition(line[at], len(at) - k)[len(at) - k]
            above = at[line[at] > least]
            at = np.concatenate([above, at[line[at] == least][: k - len(above)]])
        yield i, at


def _tiles(k: int):
    """Kernel of a partition: of each cell, first its query blocks, which are
    held, then its corpus blocks, which pass by. Each meeting is a tile; a query
    keeps the k best of its cell."""
    def run(batches):
        cell, held, best = None, [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                at, side, shard, dim, ids, vectors = (batch.column(c)[i].as_py() for c in range(6))
                if at != cell:
                    yield from _told(held, best)
                    cell, held, best = at, [], {}
                ids = np.frombuffer(ids, "<i8")
                block = np.frombuffer(vectors, "<i8").reshape(len(ids), dim)
                if side == 0:
                    held.append((dim, shard, ids, block))
                    continue
                for j, (q_dim, _, q_ids, queries) in enumerate(held):
                    if q_dim == dim:
                        best[j] = _merged(best.get(j), *_tile(queries, q_ids, block, ids, k), k)
        yield from _told(held, best)

    return run


def _tile(queries: np.ndarray, q_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best of each query of one tile."""
    scores = _scores(queries, block)
    found = list(select(scores, q_ids, ids, k))
    row = np.concatenate([np.full(len(at), i) for i, at in found]).astype("i8")
    col = np.concatenate([at for _, at in found]).astype("i8")
    return row, ids[col], scores[row, col]


def _merged(best, row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    if best is None:
        return row, ids, scores
    row, ids, scores = (np.concatenate(x) for x in zip(best, (row, ids, scores)))
    order = np.lexsort((ids, -scores, row))
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order], side="left")
    order = order[place < k]
    return row[order], ids[order], scores[order]


def _told(held, best):
    for j, (row, ids, scores) in best.items():
        _, shard, q_ids, _ = held[j]
        yield pa.RecordBatch.from_pydict({"query_id": q_ids[row], "node": pa.array(np.full(len(row), shard, "i4")),
                                          "vec_id": ids, "score": scores})


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, shards: int | None = None) -> DataFrame:
    """``queries`` and ``corpus``: (vec_id, embedding). Returns query_id, rank,
    vec_id, score."""
    spark = corpus.sparkSession
    wanted = (queries.filter(F.col("vec_id").isNotNull() & usable("embedding"))
              .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    blocks = (corpus.filter(F.col("vec_id").isNotNull() & usable("embedding"))
              .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_packer(CORPUS_BLOCK), BLOCKS))
    wanted = stored(wanted.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), "queries")
    shards = shards or SHARDS_PER_CORE * spark.sparkContext.defaultParallelism
    n, numbers = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    parts = max(1, -(-n // QUERY_BLOCK))
    groups = max(1, -(-numbers * 8 // HELD_BYTES))
    asked = wanted.repartition(parts).mapInArrow(_packer(QUERY_BLOCK), BLOCKS)

    # a query block goes to every shard, a corpus block to every group of query
    # blocks; neither side is broadcast, whatever its size looks like to Spark
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = asked.select("*", F.lit(0).alias("side"), dealt(groups).alias("group"), every(shards).alias("shard")).unionByName(
        blocks.select("*", F.lit(1).alias("side"), every(groups).alias("group"), dealt(shards).alias("shard")))
    met = met.select((F.col("group") * shards + F.col("shard")).alias("cell"), "side", "shard", "dim", "ids", "vectors")
    met = met.repartitionById(groups * shards, F.col("cell")).sortWithinPartitions("cell", "side")
    lists = met.mapInArrow(_tiles(k), "query_id long, node int, vec_id long, score long")
    best = [F.desc("score"), F.asc("vec_id")]
    nodes = shards
    while True:  # one level of the merge tree each time
        rank = F.row_number().over(Window.partitionBy("query_id", "node").orderBy(*best))
        lists = lists.withColumn("rank", rank).filter(F.col("rank") <= k)
        if nodes == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        nodes = -(-nodes // FAN_IN)
        lists = lists.select("query_id", F.floor(F.col("node") / FAN_IN).cast("int").alias("node"), "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors, k=10)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
