"""Vector operators: value statistics, dimension checks, adjacent cosine and
exact top-k nearest neighbours by cosine.

Per-row maths stays in JVM expressions; only the nearest-neighbour block
product runs in Python (numpy matmul over Arrow batches), because an
all-pairs dot product expressed with higher-order array functions is an
order of magnitude slower.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import vector as VX
from promptlens.functions.frames import with_row_index


# ----------------------------------------------------------------- statistics
def embedding_stats(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Count, dims, mean, population std, min, max over all components.

    Each row is reduced to (n, sum, sum of squares, min, max) by array
    expressions first, so no component is exploded into its own row."""
    per = df.select(F.size(vec).cast("long").alias("n"), VX.vec_sum(vec).alias("s"),
                    VX.sum_sq(vec).alias("ss"), VX.vec_min(vec).alias("mn"),
                    VX.vec_max(vec).alias("mx"))
    g = per.agg(F.count(F.lit(1)).alias("n_vectors"), F.max("n").alias("dims"),
                F.sum("n").alias("n_values"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
                F.min("mn").alias("min_value"), F.max("mx").alias("max_value"))
    mean = F.col("s") / F.col("n_values")
    var = F.greatest(F.col("ss") / F.col("n_values") - mean * mean, F.lit(0.0))
    return g.select("n_vectors", "dims", mean.alias("mean_value"), F.sqrt(var).alias("std_value"),
                    F.col("min_value").cast("double").alias("min_value"),
                    F.col("max_value").cast("double").alias("max_value"))


def bad_vector(vec: str, expected_dim: int) -> Column:
    """Whether a vector is null, has another dimension, or holds a component
    that is null, NaN or infinite; never null itself."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) != expected_dim) | odd, F.lit(True))


def validate_dims(df: DataFrame, expected_dim: int, vec: str = "embedding") -> DataFrame:
    """One row: valid flag, total, invalid count (see :func:`bad_vector`),
    expected dim. Empty input is invalid. The invalid rows themselves come from
    ``invalid_dims``."""
    g = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad_vector(vec, expected_dim)).alias("invalid_count"))
    return g.select(((F.col("total") > 0) & (F.col("invalid_count") == 0)).alias("valid"),
                    "total", "invalid_count", F.lit(expected_dim).alias("expected_dim"))


def invalid_dims(df: DataFrame, expected_dim: int, key: str, vec: str = "embedding") -> DataFrame:
    dims = F.when(F.col(vec).isNotNull(), F.size(vec))
    return df.where(bad_vector(vec, expected_dim)).select(key, dims.alias("dims"))


def adjacent_cosine(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Cosine of each vector with the next one in ``key`` order (a positional
    neighbour join: distributed row index, then an equi-join on index + 1)."""
    x = with_row_index(df.select(key, vec), [key], "_i")
    nxt = x.select((F.col("_i") - 1).alias("_i"), F.col(key).alias("next_id"),
                   F.col(vec).alias("_nv"))
    j = x.join(nxt, "_i")
    return j.select(key, "next_id", VX.cosine(vec, "_nv").alias("similarity"))


def vector_report(df: DataFrame, expected_dim: int, key: str = "vec_id",
                  vec: str = "embedding") -> DataFrame:
    st = embedding_stats(df, vec)
    vd = validate_dims(df, expected_dim, vec)
    adj = adjacent_cosine(df, key, vec).agg(F.avg("similarity").alias("mean_adjacent_cosine"))
    return st.select(
        "*",
        vd.select("valid").scalar().alias("dims_valid"),
        vd.select("invalid_count").scalar().alias("invalid_count"),
        adj.select("mean_adjacent_cosine").scalar().alias("mean_adjacent_cosine"))


# ----------------------------------------------------------------- top-k
_TOPK_SCHEMA = "target_id long, vec_id long, similarity double"
#: Bytes of target vectors that one task holds.
HELD_BYTES = 64 << 20
#: Cells of the grid per core, so that all cores end at about the same time.
CELLS_PER_CORE = 4


class _Best:
    """The k best corpus rows so far of each of some targets, in the order of
    the final ranking: similarity rounded to 9 places desc, vec_id asc."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool, min_sim: float | None):
        self.ids, self.vectors, self.k, self.exclude_self, self.min_sim = ids, vectors, k, exclude_self, min_sim
        self.row, self.vec_id, self.sim = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
        self.kth = np.full(len(ids), -np.inf)

    def meet(self, cid: np.ndarray, cv: np.ndarray) -> None:
        s = self.vectors @ cv.T
        if self.exclude_self:
            s[self.ids[:, None] == cid[None, :]] = np.nan
        if self.min_sim is not None:
            s[s < self.min_sim] = np.nan
        floor = self.kth
        if len(cid) > self.k and not np.isfinite(floor).all():
            # k rows of this block alone are a bound as well
            floor = np.maximum(floor, -np.partition(np.where(np.isnan(s), np.inf, -s), self.k - 1, axis=1)[:, self.k - 1])
        # rounding moves a value by less than the margin; nan is never kept
        row, col = np.nonzero(s >= (floor - 2e-9)[:, None])
        if not len(row):
            return
        rows, ids, sims = np.concatenate([self.row, row]), np.concatenate([self.vec_id, cid[col]]), np.concatenate([self.sim, s[row, col]])
        rounded = np.round(sims, 9)
        order = np.lexsort((ids, -rounded, rows))
        place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order], side="left")
        full = order[place == self.k - 1]
        self.kth[rows[full]] = rounded[full]
        order = order[place < self.k]
        self.row, self.vec_id, self.sim = rows[order], ids[order], sims[order]

    def told(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.vec_id), pa.array(self.sim)],
                                          names=["target_id", "vec_id", "similarity"])


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids, v = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
    if not len(ids):
        return ids, np.zeros((0, 0))
    lengths = pc.list_value_length(v)
    dim = lengths[0].as_py()
    if pc.any(pc.not_equal(lengths, dim)).as_py():
        raise ValueError("vectors of different dimensions")
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _grid_topk(k: int, exclude_self: bool, min_sim: float | None, block_rows: int):
    """Kernel of a partition: of each cell, first its targets, which are held,
    then its corpus rows, which pass by in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None
        for batch in batches:
            at = batch.column("cell").to_numpy(zero_copy_only=False)
            side = batch.column("side").to_numpy(zero_copy_only=False)
            # runs of the same cell and side
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                if a == b:
                    continue
                if at[a] != cell:
                    for done in best or ():
                        yield done.told()
                    cell, held, best = at[a], [], None
                for i in range(a, b, block_rows):
                    ids, v = _vectors(batch.slice(i, min(block_rows, b - i)))
                    if side[a] == 0:
                        held.append((ids, v))
                        continue
                    if best is None:
                        best = []
                        if held:
                            all_ids, all_v = (np.concatenate(x) for x in zip(*held))
                            best = [_Best(all_ids[j:j + block_rows], all_v[j:j + block_rows], k, exclude_self, min_sim)
                                    for j in range(0, len(all_ids), block_rows)]
                        held = []
                    for block in best:
                        block.meet(ids, v)
        for done in best or ():
            yield done.told()
    return run


def topk_similar(targets: DataFrame, corpus: DataFrame, k: int = 5,
                 target_key: str = "vec_id", corpus_key: str = "vec_id",
                 vec: str = "embedding", exclude_self: bool = True,
                 min_sim: float | None = None, block_rows: int = 2048,
                 min_tasks: int | None = None) -> DataFrame:
    """Exact k nearest corpus vectors (cosine) for every target.

    Both sides are L2-normalised once (JVM). Targets are dealt into rows and
    corpus vectors into columns of a grid, a few cells per core; a cell is one
    task that holds its targets and lets its corpus rows pass by in blocks,
    keeping k per target. So a vector travels once per row or column of the
    grid, which depends on the cores and not on the data, until a cell's
    targets outgrow ``HELD_BYTES``; products are of ``block_rows``^2 numbers.
    The final rank sees k candidates per target and column. Rows without an id
    or a vector take no part. Output columns: target_id, vec_id, rank,
    similarity.
    """
    spark = targets.sparkSession
    t = targets.where(F.col(target_key).isNotNull() & F.col(vec).isNotNull()).select(
        F.col(target_key).cast("long").alias("id"), VX.normalize(VX.as_double(vec)).alias("v"))
    c = corpus.where(F.col(corpus_key).isNotNull() & F.col(vec).isNotNull()).select(
        F.col(corpus_key).cast("long").alias("id"), VX.normalize(VX.as_double(vec)).alias("v"))
    nt, dim = t.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    nc = max(1, c.count())
    cells = min_tasks or CELLS_PER_CORE * spark.sparkContext.defaultParallelism
    # the cheapest grid of so many cells: both sides travel about as much
    tb = min(cells, max(1, round(math.sqrt(cells * nt / nc))))
    tb = max(tb, math.ceil(nt * dim * 8 / HELD_BYTES))
    cb = max(1, math.ceil(cells / tb))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = t.select("id", "v", F.lit(0).alias("side"), dealt(tb).alias("tb"), every(cb).alias("cb")).unionByName(
        c.select("id", "v", F.lit(1).alias("side"), every(tb).alias("tb"), dealt(cb).alias("cb")))
    met = rows.select((F.col("tb") * cb + F.col("cb")).alias("cell"), "side", "id", "v")
    met = met.repartitionById(tb * cb, F.col("cell")).sortWithinPartitions("cell", "side")
    cand = met.mapInArrow(_grid_topk(k, exclude_self, min_sim, block_rows), _TOPK_SCHEMA)
    w = Window.partitionBy("target_id").orderBy(F.desc(F.round("similarity", 9)), F.asc("vec_id"))
    ranked = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("target_id", "vec_id", F.col("rank").cast("long").alias("rank"),
                         "similarity")
