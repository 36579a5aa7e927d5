"""Approximate top-k nearest neighbours: a two-level tree of cells with
quantised residuals and an exact re-rank (V-04, J-05, F-06).

1. Tree. The corpus gets about the root of its rows as cells and about the
   fourth root as upper nodes: the vectors with the smallest md5 of seed and
   id, moved once to the mean of the sampled vectors that are nearest to them.
   A cell hangs below its nearest upper node. The tree is of a bounded size
   (``TREE_BYTES``), whatever the corpus, and goes to the tasks.
2. A vector visits its ``VISITED`` nearest upper nodes only. A corpus vector is
   put into its nearest cell below them, and into up to ``SPILL`` - 1 more ones
   that are nearly as near (``MARGIN``); a target probes its nearest quarter of
   the cells.
3. Corpus vectors travel as residuals to their cell's centre, two bytes a
   component, with the norm of what the bytes leave out. So a block's product
   gives each pair an interval that holds the cosine, and a target keeps every
   row that can still be among its k best.
4. What is left, hardly more than k rows per target, is scored by the vectors
   themselves. The result is that of an exact search of the probed cells.

A task has the cells below one upper node, or a piece of it: it holds the
targets that visit the node, each with the cells it probes there, and lets the
corpus rows of these cells pass by. So a target travels once per upper node that
it visits, and not once per cell, and leaves about k rows there. Pieces
(``_pieces``) are cut on both sides by the work of a node, from per-cell counts,
and by the bytes of the held targets, so a node that holds a third of the
corpus, or that every target visits, is spread over tasks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import vector as VX
from promptlens.functions.frames import written

#: Bytes of all cell centres; more rows than this leaves room for make larger cells.
TREE_BYTES = 64 << 20
#: Sampled rows per cell from which centres are moved.
SAMPLE_PER_CELL = 64
VISITED, SPILL, MARGIN = 4, 6, 0.5
#: Share of the cells that a target probes.
PROBED = 0.25


#: Scores of vectors against cells that are held at once.
SCORES_AT_ONCE = 1 << 21
#: Rows that a task hands on at once: a vector goes to many cells, so this and
#: not the number of vectors read bounds its memory.
ROWS_AT_ONCE = 1 << 13
#: Bytes of target vectors that one task holds.
HELD_BYTES = 32 << 20
#: Pieces of the whole work per core, so that all cores end at about the same time.
PIECES_PER_CORE = 4


@dataclass(frozen=True)
class CellTree:
    tops: np.ndarray
    cells: np.ndarray
    parent: np.ndarray

    @property
    def probes(self) -> int:
        return max(1, int(len(self.cells) * PROBED))

    @cached_property
    def children(self) -> np.ndarray:
        """Cells below each upper node, ascending, then -1."""
        below = [np.flatnonzero(self.parent == u) for u in range(len(self.tops))]
        out = np.full((len(below), max(map(len, below), default=0)), -1)
        for u, cells in enumerate(below):
            out[u, : len(cells)] = cells
        return out

    def descend(self, vectors: np.ndarray, n: int, margin: float | None = None,
                visited: int | None = VISITED) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the up to ``n`` nearest cells of each vector below
        the upper nodes that it visits (all, if None), within ``margin`` of the
        nearest; of equally near ones the first."""
        visited = min(visited or len(self.tops), len(self.tops))
        step = max(1, SCORES_AT_ONCE // max(1, visited * self.children.shape[1]))
        parts = [self._descend(vectors[i:i + step], n, margin, visited) for i in range(0, len(vectors), step)]
        return (np.concatenate([rows + i * step for i, (rows, _) in enumerate(parts)]),
                np.concatenate([cells for _, cells in parts]))

    def _descend(self, v: np.ndarray, n: int, margin: float | None, visited: int) -> tuple[np.ndarray, np.ndarray]:
        tops = np.argsort(-np.round(v @ self.tops.T, 9), axis=1, kind="stable")[:, :visited]
        cells = self.children[tops]
        near = np.full(cells.shape, -np.inf)
        for u in np.unique(tops):
            row, slot = np.nonzero(tops == u)
            kids = self.children[u][self.children[u] >= 0]
            near[row, slot, : len(kids)] = np.round(v[row] @ self.cells[kids].T, 9)
        cells, near = cells.reshape(len(v), -1), near.reshape(len(v), -1)
        by_cell = np.argsort(cells, axis=1, kind="stable")
        cells, near = np.take_along_axis(cells, by_cell, 1), np.take_along_axis(near, by_cell, 1)
        best = np.argsort(-near, axis=1, kind="stable")[:, :n]
        cells, near = np.take_along_axis(cells, best, 1), np.take_along_axis(near, best, 1)
        keep = np.isfinite(near)
        if margin is not None:
            keep &= near[:, :1] - near <= margin
        rows, places = np.nonzero(keep)
        return rows, cells[rows, places]


def _digest(key: str, seed: int):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def _parts(pdf: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    for i in range(0, len(pdf), rows):
        yield pdf.iloc[i:i + rows]


def _centred(sample: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Each centre moved to the mean direction of the sampled vectors nearest
    to it; one that has none stays."""
    dim = centres.shape[1]

    def add(batches):
        total, count = np.zeros(centres.shape), np.zeros(len(centres), dtype="i8")
        for pdf in batches:
            for part in _parts(pdf, max(1, SCORES_AT_ONCE // len(centres))):
                v = np.vstack(part["cv"].to_numpy())
                at = np.argmax(np.round(v @ centres.T, 9), axis=1)
                np.add.at(total, at, v)
                count += np.bincount(at, minlength=len(centres))
        hit = np.flatnonzero(count)
        if len(hit):
            yield pd.DataFrame({"cell": hit.astype("i4"), "s": list(total[hit])})

    def join(key, pdf):
        return pd.DataFrame({"cell": [key[0]], "s": [np.sum(np.vstack(pdf["s"].to_numpy()), axis=0)]})

    schema = "cell int, s array<double>"
    told = sample.select("cv").mapInPandas(add, schema).groupBy("cell").applyInPandas(join, schema)
    moved = centres.copy()
    for r in told.collect():
        length = np.linalg.norm(r["s"])
        if length > 0:
            moved[r["cell"]] = np.array(r["s"]) / length
    return moved.reshape(-1, dim)


def cell_tree(c: DataFrame, rows: int, seed: int) -> CellTree:
    """``c``: (vec_id, cv), unit vectors. At most TREE_BYTES come to the driver."""
    first = c.select("cv").limit(1).collect()
    dim = len(first[0][0]) if first else 1
    n_cells = max(1, min(math.ceil(rows ** 0.5), TREE_BYTES // (8 * dim)))
    n_tops = max(1, math.ceil(n_cells ** 0.5))
    share = min(1.0, SAMPLE_PER_CELL * n_cells / max(rows, 1))
    digest = _digest("vec_id", seed)
    pivots = np.array([r[0] for r in c.orderBy(digest, "vec_id").limit(n_cells).select("cv").collect()], dtype="f8").reshape(-1, dim)
    if not len(pivots):
        return CellTree(np.zeros((0, dim)), np.zeros((0, dim)), np.zeros(0, "i8"))
    drawn = c.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(share * 2 ** 32)) if share < 1 else c
    tops, cells = _centred(drawn, pivots[:n_tops]), _centred(drawn, pivots)
    return CellTree(tops, cells, np.argmax(np.round(cells @ tops.T, 9), axis=1))


def _quantise(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two bytes a component, the step, and an upper bound of the norm left out."""
    step = np.abs(residual).max(axis=1, initial=0.0) / 32767
    code = np.round(residual / np.where(step > 0, step, 1)[:, None]).astype("<i2")
    left = np.linalg.norm(residual - code * step[:, None], axis=1)
    return code, step, left * (1 + 1e-9) + 1e-12


class _Held:
    """Some targets of a task, with the corpus rows that can be among the k best
    of each so far and the interval of their cosine."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, probed: np.ndarray, k: int, exclude_self: bool, min_sim: float | None):
        self.ids, self.probed, self.k, self.exclude_self = ids, probed, k, exclude_self
        # the last component adds a row's own error to the product
        self.vectors = np.hstack([vectors, np.ones((len(ids), 1), "f4")])
        self.floor = np.full(len(ids), -np.inf if min_sim is None else min_sim - 1e-6, "f4")
        self.open = np.ones(len(ids), dtype=bool)  # no k rows are known yet
        self.kept = (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0), np.zeros(0))
        self.found: list = []
        self.waiting = 0

    def meet(self, slot: int, cid: np.ndarray, rows: np.ndarray, off: np.ndarray) -> None:
        """A block of the cell in place ``slot`` below the node."""
        at = np.flatnonzero(self.probed[:, slot])
        if not len(at):
            return
        high = (self.vectors if len(at) == len(self.ids) else self.vectors[at]) @ rows.T
        new = np.flatnonzero(self.open[at])
        if len(new) and len(cid) >= self.k:
            low = high[new] - np.float32(2) * off.astype("f4")
            if self.exclude_self:
                low[self.ids[at[new]][:, None] == cid[None, :]] = -np.inf
            kth = -np.partition(-low, self.k - 1, axis=1)[:, self.k - 1]
            self._raise(at[new], kth)
        row, col = np.nonzero(high >= self.floor[at][:, None])
        high = high[row, col].astype("f8")
        row = at[row]
        if self.exclude_self:
            other = self.ids[row] != cid[col]
            row, col, high = row[other], col[other], high[other]
        self.found.append((row, cid[col], high - 2 * off[col], high))
        self.waiting += len(row)
        if self.waiting > 2 * self.k * len(self.ids):
            self._merge()

    def _raise(self, at: np.ndarray, kth: np.ndarray) -> None:
        # single precision, so a little lower
        self.floor[at] = np.maximum(self.floor[at], (kth - 1e-6).astype("f4"))
        self.open[at[np.isfinite(kth)]] = False

    def _merge(self) -> None:
        """A row met in several cells has several intervals and counts once."""
        row, vec, low, high = (np.concatenate(x) for x in zip(self.kept, *self.found))
        self.found, self.waiting = [], 0
        if not len(row):
            return
        order = np.lexsort((vec, row))
        row, vec, low, high = row[order], vec[order], low[order], high[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (vec[1:] != vec[:-1])])
        row, vec, low, high = row[first], vec[first], np.maximum.reduceat(low, first), np.maximum.reduceat(high, first)
        order = np.lexsort((-low, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order], side="left")
        full = order[place == self.k - 1]
        self._raise(row[full], low[full])
        keep = high >= self.floor[row]
        self.kept = row[keep], vec[keep], low[keep], high[keep]

    def told(self) -> pa.RecordBatch:
        self._merge()
        row, vec, low, high = self.kept
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(vec), pa.array(low), pa.array(high)],
                                          names=["target_id", "vec_id", "low", "high"])


_PIECE = "piece int, side int, cell int, id long, data binary, step double, gap double"


def _node_search(tree: CellTree, k: int, exclude_self: bool, min_sim: float | None, block_rows: int):
    """Kernel of a partition: of each piece, first its targets, which are held,
    then its corpus rows by cell, which pass by in blocks."""
    dim = tree.cells.shape[1]
    slot_of = np.zeros(len(tree.cells), "i8")
    for kids in tree.children:
        slot_of[kids[kids >= 0]] = np.arange((kids >= 0).sum())

    def held(parts) -> list[_Held]:
        ids = np.concatenate([x for x, _ in parts])
        data = np.frombuffer(b"".join(b"".join(x) for _, x in parts), "u1").reshape(len(ids), -1)
        vectors, probed = np.ascontiguousarray(data[:, : 4 * dim]).view("f4"), np.unpackbits(data[:, 4 * dim:], axis=1).astype(bool)
        cut = lambda x, i: x[i:i + block_rows]
        return [_Held(cut(ids, i), cut(vectors, i), cut(probed, i), k, exclude_self, min_sim) for i in range(0, len(ids), block_rows)]

    def rows_of(batch: pa.RecordBatch, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        code = np.frombuffer(b"".join(batch.column("data").to_pylist()), "<i2").reshape(len(ids), dim)
        near = tree.cells[cell] + code * batch.column("step").to_numpy(zero_copy_only=False)[:, None]
        # single precision of both sides and of the product adds its own error
        off = batch.column("gap").to_numpy(zero_copy_only=False) + (dim + 8) * 2.0 ** -23 * (1 + np.linalg.norm(near, axis=1))
        return ids, np.hstack([near, off[:, None]]).astype("f4"), off

    def run(batches):
        piece, parts, best = None, [], None
        for batch in batches:
            at, side, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "side", "cell"))
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(side) != 0) | (np.diff(cell) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                if a == b:
                    continue
                if at[a] != piece:
                    for x in best or ():
                        yield x.told()
                    piece, parts, best = at[a], [], None
                if side[a] == 0:
                    some = batch.slice(a, b - a)
                    parts.append((some.column("id").to_numpy(zero_copy_only=False), some.column("data").to_pylist()))
                    continue
                if best is None:
                    best, parts = held(parts) if parts else [], []
                for i in range(a, b, block_rows) if best else ():
                    block = rows_of(batch.slice(i, min(block_rows, b - i)), cell[a])
                    for x in best:
                        x.meet(slot_of[cell[a]], *block)
        for x in best or ():
            yield x.told()

    return run


def _pieces(tree: CellTree, targets: np.ndarray, rows: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each upper node, from how many targets probe and how many rows lie in
    each cell: into how many pieces its targets and its rows are dealt, and the
    number of its first piece."""
    n, dim = tree.children.shape[0], tree.cells.shape[1]
    at = lambda x: np.bincount(tree.parent, weights=x, minlength=n)
    work, entries, visits = at(targets * rows), at(rows), np.zeros(n)
    np.maximum.at(visits, tree.parent, targets)
    wanted = np.maximum(1, np.ceil(work * pieces / max(1.0, work.sum())))
    # the cheapest cut of so many pieces: both sides travel about as much
    ts = np.minimum(wanted, np.maximum(1, np.round(np.sqrt(wanted * 2 * visits / np.maximum(1, entries)))))
    ts = np.maximum(ts, np.ceil(visits * 4 * dim / HELD_BYTES)).astype("i8")
    cs = np.ceil(wanted / ts).astype("i8")
    return ts, cs, np.cumsum(ts * cs) - ts * cs


def _dealt(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number below ``n`` from each id."""
    return ((ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype("i8") % n


def _every(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 0..n-1) of each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def topk_approx(targets: DataFrame, corpus: DataFrame, k: int = 5, target_key: str = "vec_id",
                corpus_key: str = "vec_id", vec: str = "embedding", block_rows: int = 2048,
                exclude_self: bool = True, min_sim: float | None = None, seed: int = 42,
                probes: int | None = None, visited: int | None = VISITED) -> DataFrame:
    """target_id, vec_id, rank, similarity, as :func:`vectors.topk_similar`.
    ``probes`` cells, a quarter of them if left out, are searched per target;
    with all of them and ``visited=None`` the result is that of the exact search.
    Rows without an id take no part."""
    asked = targets.where(F.col(vec).isNotNull()).select(F.col(target_key).cast("long").alias("target_id"), VX.packed(VX.as_double(vec)).alias("tp"))
    given = written(corpus.where(F.col(vec).isNotNull()).select(
        F.col(corpus_key).cast("long").alias("vec_id"), VX.packed(VX.as_double(vec)).alias("cp")), "ann-corpus")
    t = asked.select("target_id", VX.normalize(VX.unpacked("tp")).alias("tv"))
    c = given.select("vec_id", VX.normalize(VX.unpacked("cp")).alias("cv"))
    rows = given.count()  # from the files' footers
    tree = cell_tree(c, rows, seed)
    probed = tree.probes if probes is None else probes
    known_c, known_t = c.where(F.col("vec_id").isNotNull()), t.where(F.col("target_id").isNotNull())

    def lies(batches):
        for pdf in batches:
            for part in _parts(pdf, max(1, ROWS_AT_ONCE // SPILL)):
                yield pd.DataFrame({"cell": tree.descend(np.vstack(part["cv"].to_numpy()), SPILL, MARGIN, visited)[1].astype("i4")})

    def ask(batches):
        for pdf in batches:
            for part in _parts(pdf, max(1, ROWS_AT_ONCE // max(1, min(probed, len(tree.cells))))) if len(tree.cells) else ():
                at, cell = tree.descend(np.vstack(part["tv"].to_numpy()), probed, None, visited)
                yield pd.DataFrame({"target_id": part["target_id"].to_numpy()[at], "cell": cell.astype("i4")})

    def counted(df: DataFrame) -> np.ndarray:
        out = np.zeros(len(tree.cells))
        for r in df.groupBy("cell").count().collect():
            out[r["cell"]] = r["count"]
        return out

    # a row per cell
    per_cell = counted(known_t.mapInPandas(ask, "target_id long, cell int")), counted(known_c.mapInPandas(lies, "cell int"))
    ts, cs, first = _pieces(tree, *per_cell, PIECES_PER_CORE * c.sparkSession.sparkContext.defaultParallelism)
    width = -(-tree.children.shape[1] // 8) if len(tree.cells) else 0

    def place(batches):
        for pdf in batches:
            for part in _parts(pdf, max(1, ROWS_AT_ONCE // (SPILL * int(ts.max(initial=1))))):
                v, ids = np.vstack(part["cv"].to_numpy()), part["vec_id"].to_numpy("i8")
                at, cell = tree.descend(v, SPILL, MARGIN, visited)
                node = tree.parent[cell]
                code, step, left = _quantise(v[at] - tree.cells[cell])
                data = np.array([x.tobytes() for x in code] + [None], dtype=object)[:-1]
                i, sub = _every(ts[node])
                piece = first[node[i]] + sub * cs[node[i]] + _dealt(ids[at[i]], cs[node[i]])
                yield pd.DataFrame({"piece": piece.astype("i4"), "side": np.ones(len(i), "i4"), "cell": cell[i].astype("i4"),
                                    "id": ids[at[i]], "data": data[i], "step": step[i], "gap": left[i]})

    def send(batches):
        most = min(visited or len(tree.tops), len(tree.tops)) * int(cs.max(initial=1))
        for pdf in batches:
            for part in _parts(pdf, max(1, ROWS_AT_ONCE // max(1, most))) if len(tree.cells) else ():
                v, ids = np.vstack(part["tv"].to_numpy()), part["target_id"].to_numpy("i8")
                at, cell = tree.descend(v, probed, None, visited)
                node = tree.parent[cell]
                # a row per target and node, with a bit for each cell probed there
                met, where = np.unique(at * len(tree.tops) + node, return_inverse=True)
                bits = np.zeros((len(met), 8 * width), dtype=bool)
                bits[where, np.argmax(tree.children[node] == cell[:, None], axis=1)] = True
                at, node = met // len(tree.tops), met % len(tree.tops)
                packed, single = np.packbits(bits, axis=1), v.astype("f4")
                data = np.array([single[x].tobytes() + y.tobytes() for x, y in zip(at, packed)] + [None], dtype=object)[:-1]
                i, sub = _every(cs[node])
                piece = first[node[i]] + _dealt(ids[at[i]], ts[node[i]]) * cs[node[i]] + sub
                yield pd.DataFrame({"piece": piece.astype("i4"), "side": np.zeros(len(i), "i4"), "cell": np.full(len(i), -1, "i4"),
                                    "id": ids[at[i]], "data": data[i], "step": np.zeros(len(i)), "gap": np.zeros(len(i))})

    every = known_t.mapInPandas(send, _PIECE).unionByName(known_c.mapInPandas(place, _PIECE))
    every = every.repartitionById(max(1, int((ts * cs).sum())), F.col("piece")).sortWithinPartitions("piece", "side", "cell")
    met = every.mapInArrow(_node_search(tree, k, exclude_self, min_sim, block_rows), "target_id long, vec_id long, low double, high double")
    # a row met below several nodes counts once; one shuffle serves all windows
    one = met.repartition("target_id").groupBy("target_id", "vec_id").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    place_of = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("low"), "vec_id"))
    kth = F.min(F.when(F.col("place") <= k, F.col("low"))).over(Window.partitionBy("target_id"))
    full = F.max("place").over(Window.partitionBy("target_id")) >= k
    left = one.withColumn("place", place_of).withColumn("kth", F.when(full, kth)).where(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).select("target_id", "vec_id")
    pairs = left.join(given, "vec_id").join(asked, "target_id")
    scored = pairs.select("target_id", "vec_id", VX.dot(VX.normalize(VX.unpacked("tp")), VX.normalize(VX.unpacked("cp"))).alias("similarity"))
    if min_sim is not None:
        scored = scored.where(F.col("similarity") >= min_sim)
    w = Window.partitionBy("target_id").orderBy(F.desc(F.round("similarity", 9)), F.asc("vec_id"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("target_id", "vec_id", F.col("rank").cast("long").alias("rank"), "similarity")


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact (target, neighbour) pairs the approximate result found."""
    hit = exact.join(approx.select("target_id", "vec_id", F.lit(1).alias("_h")),
                     ["target_id", "vec_id"], "left")
    return hit.agg((F.count("_h") / F.count(F.lit(1))).alias("recall"))
