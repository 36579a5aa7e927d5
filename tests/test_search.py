"""Approximate search by the cell tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptlens.operators import ann
from promptlens.operators.vectors import topk_similar
from promptlens.plans import views as V


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_with_a_quarter_of_the_cells(spark, sf):
    e = V.emb(spark, f"/root/testdata/{sf}")
    near = ann.topk_approx(e, e, k=5)
    recall = ann.recall_at_k(near, topk_similar(e, e, k=5)).first()[0]
    assert recall >= 0.95
    rows = e.count()
    tree = ann.cell_tree(e.select("vec_id", F.col("embedding").alias("cv")), rows, 42)
    assert len(tree.cells) == int(np.ceil(rows ** 0.5)) and tree.probes <= len(tree.cells) / 4


def odd_vectors():
    rng = np.random.default_rng(5)
    hot = rng.normal(size=24)
    vectors = [*rng.normal(size=(260, 24)), *[hot] * 130, *(hot + 1e-6 * rng.normal(size=(10, 24))), np.zeros(24)]
    return [(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, None)]


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_all_cells_give_the_exact_result(spark, block_rows):
    """A third of the rows is one vector, some are nearly it, one is zero; the
    intervals of the quantised residuals lose nothing."""
    df = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<double>").repartition(5)
    known = df.where("embedding is not null")
    want = {(r["target_id"], r["rank"]): (r["vec_id"], round(r["similarity"], 9)) for r in topk_similar(known, known, k=4).collect()}
    got = ann.topk_approx(df, df, k=4, probes=10_000, visited=None, block_rows=block_rows).collect()
    assert {(r["target_id"], r["rank"]): (r["vec_id"], round(r["similarity"], 9)) for r in got} == want


def test_intervals_hold_the_cosine():
    rng = np.random.default_rng(1)
    for scale in (1.0, 1e-3, 1e-9, 0.0):
        r = rng.normal(size=(200, 48)) * scale
        code, step, left = ann._quantise(r)
        t = rng.normal(size=48)
        t /= np.linalg.norm(t)
        assert (np.abs(r @ t - (code @ t) * step) <= left).all()


def test_a_tree_is_descended_by_its_children_only(monkeypatch):
    rng = np.random.default_rng(2)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 16)))
    tops, cells, v = unit(6), unit(40), unit(70)
    tree = ann.CellTree(tops, cells, np.argmax(cells @ tops.T, axis=1))
    monkeypatch.setattr(ann, "SCORES_AT_ONCE", 100)  # several chunks
    rows, found = tree.descend(v, 5, visited=2)
    for i in range(70):
        seen = np.argsort(-(v[i] @ tops.T))[:2]
        below = np.flatnonzero(np.isin(tree.parent, seen))
        want = below[np.argsort(-(cells[below] @ v[i]))][:5]
        assert list(found[rows == i]) == list(want)
    rows, found = tree.descend(v, 5, margin=0.0, visited=None)
    assert list(found) == list(np.argmax(v @ cells.T, axis=1))


def test_empty_and_tiny_corpora(spark):
    schema = "vec_id long, embedding array<double>"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, [1.0, 0.0])], schema)
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], schema)
    assert ann.topk_approx(one, none, k=3).count() == 0 and ann.topk_approx(none, one, k=3).count() == 0
    assert ann.topk_approx(one, one, k=3).count() == 0
    assert [tuple(r) for r in ann.topk_approx(one, two, k=3, min_sim=0.5).collect()] == [(1, 2, 1, 0.6)]
    assert ann.topk_approx(one, two, k=3, min_sim=0.7).count() == 0


def test_a_search_hands_on_few_rows_at_once(spark, monkeypatch):
    """A target goes to many cells: the rows that a task holds are bounded by
    the rows handed on at once, not by the vectors in a batch."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))], "vec_id long, embedding array<double>").coalesce(1)
    seen = []
    old = type(df).mapInPandas

    def watched(self, func, schema, *rest, **more):
        seen.append((self, func, schema))
        return old(self, func, schema, *rest, **more)

    monkeypatch.setattr(type(df), "mapInPandas", watched)
    ann.topk_approx(df, df, k=3, probes=30, visited=None)
    asked = [(f, func) for f, func, schema in seen if schema.startswith("target_id")]
    assert len(asked) == 1
    batches = list(asked[0][1](iter([asked[0][0].toPandas()])))
    assert sum(map(len, batches)) == 900 * 30 and max(map(len, batches)) <= 8192


def test_a_target_travels_once_per_upper_node(spark, monkeypatch):
    """A copy for each probed cell made the shuffle grow much faster than the
    vectors; a task has all cells below a node."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))], "vec_id long, embedding array<double>").coalesce(1)
    seen, old = [], type(df).mapInPandas

    def watched(self, func, schema, *rest, **more):
        seen.append((self, func, schema))
        return old(self, func, schema, *rest, **more)

    monkeypatch.setattr(type(df), "mapInPandas", watched)
    monkeypatch.setattr(ann, "PIECES_PER_CORE", 1)
    ann.topk_approx(df, df, k=3)
    batches = [list(func(iter([f.toPandas()]))) for f, func, schema in seen if schema == ann._PIECE]
    assert len(batches) == 2 and all(len(b) <= ann.ROWS_AT_ONCE for some in batches for b in some)
    sent = [r for some in batches for b in some for r in b[["id", "side", "piece"]].itertuples(index=False) if r.side == 0]
    assert 900 < len(sent) <= 900 * ann.VISITED and len(set(sent)) == len(sent)


def test_pieces_of_a_node_give_the_same(spark, monkeypatch):
    """Cut into many pieces on both sides; rows that come twice count twice,
    rows without an id take no part, nor does a target find itself."""
    rows = odd_vectors()
    df = spark.createDataFrame(rows + rows[:30] + [(None, rows[0][1])], "vec_id long, embedding array<double>").repartition(5)
    known = df.where("embedding is not null and vec_id is not null")
    told = lambda x: sorted((r["target_id"], r["rank"], r["vec_id"], round(r["similarity"], 9)) for r in x.collect())
    once = known.dropDuplicates(["vec_id"])
    want = told(topk_similar(once, known, k=4))
    monkeypatch.setattr(ann, "HELD_BYTES", 1 << 12)
    monkeypatch.setattr(ann, "PIECES_PER_CORE", 30)
    assert told(ann.topk_approx(once, df, k=4, probes=10_000, visited=None, block_rows=16)) == want
    some = told(ann.topk_approx(once, df, k=4, probes=10_000, visited=None, min_sim=0.2))
    assert some == [x for x in want if x[3] >= 0.2]


def test_pieces_follow_the_work():
    rng = np.random.default_rng(4)
    tree = ann.CellTree(np.zeros((4, 8)), np.zeros((16, 8)), np.arange(16) % 4)
    rows = np.where(tree.parent == 2, 9000, 100)  # a node with most of the rows
    ts, cs, first = ann._pieces(tree, np.full(16, 500), rows, 24)
    assert (ts * cs)[2] >= 20 and (ts * cs)[[0, 1, 3]].max() <= 2
    assert list(first) == [0, *np.cumsum(ts * cs)[:-1]]
    n = rng.integers(1, 5, 20)
    row, sub = ann._every(n)
    assert [(r, s) for r, s in zip(row, sub)] == [(r, s) for r in range(20) for s in range(n[r])]


def test_vectors_are_packed_without_loss(spark):
    from promptlens.functions import vector as VX

    vectors = [[0.5, -0.0, float("nan")], [0.1, 1.0], [1e300, 1.0], [float("inf"), 1.0], [None, 1.0], [], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>").withColumn("p", VX.packed("v"))
    got = df.select("i", F.col("p.single").isNotNull().alias("single"), VX.unpacked("p").alias("u")).orderBy("i").collect()
    assert [repr(r["u"]) for r in got] == [repr(v) for v in vectors]
    assert [r["single"] for r in got] == [True, False, False, True, False, True, False]
