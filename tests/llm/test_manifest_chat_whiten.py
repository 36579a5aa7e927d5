"""Merkle manifest (op 11), chat formatting (op 12), whitening (op 13)."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptlens.llm import chat, merkle, whiten

# -- op 11 ---------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    told = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))
    return h(*told)


def plain_tree(nodes):
    """Root, and by leaf the siblings [(before, after)] up to it."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_under = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a:a + 3]
            for j in range(len(run)):
                for leaf in under[a + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(h(*run))
            up_under.append([x for u in under[a:a + 3] for x in u])
        nodes, under = up, up_under
    return nodes[0], paths


def plain_manifest(rows):
    by_source, out = {}, []
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    held = []
    for s in sources:
        leaves = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        held.append((leaves, *plain_tree([plain_leaf(r, r[1]) for r in leaves])))
    root, tops = plain_tree([t for _, t, _ in held])
    for (leaves, top, paths), above in zip(held, tops):
        for r, path in zip(leaves, paths):
            path = path + above
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            node = plain_leaf(r, r[1] if odd or r[1] is None else r[1].replace("\n", ""))
            for before, after in path:
                node = h(before, node, after)
            out.append((r[0], plain_leaf(r, r[1]), top, root, h(*("".join(p) for p in path)), node, node == root))
    return sorted(out, key=repr)


def manifest_rows():
    rng = random.Random(5)
    rows = [(i, f"line {i}\nmore é\n" * (i % 3), "en", f"s{rng.randrange(4)}", i) for i in range(60)]
    rows += [(100 + i, f"hot\n{i}", None, "hot", None) for i in range(140)]
    rows += [(None, "x\ny", "en", "s1", 3), (None, None, None, None, None), (7, "twice\n", "en", "s1", 1), (7, "again\n", "en", "s1", 1),
             (900, "", "en", "", 0), (901, "long\n" * 40_000, "de", "single", 1), (-5, "\n", "en", None, 1)]
    return rows + [(500, "same\n", "en", "copies", 5)] * 41


@pytest.mark.parametrize("parts", [1, 5])
def test_manifest_matches_a_plain_tree(spark, parts):
    rows = manifest_rows()
    random.Random(parts).shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    docs = docs.withColumn("digest", F.lit("clash")).withColumn("tree", F.lit(1)).withColumn("path", F.lit(2))
    crc = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    claimed = F.when(crc, merkle.digest(docs, F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(merkle.digest(docs))
    got = merkle.verify(*merkle.manifest(docs, claimed)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows)


def test_manifest_of_few_rows(spark):
    empty, root = merkle.manifest(spark.createDataFrame([], DOCS))
    assert root is None and merkle.verify(empty, root).count() == 0
    one = [(1, "a", "en", "s", 1)]
    told, leaf = merkle.verify(*merkle.manifest(spark.createDataFrame(one, DOCS))).collect(), h("1:1", "1:s", "2:en", "1:1", "1:a")
    assert [tuple(r) for r in told] == [(1, leaf, leaf, leaf, h(""), leaf, True)]


def test_manifest_keeps_apart_many_sources(spark):
    rows = [(i, "t", "en", f"{i:04d}", 1) for i in range(250)]
    got = merkle.verify(*merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(3))).collect()
    want = plain_manifest(rows)
    assert sorted(r["proof_sha256"] for r in got) == sorted(w[4] for w in want) and {r["root"] for r in got} == {want[0][3]}
    assert all(r["verified"] for r in got)


# -- op 12 ---------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
PIECES = ["<s>", "</s>", "[INST]", " [/INST]", "<<SYS>>\n", "\n<</SYS>>", "[ROLE] ", " [TEXT] ", " [/ROLE]", "\\", "<", "[", "s>", "INST]",
          "a", "é", "😀", " ", "\n", "", "<\\s>", "[\\\\/INST]", "<\\<SYS>>", "$1"]
texts = st.lists(st.sampled_from(PIECES), max_size=7).map("".join)


def back_digests(rows):
    """What has to come back, by conversation."""
    told = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        told.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(t), h(*(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"),
                h(*(x for r, x in t if r == "assistant"))) for c, t in told.items()}


def assert_round_trip(spark, rows):
    done = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(done).collect()}
    assert found == back_digests(rows)
    return done


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", " [TEXT] x", None]), texts), min_size=1, max_size=60))
def test_conversations_come_back(spark, turns):
    assert_round_trip(spark, [(i // 7, i % 7, role, text) for i, (role, text) in enumerate(turns)])


def test_marks_escapes_and_masks(spark):
    rows = [(1, 1, "user", "plain"), (1, 2, "assistant", "a </s> b \\ <\\/s>"), (1, 3, "tool", "[/ROLE]"), (2, 0, "system", "s")]
    done = {r["conv_id"]: r for r in assert_round_trip(spark, rows).collect()}
    assert done[1]["formatted"] == "[INST] plain [/INST]<s> a <\\/s> b \\ <\\\\/s> </s>[ROLE] tool [TEXT] [\\/ROLE] [/ROLE]"
    assert [done[1]["formatted"][s["start"]:s["end"]] for s in done[1]["loss_mask"]] == ["a <\\/s> b \\ <\\\\/s>"]
    assert done[2]["formatted"] == "<<SYS>>\ns\n<</SYS>>" and done[2]["loss_mask"] == []


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (3, 1, "assistant", "😀<s>" * 9_000), (3, 2, "assistant", ""),
            (3, 3, "assistant", "yz" * 6_000), (4, 1, "user", "twin"), (4, 1, "user", "twin"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a")]
    assert_round_trip(spark, rows)
    clash = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", formatted string, shown int")
    assert chat.format_conversations(clash).count() == 3
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_one_conversation_with_very_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} <s>") for i in range(5_000)]
    assert_round_trip(spark, rows + [(2, 0, "user", "x")])


def test_chat_parser_refuses_what_is_not_in_the_grammar(spark):
    bad = ["[INST] a", "x[INST] a [/INST]", "[INST] a <s> [/INST]", "<s> a </s> ", "[ROLE] a [/ROLE]"]
    got = spark.createDataFrame([(b,) for b in bad], "f string").select(chat.parse(F.col("f")).alias("p")).collect()
    assert [r["p"] for r in got] == [None] * len(bad)


def test_chat_sql_on_odd_roles(spark, tmp_path):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(itertools.product(["user", "system", "assistant", "tool", None, "[ROLE]"], PIECES))]
    spark.createDataFrame(rows, TURNS).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op12_chat_format(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(chat.OP12_SQL).fetchall())


# -- op 13 ---------------------------------------------------------------------

def plain_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, "f8")).astype("i8") + 1_000_000
    n, s = len(x), x.sum(axis=0)
    rows = (n * x - s) / n
    values, parts = np.linalg.eigh(rows.T @ rows / n)
    values, parts = values[::-1], parts[:, ::-1]
    return ((n * x - s) ** 2).sum(axis=1), values, rows @ parts[:, :k] / np.sqrt(values[:k])


def whitened(spark, rows, wanted=32):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    return whiten.whiten(df.withColumn("x", F.lit(1)).withColumn("ids", F.lit(2)), wanted).toPandas()


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((300, 12)) * np.linspace(3, 0.5, 12) + 5
    got = whitened(spark, [(i, v.tolist()) for i, v in enumerate(vectors)], wanted=5)
    far, values, want = plain_whitening(vectors, 5)
    found = got.sort_values(["vec_id", "component"])
    assert len(found) == 1500 and set(found.n) == {300} and found.identity_error.nunique() == 1
    assert (found.deviation.values.reshape(300, 5) == far[:, None]).all()
    mine = found.whitened.values.reshape(300, 5)
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * sign - want).max() < 1e-9 and found.identity_error.max() < 1e-12
    assert np.allclose(found.explained.values[:5], values[:5] / values.sum(), rtol=1e-12)


def test_repeated_eigenvalues_and_low_rank(spark):
    # +-1 along each axis: every eigenvalue is the same
    cross = [(i, (np.eye(6)[i % 6] * (1 if i < 6 else -1)).tolist()) for i in range(12)]
    got = whitened(spark, cross)
    assert sorted(set(got.component)) == [1, 2, 3, 4, 5, 6] and got.identity_error.max() < 1e-9
    assert np.allclose(got.explained, 1 / 6)
    three = [(i, [float(i), 2.0 * i, 5.0, float(i == 2)]) for i in range(3)]
    got = whitened(spark, three)
    assert sorted(set(got.component)) == [1, 2] and got.identity_error.max() < 1e-9
    assert len(whitened(spark, [(i, [1.0, 2.0]) for i in range(4)])) == 0  # copies only: no component
    assert len(whitened(spark, [(1, [1.0, 2.0])])) == 0


def test_a_hot_vector_does_not_hide_components(spark):
    rng = np.random.default_rng(3)
    vectors = np.r_[np.tile(rng.standard_normal(10), (400, 1)), rng.standard_normal((90, 10))]
    got = whitened(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    far, values, want = plain_whitening(vectors, 10)
    mine = got.sort_values(["vec_id", "component"]).whitened.values.reshape(490, 10)
    assert np.abs(np.abs(mine) - np.abs(want)).max() < 1e-8 and got.identity_error.max() < 1e-10


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0, 0.0]), (None, [0.0, 1.0]), (6, [1.0, 0.0]),
            (7, [1e300, -1e300]), (8, [1.0]), (9, [2.0]), (10, [3.0])]
    got = whitened(spark, rows)
    two, one = got[got.n == 4], got[got.n == 3]
    assert sorted(set(one.vec_id)) == [8, 9, 10] and len(one) == 3
    assert two.vec_id.isna().sum() > 0 and (two.vec_id == 6).sum() == 2 * two.component.max()
    assert set(two[two.vec_id == 7].deviation) == {2 ** 63 - 1} and np.isfinite(got.whitened).all()
    assert len(whitened(spark, [(1, None)])) == 0
    one = one.sort_values("vec_id")
    assert list(one.deviation) == [(3 * 64) ** 2, 0, (3 * 64) ** 2] and np.allclose(np.abs(one.whitened), [1.5 ** 0.5, 0, 1.5 ** 0.5])


def test_many_blocks_are_added_up_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(whiten, "COLLECTED", 3)
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((64, 4))
    got = whitened(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    assert got.identity_error.max() < 1e-12 and len(got) == 256


def test_bidiagonalisation_alone():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 90)) * 0.93 ** np.arange(90)
    x -= x.mean(axis=0)
    steps = []

    def sweep(v, a):
        steps.append(1)
        w = x @ v - x @ a
        return float(w @ w), x.T @ w

    values, parts = whiten.bidiagonalise(sweep, 90, 200, wanted=6)
    want = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(values[:6], want[:6], rtol=1e-13) and np.abs(parts.T @ parts - np.eye(parts.shape[1])).max() < 1e-12
    assert len(steps) < 90  # settled before the whole space was searched
