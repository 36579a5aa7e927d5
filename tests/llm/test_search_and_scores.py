"""LM scores (op 4), winnowing (op 8), exact top-k (op 9), Jaccard join (op 10)."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptlens.llm import components, decontaminate, jaccard, lm, topk

DOCS = "doc_id long, text string"


# -- op 4 ----------------------------------------------------------------------

def lm_docs(n=120):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "A", "a"]
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 40]) for _ in range(rng.randrange(30)))) for i in range(n)]
    return rows + [(500, None), (501, ""), (None, "w1 w2"), (7, "w3\tw4\n\x0bw5 a A"), (502, "w1 " * 30_000)]


def test_lm_scores_match_a_plain_model(spark, monkeypatch):
    rows = lm_docs()
    held = {r: zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 == 2 for r in rows}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {r: [*(w for w in (r[1] or "").translate(lower).replace("\x0b", " ").split() if w), ""] for r in rows}
    one, two = collections.Counter(), collections.Counter()
    for r in rows:
        if not held[r]:
            one.update(toks[r])
            two.update(zip(["", *toks[r]], toks[r]))
    n, v = sum(one.values()), len(one)
    stands = lm.level_counts()
    about = lambda c: stands[lm.levels(np.array([c]))[0]] if c >= lm.MIN_COUNT else 0.0
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).repartition(3)
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)
    got = lm.score(docs).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    want = sorted((len(toks[r]), sum(one[t] > 0 for t in toks[r]), sum(math.log10((one[t] + 1) / (n + v + 1)) for t in toks[r]), r) for r in rows)
    found = sorted((r["n_tokens"], r["n_known"], r["base_score"], r) for r in got)
    off = 0
    for w, f in zip(want, sorted(found, key=lambda x: x[:3])):
        assert w[:2] == f[:2] and math.isclose(w[2], f[2], rel_tol=1e-9)
    by_id = {r["doc_id"]: r for r in got}
    for r in rows:
        if r[0] == 7:
            continue
        score = 0.0
        for u, w in zip(["", *toks[r]], toks[r]):
            p1 = (about(one[w]) + 1) / (n + v + 1)
            both = min(about(two[u, w]), max(about(one[u]), 1), max(about(one[w]), 1))
            score += math.log10((both + lm.PRIOR * p1) / (about(one[u]) + lm.PRIOR))
        off += not math.isclose(score, by_id[r[0]]["score"], rel_tol=1e-6)
    assert off <= len(rows) * 0.05  # false positives of the filter


def test_levels():
    counts = np.arange(1, 5000)
    q = lm.levels(counts)
    assert q[0] == 1 and (np.diff(q.astype(int)) >= 0).all()
    stands = lm.level_counts()[q]
    assert (np.abs(stands - counts) <= 0.16 * counts + 0.5).all()


def test_filter_keeps_every_gram_and_few_others():
    """Levels are never too low, and seldom too high."""
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 2 ** 63, 20_000).astype("u8")
    level = rng.integers(1, 9, 20_000).astype("u1")
    size = lm.segment_size(int(level.sum(dtype="i8")))
    filt = lm.LogFrequencyFilter(np.packbits(lm.segment(grams, level, size), bitorder="little"), size, 1)
    assert (filt.levels(grams) >= level).all() and (filt.levels(grams) == level).mean() > 0.98
    assert (filt.levels(rng.integers(0, 2 ** 63, 20_000).astype("u8")) > 0).mean() < 0.02


def test_a_word_of_every_chunk_is_summed_before_it_moves(spark, monkeypatch):
    """A hot word, one text per chunk: exact counts, and no window by word."""
    monkeypatch.setattr(lm, "chunks", lambda docs, f=lm.chunks: f(docs, 1))
    rows = [(i, "hot hot " + f"w{i}", i % 3 == 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS + ", held_out boolean").repartition(3)
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    n, v = 4 * 40, 40 + 2
    assert {r["train_tokens"] for r in got.values()} == {n}
    for i, _, held in rows:
        counts = [80, 80, 0 if held else 1, 40]
        assert math.isclose(got[i]["base_score"], sum(math.log10((c + 1) / (n + v + 1)) for c in counts), rel_tol=1e-9)
        assert got[i]["n_known"] == (3 if held else 4)


def test_lm_filter_grows_with_the_grams(spark, monkeypatch):
    """Many buckets, small chunks: every gram seen is found, once or more."""
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 100)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(30)), i % 5 == 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS + ", held_out boolean").repartition(3)
    toks = {i: [*t.split(), ""] for i, t, _ in rows}
    one, two = collections.Counter(), collections.Counter()
    for i, _, held in rows:
        if not held:
            one.update(toks[i])
            two.update(zip(["", *toks[i]], toks[i]))
    coded = lm.chunks(docs, 200).cache()
    assert coded.count() > 6
    buckets = 19
    answers = collections.defaultdict(list)
    for r in lm.gram_levels(coded, buckets).collect():
        answers[r["chunk"]].append((r["bucket"], r["levels"]))
    checked = wrong = 0
    for r in coded.collect():
        r = r.asDict()
        pair, _, order, *_ = lm.chunk_grams(r, buckets)
        level = np.empty(len(order), "u1")
        level[order] = np.frombuffer(b"".join(d for _, d in sorted(answers[r["chunk"]])), "u1")
        w = r["words"]
        counts = np.array([two[w[p >> 32], w[p & 0xFFFFFFFF]] for p in pair.tolist()] + [one[x] for x in w])
        want = np.where(counts > 0, lm.levels(np.maximum(counts, 1)), 0)
        assert (level >= want).all()
        checked, wrong = checked + len(want), wrong + (level != want).sum()
    assert wrong <= 0.02 * checked
    coded.unpersist()


def test_lm_of_nothing(spark):
    none = spark.createDataFrame([], DOCS + ", held_out boolean")
    assert lm.score(none).count() == 0
    only = lm.score(spark.createDataFrame([(1, "a b", True)], none.schema)).first()
    assert only["base_score"] == 0 and only["score"] == 0 and only["n_known"] == 0 and only["train_tokens"] == 0


# -- op 8 ----------------------------------------------------------------------

def plain_words(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in lowered).split(" ")


def plain_contamination(text, items):
    words = [w for w in plain_words(text) if w]
    hit, found = set(), set()
    for item_id, item in items:
        iw = [w for w in plain_words(item) if w]
        m = min(10, len(iw))
        if item_id is None or not m:
            continue
        windows = {tuple(iw[i:i + m]) for i in range(len(iw) - m + 1)}
        for i in range(len(words) - m + 1):
            if tuple(words[i:i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("short", [True, False])
def test_winnowing_matches_brute_force(spark, short):
    rng = random.Random(8 + short)
    words = ["the", "É", "a1", "b", "c", "It", "ß"]
    sep = [" ", "-", "\n", ", "]
    text = lambda n, k=7: "".join(rng.choice(words[:k]) + rng.choice(sep) for _ in range(n))
    items = [(i, text(rng.randrange(10, 40))) for i in range(8)] + [(3, text(15)), (8, "!!"), (9, None), (None, text(12)), (20, "a1 " * 30)]
    items += [(30, "É b c"), (31, "ß"), (32, text(9))] if short else []
    rows = [(i, text(rng.randrange(60), 3 + i % 5)) for i in range(60)]
    rows += [(100 + i, text(20) + " " + items[i % 8][1] + " " + text(20)) for i in range(20)]
    rows += [(200, None), (201, ""), (None, items[0][1]), (5, "x " + items[1][1]), (5, "x " + items[1][1]), (202, "É a1 " * 20_000 + items[2][1])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("hash", F.lit("clash")).repartition(3)
    found = decontaminate.contamination(docs.select("doc_id", "text", "hash"), spark.createDataFrame(items, "item_id long, text string")).collect()
    key = lambda x: (x[0] is not None, x)
    want = sorted(((r[0], *plain_contamination(r[1], items)) for r in rows), key=key)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=key) == want
    assert any(r["n_items"] for r in found) and all(r["n_items"] == len(r["items"]) for r in found)


def test_winnowing_of_final_sigmas(spark):
    """Lower case of a capital sigma depends on what follows it."""
    long = " ".join(f"ΟΔΟΣ{c} ΛΟΓΟΣ" for c in "abcdefgh")
    items = [(1, "ΛΟΓΟΣ ΝΕΟΣ"), (2, long), (3, "λογος"), (4, "λογοσ")]
    texts = [(1, "ΛΟΓΟΣ.ΝΕΟΣ"), (2, long.replace(" ", ".")), (3, "ΛΟΓΟΣ'ΝΕΟΣ:ΛΟΓΟΣ"), (4, "λογος"), (5, "λογοσ.x"), (6, "ΛΟΓΟΣ"), (7, "ΝΕΟΣ ΛΟΓΟΣ")]
    found = decontaminate.contamination(spark.createDataFrame(texts, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()}
    assert got == {i: plain_contamination(t, items) for i, t in texts}
    assert got[1] == (2, 2, ["1"]) and got[2][1] == 16 and got[3][1] == 2 and got[4][2] == ["3"] and got[7][1] == 0


def test_winnowing_edges_and_plan(spark):
    docs = spark.createDataFrame([(1, "a b c")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.contamination(docs, none).collect()] == [0]
    some = spark.createDataFrame([(1, "a b c d e f g h i j k")], none.schema)
    empty = decontaminate.contamination(docs.limit(0), some)
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# -- op 9 ----------------------------------------------------------------------

def plain_top(rows, wanted, k):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in sorted(good, key=lambda x: (x[0], x[1]), reverse=True)}.items():
        if not wanted(q):
            continue
        cut = lambda s: max(1 - 2 ** 63, min(2 ** 63 - 1, s))
        scores = sorted((-cut(sum(a * b for a, b in zip(v, c))), i) for i, c in good if i != q and len(c) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CORPUS_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 1.0]) for _ in range(4)]) for i in range(150)]
    rows += [(200, None), (203, [1.0, None, 0.0, 0.0]), (206, [float("nan"), 0.0, 0.0, 0.0]), (209, [float("inf")] * 4), (None, [1.0] * 4),
             (9, [0.1, 0.1]), (300, [2.0, 0.5]), (151, rows[3][1]), (151, rows[3][1]), (210, [3e14, -2e14, 1.0, 1.0]), (303, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).repartition(4)
    got = topk.top_k(vectors.filter("vec_id % 3 = 0 and vec_id <> 9").select("vec_id", "embedding"), vectors.select("vec_id", "embedding"), 5, shards=9)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, lambda q: q % 3 == 0 and q != 9, 5)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none).count() == 0


def test_top_k_sends_nothing_through_the_driver(spark, monkeypatch):
    """A copy of the queries per shard was broadcast: queries x shards met in
    the driver. Groups of query blocks are bounded by their bytes."""
    monkeypatch.setattr(topk, "CORPUS_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "HELD_BYTES", 400)
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 1.0]) for _ in range(4)]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = topk.top_k(vectors.filter("vec_id % 2 = 0"), vectors, 5, shards=7)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, lambda q: q % 2 == 0, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


# -- op 10 ---------------------------------------------------------------------

def plain_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(rows):
    sets = [plain_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    least = {k: min(v) for k, v in groups.items()}
    return sorted((r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "LIST_PER_SALT", 3)
    monkeypatch.setattr(jaccard, "SAMPLE_SHARE", 0.4)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 90))]
        for c in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randrange(2)] = [rng.choice(words)]
            rows.append((1000 * i + 7 * c, " ".join(copy).upper() if c == 2 else "  ".join(copy)))
    rows += [(50_000 + i, passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([4, 12, 40])))) for i in range(25)]
    rows += [(60_000, None), (60_001, ""), (60_002, " \t\n"), (60_003, "w1"), (60_004, "W1"), (60_005, "w1 w2"), (60_006, "a b " * 10_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")).repartition(5)
    got = sorted(map(tuple, jaccard.similar(docs).collect()))
    assert got == plain_classes(rows)


def test_jaccard_ids(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "lonely text without an id"), (9, "other words in this one here")]
    got = sorted(map(tuple, jaccard.similar(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 1, None), (9, 2, 9)], key=str)
    assert jaccard.similar(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_of_repeated_and_missing_ids_keep_their_links(spark):
    """A null id bridges others and takes their smallest id; rows of one id are
    linked each by its own text, however often a row is repeated."""
    base = [f"w{i}" for i in range(90)]
    step = lambda k: " ".join(base[k:] + [f"x{i}" for i in range(k)])  # noqa: E731  about k / 90 away from its neighbours
    other = " ".join(f"y{i}" for i in range(40))
    rows = [(5, step(0)), (None, step(8)), (9, step(16)), (5, other), (20, other + " tail"), (None, "alone in the world is this text")]
    rows += [(30, " ".join(f"z{i}" for i in range(50)))] * 60 + [(31, " ".join(f"z{i}" for i in range(50)) + " end")] * 60
    assert not linked(rows[0][1], rows[2][1]) and linked(rows[0][1], rows[1][1]) and linked(rows[1][1], rows[2][1])
    got = collections.Counter(tuple(r)[:1] + (tuple(r)[2],) for r in jaccard.similar(spark.createDataFrame(rows, DOCS).repartition(4)).collect())
    assert got == {(5, 5): 2, (None, 5): 1, (9, 5): 1, (20, 5): 1, (None, None): 1, (30, 30): 60, (31, 30): 60}
    first = [(r["doc_id"], r["component_id"]) for r in jaccard.grouped(spark.createDataFrame(rows, DOCS)).filter("first").collect()]
    assert sorted(set(first), key=str) == sorted([(5, 5), (None, None), (30, 30)], key=str)


def linked(a, b):
    x, y = (set(zip(*(t.split()[i:] for i in range(5)))) for t in (a, b))
    return 100 * len(x & y) >= 75 * len(x | y)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 2 ** 40), max_size=60), st.sets(st.integers(0, 2 ** 40), max_size=60), st.sets(st.integers(0, 2 ** 40), max_size=200))
def test_bitmaps_lose_no_link(a, b, both):
    a, b = a | both, b | both
    if a and b:
        x, y = (np.array(sorted(s), "i8") for s in (a, b))
        may = jaccard.may_link(len(x), jaccard.bitmap(x), len(y), jaccard.bitmap(y))
        assert may == jaccard.may_link(len(y), jaccard.bitmap(y), len(x), jaccard.bitmap(x))
        assert may or not jaccard.links(x, y)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 40)), st.sets(st.integers(0, 40)))
def test_probe_is_the_threshold(a, b):
    x, y = (np.array(sorted(s), "i8") for s in (a, b))
    assert jaccard.links(x, y) == (bool(a & b) and 100 * len(a & b) >= 75 * len(a | b))


def test_components_are_those_of_a_plain_search(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 501 + i) for i in range(80)] + [(9, 9)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    assert got == {k: v for k, v in want.items() if near[k] - {k}}


def test_shingle_hashes_are_distinct_as_the_words_are():
    assert len(jaccard.shingles("a b c d e f a b c d e")) == 6
    assert jaccard.shingles("A b").tolist() == jaccard.shingles("a  b").tolist() != jaccard.shingles("ab").tolist()
