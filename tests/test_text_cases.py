"""Hand-derived literal cases (text rules, counts, small metrics)."""

import math

from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.functions import vector as VX
from promptlens.operators import textsim as TS

CASES = [
    # text, words, sentences, question, instruction, context, code, list, explanation
    ("What is Spark?", 3, 2, True, False, False, False, False, False),
    ("Candle light", 2, 1, True, False, False, False, False, False),
    ("Create a list: a, b", 5, 1, False, True, True, False, False, False),
    ("Hi. There!", 2, 3, False, False, False, False, False, False),
    ("1. one\n2. two", 4, 3, False, False, False, False, True, False),
    ("x\n- item", 3, 1, False, False, False, False, False, False),
    ("- item", 2, 1, False, False, False, False, True, False),
    ("away from home", 3, 1, False, False, False, True, False, False),
    ("However", 1, 1, True, False, False, False, False, False),
    ("it works, therefore", 3, 1, False, False, False, False, False, True),
    ("a b  c", 3, 1, False, False, False, False, False, False),
    ("", 0, 1, False, False, False, False, False, False),
]


def test_text_rules(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "t string")
    got = df.select("t", T.word_count("t").alias("w"), T.sentence_count("t").alias("s"),
                    T.is_question("t").alias("q"), T.is_instruction("t").alias("i"),
                    T.has_context("t").alias("ctx"), T.is_code("t").alias("code"),
                    T.is_list("t").alias("lst"), T.is_explanation("t").alias("ex")).collect()
    by = {r["t"]: r for r in got}
    for c in CASES:
        r = by[c[0]]
        assert (r.w, r.s, r.q, r.i, r.ctx, r.code, r.lst, r.ex) == c[1:], c[0]


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(T.word_count("t").alias("w"), T.sentence_count("t").alias("s"),
                  T.has_context("t").alias("c"), T.is_code("t").alias("k")).first()
    assert r.w is None and r.s is None and r.c is False and r.k is False


def test_token_cost(spark):
    df = spark.createDataFrame([("one",), ("a b c d",), ("",)], "t string")
    assert [r[0] for r in df.select(T.token_estimate("t")).collect()] == [1, 3, 1]
    c = spark.range(1).select(T.cost_estimate(F.lit(1_000_000)).alias("c")).first().c
    assert abs(c - 0.02) < 1e-12


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 0.0])],
                               "a array<double>, b array<double>")
    assert [r[0] for r in df.select(VX.cosine("a", "b")).collect()] == [0.0, 1.0, 0.0]


def test_jaccard_overlap(spark):
    df = spark.createDataFrame([(1, "a b c", "b c d"), (2, "", "x")], "k int, text1 string, text2 string")
    r = {x.k: x for x in TS.jaccard_pairs(df, "k").collect()}
    assert abs(r[1].jaccard - 0.5) < 1e-12 and abs(r[1].word_overlap - 2 / 3) < 1e-12
    assert r[2].jaccard is None and r[2].word_overlap is None


def test_rouge_1_distinct(spark):
    df = spark.createDataFrame([(1, "a a b", "a b")], "k int, text1 string, text2 string")
    r = TS.rouge_pairs(df, "k").first()
    assert abs(r.rouge_1 - 1.0) < 1e-6


def test_lcs():
    ref = "the cat sat on the mat".split()
    hyp = "the cat lay on a mat".split()
    assert len(TS._lcs_positions(ref, hyp)) == 4


def _plain_lcs(ref, hyp):
    """The length table whole, walked back from its end."""
    n, m = len(ref), len(hyp)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if ref[i - 1] == hyp[j - 1] else max(t[i - 1][j], t[i][j - 1])
    out, i, j = set(), n, m
    while i and j:
        if ref[i - 1] == hyp[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i - 1][j] >= t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_lcs_positions_match_the_whole_table():
    import random
    rng = random.Random(3)
    for trial in range(300):
        letters = "ab" if trial % 3 == 0 else "abcdefgh" if trial % 3 == 1 else [f"w{i}" for i in range(40)]
        ref = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
        hyp = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
        assert TS._lcs_positions(ref, hyp) == _plain_lcs(ref, hyp), (ref, hyp)


def test_lcs_of_long_sentences_in_little_memory():
    import random
    import tracemalloc
    rng = random.Random(4)
    ref = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    hyp = [w for w in ref if rng.random() < 0.7]
    tracemalloc.start()
    found = TS._lcs_positions(ref, hyp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(hyp) and peak < 50 << 20


def test_bleu_identical_and_disjoint(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "a b", "x y"), (3, "", "x")],
                               "k int, text1 string, text2 string")
    r = {x.k: x.bleu for x in TS.bleu_pairs(df, "k").collect()}
    assert abs(r[1] - 1.0) < 1e-12
    assert r[2] == 0.0
    assert r[3] is None


def test_distinct_ngrams(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "g int, prompt string")
    r = {x.n: x.distinct_n for x in TS.distinct_ngrams(df, "g").collect()}
    assert r == {1: 0.5, 2: 0.5, 3: 0.0}


def _grams(text, n):
    w = text.lower().split()
    return [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)]


def _bleu(texts1, texts2, t1, t2):
    """By counters: of one row of a pair that may come in several rows."""
    from collections import Counter
    c, r = len(t2.split()), len(t1.split())
    if not c or not r:
        return None
    logs = 0.0
    for n in (1, 2, 3, 4):
        a, b = (Counter(g for t in texts for g in _grams(t, n)) for texts in (texts1, texts2))
        m = sum((a & b).values())
        if n == 1 and not m:
            return 0.0
        logs += math.log((m or TS.BLEU_EPSILON) / max(1, c - n + 1))
    return (1.0 if c > r else math.exp(1 - r / c)) * math.exp(logs / 4)


def test_ngrams_are_counted_where_their_texts_are(spark, monkeypatch):
    """No n-gram is shuffled, and tasks grow with the text; repeated and
    missing keys as before."""
    import random
    import re
    monkeypatch.setattr(TS, "CHARS_PER_TASK", 200)
    rng = random.Random(5)
    words = lambda: " ".join(rng.choice("abcdeF") for _ in range(rng.randrange(0, 30)))
    rows = [(i % 50, i % 2, words(), words()) for i in range(70)] + [(60, 1, None, "a b")]
    df = spark.createDataFrame(rows, "k long, slot int, text1 string, text2 string")
    bleu, distinct, vocab = TS.bleu_pairs(df, ["k", "slot"]), TS.distinct_ngrams(df, "k", "text2"), TS.vocab_diversity(df, "k", "text2")
    least = sum(len(r[3]) for r in rows) // 200
    for found in (bleu, distinct, vocab):
        dealt = re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\)", found._jdf.queryExecution().executedPlan().toString())
        assert dealt and not any("gram#" in keys or "w#" in keys for keys, _ in dealt)
        assert max(int(n) for _, n in dealt) >= least
    got, want = {}, {}
    for r in bleu.collect():
        got.setdefault((r.k, r.slot), []).append(r.bleu)
    for k, slot, a, b in rows[:-1]:
        same = [x for x in rows if x[:2] == (k, slot)]
        want.setdefault((k, slot), []).append(_bleu([x[2] for x in same], [x[3] for x in same], a, b))
    assert got.pop((60, 1)) == [0.0] and got.keys() == want.keys()
    plain = lambda xs: sorted(-1.0 if x is None else round(x, 9) for x in xs)
    assert all(plain(got[k]) == plain(want[k]) for k in want)
    said = {(r.k, r.n): r.distinct_n for r in distinct.collect()}
    told = {r.k: (r.vocabulary_size, r.type_token_ratio) for r in vocab.collect()}
    for k in {r[0] for r in rows}:
        grams = {n: [g for r in rows if r[0] == k for g in _grams(r[3], n)] for n in (1, 2, 3)}
        assert all(math.isclose(said[k, n], len(set(g)) / len(g) if g else 0.0) for n, g in grams.items())
        one = grams[1]
        assert told[k][0] == len(set(one)) and math.isclose(told[k][1], len(set(one)) / len(one) if one else 0.0)


def test_verdict_strict(spark):
    from promptlens.operators.evaluate import verdict
    df = spark.createDataFrame([(0.8,), (0.81,), (0.6,)], "x double")
    got = [r[0] for r in df.select(verdict(F.col("x"))).collect()]
    assert got == ["middle", "high", "low"]


def test_population_std(spark):
    from promptlens.operators.vectors import embedding_stats
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "embedding array<double>")
    r = embedding_stats(df).first()
    assert math.isclose(r.std_value, 1.247219128924647, rel_tol=1e-9)


def test_duplicates_count_nulls(spark):
    from promptlens.operators.profile import profile_distinct
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), (None, None)], "prompt string, output string")
    r = profile_distinct(df).first()
    assert (r.unique_prompts, r.duplicate_prompts) == (2, 2)


def test_validate_requests_bounds(spark):
    from promptlens.operators.limits import validate_requests
    df = spark.createDataFrame([(1, 1024, "x" * 8192, 1), (2, 1024, "x" * 8193, 1), (3, 1024, "   ", 1),
                                (4, 3, "ok", 101)], "id int, dims int, text string, batch_size int")
    r = {x.id: x.reasons for x in validate_requests(df).collect()}
    assert r == {1: "", 2: "text too long", 3: "empty text", 4: "bad dimensions,bad batch size"}


def test_rouge_l_hand_case(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat lay on a mat"), (2, "", "x")],
                               "k int, text1 string, text2 string")
    r = {x.k: x.rouge_l for x in TS.rouge_l_pairs(df, "k").collect()}
    p, rc = 4 / 5, 4 / 6
    assert abs(r[1] - 2 * p * rc / (p + rc + 1e-8)) < 1e-12
    assert r[2] is None
