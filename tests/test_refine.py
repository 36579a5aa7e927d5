"""Refinement: both scorers agree, plans are projections, every setting
reaches its strategy, streaks, text providers and their ledger."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from promptlens.operators import embed as OE
from promptlens.operators import generate as G
from promptlens.operators import refine as R
from promptlens.operators import respond as RS
from promptlens.session import scratch_path

POOL = "target_id long, slot int, prompt string, score double"


def words(n, k):
    return " ".join(f"w{(n * 7 + i * k) % 23}" for i in range(4 + (n + k) % 9))


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(t, s, words(t, s), 0.0) for t in range(12) for s in (1, 2, 3)] + [(50, 1, "create a plan", 0.0), (51, 1, None, 0.0), (52, 1, "  ", 0.0)]
    raw = spark.createDataFrame(rows, POOL).drop("score")
    tv = targets(spark)
    return G.score_prompts(raw, tv).select("target_id", "slot", "prompt", "score")


def targets(spark):
    texts = spark.createDataFrame([(t, words(t + 3, 2)) for t in range(12)] + [(51, "w1 w2"), (52, "w3")], "target_id long, text string")
    return G.target_vectors(texts, "target_id", "text")


def told(df):
    return sorted((r["target_id"], r["prompt"], round(r["score"], 9), r["rounds"]) for r in df.collect())


def test_hash_score_is_the_providers_cosine(spark, pool):
    tv = targets(spark)
    rows = pool.select("target_id", "slot", "prompt")
    mine = {(r["target_id"], r["slot"]): r["score"] for r in G.score_prompts(rows, tv).collect()}
    other = {(r["target_id"], r["slot"]): r["score"] for r in G.score_prompts(rows, tv, provider=OE.HashProvider()).collect()}
    assert mine.keys() == other.keys() and max(abs(mine[k] - other[k]) for k in mine) < 1e-12
    assert mine[50, 1] == 0.0 and mine[51, 1] == 0.0 and mine[52, 1] == 0.0


@pytest.mark.parametrize("strategy", R.STRATEGIES)
def test_a_provider_gives_what_the_expression_gives(spark, pool, strategy):
    config = R.RefineConfig(strategy, iterations=3, population=4, mutation_rate=0.4)
    tv = targets(spark)
    plain = told(R.refine(config, pool.where("prompt is not null"), tv))
    assert plain == told(R.refine(config, pool.where("prompt is not null"), tv, provider=OE.HashProvider()))
    if strategy in ("hill_climbing", "beam_search"):
        assert plain == told(R.refine(config, pool.where("prompt is not null"), tv, text_provider=RS.EchoProvider()))


@pytest.mark.parametrize("strategy", R.STRATEGIES[1:])
def test_search_plans_are_projections(spark, strategy):
    from promptlens.plans.q_generate import candidate_pool, tvecs
    df = R.refine(R.RefineConfig(strategy, 10), candidate_pool(spark, SF_SMALL), tvecs(spark, SF_SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "MapInPandas", "MapInArrow", "Window", "CartesianProduct", "NestedLoop"):
        assert node not in plan, node
    assert plan.count("Scan parquet") <= 2  # the candidates and the vectors, whatever the rounds


def test_settings_reach_the_strategies(spark, pool):
    tv, some = targets(spark), pool.where("target_id < 12")
    base = R.RefineConfig("evolutionary", iterations=1, population=7, mutation_rate=0.5)
    start = R._pooled(some).select("target_id", F.struct("pool", F.lit("").alias("p"), F.lit(0.0).alias("s")).alias("state"))
    sizes = R.run_search(R.evolve_search(base), start, tv, 1).select(F.size("state.pool")).distinct().collect()
    assert [r[0] for r in sizes] == [7]
    beam = replace(base, strategy="beam_search", beam_width=2)
    assert {r["count"] for r in R.beam_step(some, tv, beam).groupBy("target_id").count().collect()} == {2}
    climbed = R.refine(replace(base, strategy="hill_climbing", iterations=9, patience=1, mutation_rate=0.0), some, tv)
    assert {r["rounds"] for r in climbed.collect()} == {1}  # nothing changes, so the first round is the last
    assert {r["rounds"] for r in R.refine(replace(base, strategy="simulated_annealing", iterations=0), some, tv).collect()} == {0}
    other = told(R.refine(replace(base, seed=7), some, tv))
    assert other != told(R.refine(base, some, tv))
    for bad in ({"strategy": "nope"}, {"population": 0}, {"mutation_rate": 1.5}, {"cooling": 0.0}, {"iterations": -1}):
        with pytest.raises(ValueError):
            replace(base, **bad)


def test_streaks_and_stop_rounds(spark):
    scores = {1: [0.1, 0.1, 0.3, 0.3, 0.2, 0.3], 2: [0.5, 0.6, 0.7], 3: [0.2, 0.2, 0.2, 0.2]}
    df = spark.createDataFrame([(t, i, s) for t, v in scores.items() for i, s in enumerate(v)], "target_id long, iteration int, score double")
    got = {}
    for r in R.running_best(df, patience=3).orderBy("target_id", "iteration").collect():
        got.setdefault(r["target_id"], []).append((r["best_so_far"], r["streak"], r["stop_round"]))
    assert [x[1] for x in got[1]] == [0, 1, 0, 1, 2, 3] and got[1][0][2] == 5
    assert [x[1] for x in got[2]] == [0, 0, 0] and got[2][0][2] is None
    assert [x[2] for x in got[3]] == [3] * 4 and got[1][4][0] == 0.3


# -- text providers ---------------------------------------------------------------

def picky(calls, bad):
    """A provider that fails on some prompts, and on a whole batch that holds
    one. A class made here goes to the workers by value."""
    class Picky(RS.EchoProvider):
        model = "picky"

        def respond(self, prompts):
            if len(prompts) > 1 and bad & set(prompts):
                raise RuntimeError("batch refused")
            calls.add(len(prompts))
            return [(None, 0, "refused") if p in bad else (p.upper(), 1, None) for p in prompts]

    return Picky()


def test_each_prompt_is_asked_once_and_failures_again(spark):
    ledger = RS.ResponseLedger(spark, scratch_path(spark, "ledger"))
    rows = [(i, f"p{i % 5}") for i in range(40)] + [(90, None), (91, "  ")]
    df = spark.createDataFrame(rows, "id long, prompt string")

    def ask(bad):
        calls = spark.sparkContext.accumulator(0)
        got = {r["id"]: r for r in RS.respond(df, "prompt", picky(calls, bad), ledger).collect()}
        return got, calls.value

    got, calls = ask({"p3"})
    assert calls == 5 and len(got) == 42 and got[0]["response"] == "P0" and got[0]["success"]
    assert (got[3]["success"], got[3]["error"], got[3]["attempt"]) == (False, "refused", 1)
    assert (got[90]["success"], got[91]["error"]) == (False, "empty prompt")
    got, calls = ask({"p3"})  # only the failed one is asked again
    assert calls == 1 and got[3]["attempt"] == 2 and got[8]["attempt"] == 2
    got, calls = ask(set())
    assert calls == 1 and got[3]["success"] and got[3]["response"] == "P3" and got[3]["attempt"] == 3
    assert ask({"p1"})[1] == 0  # all settled
    again = RS.ResponseLedger(spark, scratch_path(spark, "ledger"))
    for n in (1, 2, 3):
        assert {r["attempt"] for r in RS.respond(df.where("id = 3"), "prompt", picky(spark.sparkContext.accumulator(0), {"p3"}), again).collect()} == {n}
    calls = spark.sparkContext.accumulator(0)
    assert not RS.respond(df.where("id = 3"), "prompt", picky(calls, {"p3"}), again).first()["success"] and calls.value == 0


def test_evaluation_and_refining_by_a_text_provider(spark):
    corpus = spark.createDataFrame([(i, f"make w{i} now", f"MAKE w{i} NOW") for i in range(6)], "original_index long, prompt string, output string")
    embedded = G.embed_corpus(corpus)
    gen = corpus.select(F.col("original_index").alias("target_id"), F.lit(1).alias("slot"), F.col("original_index").alias("vec_id"), "prompt",
                        F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    targets = embedded.select(F.col("original_index").alias("vec_id"), "embedding")
    calls = spark.sparkContext.accumulator(0)
    provider, ledger = picky(calls, {"make w2 now"}), RS.ResponseLedger(spark, scratch_path(spark, "ledger"))
    got = {r["target_id"]: r for r in G.evaluate_generated(gen, corpus, targets, text_provider=provider, ledger=ledger).collect()}
    assert len(got) == 6 and abs(got[0]["similarity"] - 1) < 1e-12 and got[0]["response_words"] == 3
    assert (got[2]["success"], got[2]["similarity"], got[2]["error"]) == (False, 0.0, "refused")
    tv = G.target_vectors(corpus, "original_index", "output")
    scored = {r["target_id"]: r["score"] for r in G.score_prompts(gen.select("target_id", "slot", "prompt"), tv, text_provider=provider, ledger=ledger).collect()}
    assert abs(scored[0] - 1) < 1e-12 and scored[2] == 0.0
    evals = G.evaluate_generated(gen, corpus, targets, text_provider=RS.EchoProvider())
    best = G.generate_with_refinement(evals, tv, gate=0.5, n_variants=2, text_provider=RS.EchoProvider()).collect()
    plain = G.generate_with_refinement(evals, tv, gate=0.5, n_variants=2).collect()
    key = lambda rows: sorted((r["target_id"], r["best_variant"], round(r["best_variant_score"], 9)) for r in rows)
    assert key(best) == key(plain) and len(best) == 6


def test_candidate_pools_are_the_nearest_prompts_scored(spark):
    corpus = spark.createDataFrame([(i, f"make w{i}", f"w{i} w{i + 1}") for i in range(12)], "original_index long, prompt string, output string")
    embedded = G.embed_corpus(corpus)
    targets = embedded.select(F.col("original_index").alias("vec_id"), "embedding")
    tv = G.target_vectors(corpus, "original_index", "output")
    for exact in (True, False):
        pool = G.candidate_pool(targets, embedded, tv, n=2, exact=exact)
        assert pool.columns == ["target_id", "slot", "prompt", "score"]
        rows = pool.collect()
        assert max(r["slot"] for r in rows) <= 2 and all(r["prompt"] != f"make w{r['target_id']}" for r in rows)
    assert len(rows) and {r["target_id"] for r in G.candidate_pool(targets, embedded, tv, n=2, exact=True).collect()} == set(range(12))


def test_digits_of_a_draw_compare_as_its_number(spark):
    rows = spark.range(4000)
    for share in (0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0):
        u = R.uniform(F.col("id"), F.lit("m"))
        below = R._below(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit("m"))), share)
        assert rows.where(below != (u < share)).count() == 0


def test_a_draw_of_a_word_that_is_not_hit_is_not_made_a_number(spark):
    """Of a word that a mutation leaves alone, only digits are compared: its
    number and lists of words, rebuilt word by word, made the beam slow."""
    found = spark.range(1).select(R.mutate(F.lit("a b c d e f g h"), 0.1, 42, F.col("id"), F.lit(0)).alias("m"))
    plan = found._jdf.queryExecution().analyzed().toString()
    places = plan[plan.index("filter(sequence"):].split("lambdafunction(named_struct")[0].split("lambdafunction(struct")[0]
    assert "md5" in places and "conv(" not in places.split("namedlambdavariable()")[0]
    assert plan.count("conv(") <= 3 and "array_remove" in plan


def test_edits_keep_every_other_word(spark):
    def told(column):
        return spark.range(1).select(column.alias("x")).first()[0]

    w = F.array(*[F.lit(x) for x in "one create three four five".split()])
    assert told(R.edit_synonym(w, F.lit(1), F.lit(0.99))) == "one construct three four five".split()
    assert told(R.edit_synonym(w, F.lit(0), F.lit(0.5))) == told(w) and told(R.edit_synonym(w, F.lit(9), F.lit(0.5))) == told(w)
    assert told(R.edit_delete(w, F.lit(4))) == "one create three four".split() and told(R.edit_delete(w, F.lit(5))) == told(w)
    assert told(R.edit_delete(F.slice(w, 1, 3), F.lit(1))) == "one create three".split()
    assert told(R.edit_swap(w, F.lit(3))) == "one create three five four".split() and told(R.edit_swap(w, F.lit(4))) == told(w)
    assert told(R.edit_swap(w, F.lit(0))) == "create one three four five".split()


def test_a_score_counts_words_that_meet_in_a_bucket(spark):
    text = " ".join(f"w{i % 150}" for i in range(700)) + " W3  w3\tw3"
    target = OE.HashProvider().vector("w1 w2 w3 w5 w8").tolist()
    want = float(OE.HashProvider().vector(text) @ target)
    for dim in (64, 48):
        unit = target if dim == 64 else OE.HashProvider(48).vector("w1 w2 w3 w5 w8").tolist()
        want = float(OE.HashProvider(dim).vector(text) @ unit)
        got = spark.createDataFrame([(text, unit)], "t string, v array<double>").select(OE.hash_score(F.col("t"), F.col("v"), dim)).first()[0]
        assert abs(got - want) < 1e-12
