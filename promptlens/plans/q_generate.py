"""Generation and evaluation queries (V-06..V-13, R-01, R-09, W-04, P-23,
P-24, A-15, A-18, A-19, A-26, E-01, E-03, F-04, T-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlens.functions.frames import grouped_summary
from promptlens.operators import evaluate as EV
from promptlens.operators import generate as G
from promptlens.operators import textsim as TS
from promptlens.operators.incremental import similarity_summary
from promptlens.operators.respond import EchoProvider
from promptlens.plans import sqlfrag as S
from promptlens.plans import views as V
from promptlens.plans.q_textsim import (
    CAND_SQL, DISTINCT_SQL, DIV_METRIC_CTES, DIV_METRIC_ROWS, GEN_SQL, N_CANDIDATES, SUMMARY_SQL, TEXT_METRIC_CTES,
    TEXT_METRIC_ROWS, candidates)
from promptlens.plans.q_vectors import ann_ctes
from promptlens.plans.registry import register

GATE = 0.4  # below the service's 0.7 so both outcomes occur on the test tables


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


def gen1(spark, d):
    from promptlens.plans.stage import staged
    return staged(spark, d, "gen1",
                  lambda: G.generate_prompts(V.emb(spark, d), V.corpus(spark, d), n=1, exact=True))


_GEN1 = f"""gen1 AS (
  SELECT target_id, rank AS slot, vec_id, prompt, sim AS similarity, true AS success, NULL AS error FROM (
    SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(sim, 9) DESC, vec_id) AS rank
    FROM (SELECT a.vec_id AS target_id, b.original_index AS vec_id, b.prompt,
                 {S.cosine('a.embedding', 'b.embedding')} AS sim
          FROM emb a JOIN corpus b ON a.vec_id <> b.original_index) s) r
  WHERE rank = 1)"""

_EVAL = f"""ev AS (
  SELECT g.target_id, g.slot, g.prompt,
         CASE WHEN c.output IS NOT NULL THEN {S.cosine('t.embedding', 'c.embedding')} ELSE 0.0 END AS similarity,
         {S.word_count('g.prompt')}::BIGINT AS prompt_words,
         (CASE WHEN c.output IS NOT NULL THEN {S.word_count('c.output')} ELSE 0 END)::BIGINT AS response_words,
         c.output IS NOT NULL AS success,
         CASE WHEN c.output IS NULL THEN 'no response' END AS error
  FROM gen1 g JOIN corpus c ON g.vec_id = c.original_index JOIN emb t ON t.vec_id = g.target_id)"""

_GV = ["corpus"]


@register("generate_prompts", V.oracle("""
SELECT target_id, slot, vec_id, prompt, round(similarity, 6) AS similarity, success FROM gen1""",
                                       _GV, [_GEN1]))
def q_generate_prompts(spark, d):
    return _r6(gen1(spark, d).drop("error"), ["similarity"])


_GEN_NEAR = """near1 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(similarity, 9) DESC, vec_id) AS slot FROM scored)
  WHERE slot <= 2)"""


@register("generate_prompts_approx", V.oracle("""
SELECT e.vec_id AS target_id, n.slot, n.vec_id, c.prompt, round(n.similarity, 6) AS similarity, c.prompt IS NOT NULL AS success
FROM emb e LEFT JOIN near1 n ON n.target_id = e.vec_id LEFT JOIN corpus c ON c.original_index = n.vec_id""",
                                              _GV, [ann_ctes("corpus", "original_index"), _GEN_NEAR]))
def q_generate_prompts_approx(spark, d):
    """V-06 by the default search, a quarter of the cell tree."""
    g = G.generate_prompts(V.emb(spark, d), V.corpus(spark, d), n=2)
    return _r6(g.drop("error"), ["similarity"])


@register("prompt_quality", V.oracle(f"""
SELECT g.target_id, g.slot, round({S.cosine('t.embedding', 'c.embedding')}, 6) AS similarity,
       {S.word_count('g.prompt')}::BIGINT AS prompt_words, round({S.norm('t.embedding')}, 6) AS target_norm,
       round({S.norm('c.embedding')}, 6) AS generated_norm, g.success
FROM gen1 g JOIN corpus c ON g.vec_id = c.original_index JOIN emb t ON t.vec_id = g.target_id""", _GV, [_GEN1]))
def q_prompt_quality(spark, d):
    r = G.prompt_quality(gen1(spark, d), V.corpus(spark, d), V.emb(spark, d))
    return _r6(r, ["similarity", "target_norm", "generated_norm"])


def evals(spark, d):
    return G.evaluate_generated(gen1(spark, d), V.corpus(spark, d), V.emb(spark, d))


@register("evaluate_generated", V.oracle("""
SELECT target_id, slot, prompt, round(similarity, 6) AS similarity, prompt_words, response_words, success, error
FROM ev""", _GV, [_GEN1, _EVAL]))
def q_evaluate_generated(spark, d):
    return _r6(evals(spark, d), ["similarity"])


@register("similarity_summary", V.oracle("""
SELECT round(coalesce(avg(similarity), 0.0), 6) AS avg_similarity,
       round(coalesce(max(similarity), 0.0), 6) AS max_similarity,
       round(coalesce(min(similarity), 0.0), 6) AS min_similarity
FROM ev WHERE success""", _GV, [_GEN1, _EVAL]))
def q_similarity_summary(spark, d):
    return _r6(similarity_summary(evals(spark, d)), ["avg_similarity", "max_similarity", "min_similarity"])


@register("refine_gate", V.oracle(f"""
SELECT target_id, round(similarity, 6) AS similarity FROM ev WHERE success AND similarity > {GATE}""",
                                  _GV, [_GEN1, _EVAL]))
def q_refine_gate(spark, d):
    e = evals(spark, d)
    return _r6(e.where(F.col("success") & (F.col("similarity") > GATE)).select("target_id", "similarity"),
               ["similarity"])


def eval_similarity(e):
    told = grouped_summary(e.where(F.col("success")), "similarity")
    return told.groupBy().agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"),
                              *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("mean", "std", "min", "max", "median")])


@register("eval_similarity", V.oracle("""
SELECT count(*) AS n, round(coalesce(avg(similarity), 0.0), 6) AS mean,
       round(coalesce(stddev_pop(similarity), 0.0), 6) AS std, round(coalesce(min(similarity), 0.0), 6) AS min,
       round(coalesce(max(similarity), 0.0), 6) AS max, round(coalesce(median(similarity), 0.0), 6) AS median
FROM ev WHERE success""", _GV, [_GEN1, _EVAL]))
def q_eval_similarity(spark, d):
    return _r6(eval_similarity(evals(spark, d)), ["mean", "std", "min", "max", "median"])


@register("eval_prompt_length", V.oracle("""
SELECT round(avg(prompt_words), 6) AS mean, round(stddev_pop(prompt_words), 6) AS std,
       round(median(prompt_words), 6) AS median FROM ev""", _GV, [_GEN1, _EVAL]))
def q_eval_prompt_length(spark, d):
    told = grouped_summary(evals(spark, d), "prompt_words")
    return _r6(told.groupBy().agg(*[F.max(c).alias(c) for c in ("mean", "std", "median")]), ["mean", "std", "median"])


_TV = S.hash_embed_cte("tvs", "corpus", "original_index", "output")
_CVS = S.hash_embed_cte("cvs", "cand_k", "cid", "prompt")
_CAND_K = "cand_k AS (SELECT target_id * 100 + slot AS cid, target_id, slot, prompt FROM candidates)"
_SCORED = """scored AS (
  SELECT k.target_id, k.slot, k.prompt,
         CASE WHEN k.target_id IN (SELECT original_index FROM tvs) THEN coalesce((
           SELECT sum(c.value * t.value) FROM cvs c JOIN tvs t ON c.bucket = t.bucket
           WHERE c.cid = k.cid AND t.original_index = k.target_id), 0.0) ELSE 0.0 END AS score
  FROM cand_k k)"""
_SC = [CAND_SQL, _CAND_K, _TV, _CVS, _SCORED]


def _echoed(spark, d):
    """Best candidates evaluated by another text model, the one that says the
    prompt itself; its answers and the targets are hashed words."""
    c = candidates(spark, d).where(F.col("slot") == 1)
    made = c.select("target_id", "slot", F.lit(None).cast("long").alias("vec_id"), "prompt",
                    F.col("prompt").isNotNull().alias("success"), F.lit(None).cast("string").alias("error"))
    tv = tvecs(spark, d).select(F.col("target_id").alias("vec_id"), F.col("target_vec").alias("embedding"))
    return G.evaluate_generated(made, V.corpus(spark, d), tv, text_provider=EchoProvider())


@register("effectiveness", V.oracle(f"""
SELECT model, count_if(success) AS n, count_if(NOT success) AS errors,
       round(avg(similarity) FILTER (success), 6) AS cosine_similarity,
       round(avg(prompt_words) FILTER (success), 6) AS prompt_length, round(avg(response_words) FILTER (success), 6) AS response_length
FROM (SELECT 'stored' AS model, similarity, prompt_words, response_words, success FROM ev
      UNION ALL SELECT 'echo', score, {S.word_count('prompt')}, {S.word_count('prompt')}, len({S.words('prompt')}) > 0
      FROM scored WHERE slot = 1)
GROUP BY model""", _GV, [_GEN1, _EVAL, *_SC]))
def q_effectiveness(spark, d):
    """A-26: two text models, with the prompts that each could not answer."""
    both = evals(spark, d).withColumn("model", F.lit("stored")).unionByName(_echoed(spark, d).withColumn("model", F.lit("echo")))
    return _r6(EV.effectiveness(both), ["cosine_similarity", "prompt_length", "response_length"])


@register("verdicts", V.oracle("""
SELECT e.target_id, CASE WHEN similarity > 0.8 THEN 'high' WHEN similarity > 0.6 THEN 'middle' ELSE 'low' END AS similarity_verdict,
       CASE WHEN distinct_n > 0.8 THEN 'high' WHEN distinct_n > 0.6 THEN 'middle' WHEN distinct_n IS NOT NULL THEN 'low' END AS diversity_verdict
FROM ev e LEFT JOIN dn ON dn.target_id = e.target_id AND dn.n = 1""", _GV, [_GEN1, _EVAL, CAND_SQL, DISTINCT_SQL]))
def q_verdicts(spark, d):
    """P-24: of each target's similarity and of its candidates' distinct words."""
    div = TS.distinct_ngrams(candidates(spark, d), "target_id", ns=(1,)).select("target_id", "distinct_n")
    e = evals(spark, d).join(div, "target_id", "left")
    return e.select("target_id", EV.verdict(F.col("similarity")).alias("similarity_verdict"),
                    F.when(F.col("distinct_n").isNotNull(), EV.verdict(F.col("distinct_n"))).alias("diversity_verdict"))


def _variant_ctes():
    styles = "[" + ", ".join(f"'{x}'" for x in G.VARIANT_STYLES) + "]"
    return [_GEN1, _EVAL, S.hash_embed_cte("tvs", "corpus", "original_index", "output"),
            f"""vk AS (
  SELECT e.target_id * 10 + v AS vid, e.target_id, v AS variant, {styles}[v % 5 + 1] AS style,
         'Make it ' || {styles}[v % 5 + 1] || ': ' || coalesce(e.prompt, '') AS vp
  FROM ev e, range(0, 3) r(v) WHERE e.success AND e.similarity > {GATE})""",
            S.hash_embed_cte("vvs", "vk", "vid", "vp"),
            """vscore AS (
  SELECT k.target_id, k.variant, k.style, k.vp, coalesce((
    SELECT sum(a.value * t.value) FROM vvs a JOIN tvs t ON a.bucket = t.bucket
    WHERE a.vid = k.vid AND t.original_index = k.target_id), 0.0) AS score
  FROM vk k)""",
            """vbest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, variant) AS rank
                 FROM vscore) WHERE rank = 1)"""]


@register("variant_rank", V.oracle("""
SELECT target_id, variant::INT AS variant, vp AS variant_prompt, round(score, 6) AS score,
       row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, variant) AS rank
FROM vscore""", _GV, _variant_ctes()))
def q_variant_rank(spark, d):
    """T-01: variants of each gated prompt ranked by score (missing -> 0)."""
    from pyspark.sql import Window
    e = evals(spark, d).where(F.col("success") & (F.col("similarity") > GATE))
    v = G.diverse_variants(e.select("target_id", "prompt"), 3)
    tv = G.target_vectors(V.corpus(spark, d).where(F.col("output").isNotNull()), "original_index", "output")
    s = G.score_prompts(v.select("target_id", "variant", "variant_prompt"), tv, "variant_prompt")
    w = Window.partitionBy("target_id").orderBy(F.desc(F.round(F.coalesce("score", F.lit(0.0)), 9)), "variant")
    return _r6(s.withColumn("rank", F.row_number().over(w).cast("long")), ["score"])


_STYLES = "[" + ", ".join(f"'{x}'" for x in G.VARIANT_STYLES) + "]"


@register("diverse_variants", V.oracle(f"""
SELECT target_id, v AS variant, {_STYLES}[v % 5 + 1] AS style, round((0.5 + v * 0.3)::DOUBLE, 6) AS temperature,
       'Make it ' || {_STYLES}[v % 5 + 1] || ': ' || coalesce(prompt, '') AS variant_prompt
FROM gen1, range(0, 5) r(v)""", _GV, [_GEN1]))
def q_diverse_variants(spark, d):
    v = G.diverse_variants(gen1(spark, d).select("target_id", "prompt"), 5)
    return _r6(v.select("target_id", F.col("variant").cast("long").alias("variant"), "style",
                        "temperature", "variant_prompt"), ["temperature"])


# ----------------------------------------------------------------- scored candidates
def tvecs(spark, d):
    from promptlens.plans.stage import staged
    return staged(spark, d, "tvecs", lambda: G.target_vectors(
        V.corpus(spark, d).where(F.col("output").isNotNull()), "original_index", "output"))


def candidate_pool(spark, d):
    from promptlens.plans.stage import staged

    def build():
        c = candidates(spark, d).select("target_id", "slot", "prompt")
        return G.score_prompts(c, tvecs(spark, d))
    return staged(spark, d, "candidate_pool", build)


@register("candidate_pool", V.oracle("""
SELECT target_id, slot, prompt, round(score, 6) AS score FROM scored""", _GV, _SC))
def q_candidate_pool(spark, d):
    return _r6(candidate_pool(spark, d), ["score"])


@register("score_prompts", V.oracle("""
SELECT target_id, slot, round(score, 6) AS score FROM scored""", _GV, _SC))
def q_score_prompts(spark, d):
    c = candidates(spark, d).select("target_id", "slot", "prompt")
    return _r6(G.score_prompts(c, tvecs(spark, d)).select("target_id", "slot", "score"), ["score"])


_BEST = """best AS (
  SELECT target_id, slot, prompt, score FROM (
    SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, slot) AS rn FROM scored) WHERE rn = 1)"""


@register("best_candidate", V.oracle("""
SELECT target_id, slot, prompt, round(score, 6) AS score FROM best""", _GV, _SC + [_BEST]))
def q_best_candidate(spark, d):
    return _r6(G.best_per_target(candidate_pool(spark, d)), ["score"])


@register("simple_refine", V.oracle("""
SELECT target_id, prompt, round(score, 6) AS score, 'simple' AS strategy FROM best""", _GV, _SC + [_BEST]))
def q_simple_refine(spark, d):
    b = G.best_per_target(candidate_pool(spark, d))
    return _r6(b.select("target_id", "prompt", "score", F.lit("simple").alias("strategy")), ["score"])


@register("generate_refined", V.oracle(f"""
SELECT e.target_id, e.prompt, round(e.similarity, 6) AS similarity, e.success, b.vp AS best_variant,
       round(b.score, 6) AS best_variant_score, b.style AS best_style, b.vp IS NOT NULL AS refined
FROM ev e LEFT JOIN vbest b ON e.target_id = b.target_id""", _GV, _variant_ctes()))
def q_generate_refined(spark, d):
    return _r6(G.generate_with_refinement(evals(spark, d), tvecs(spark, d), GATE, 3),
               ["similarity", "best_variant_score"])


# ----------------------------------------------------------------- text / file
_PFT_CTES = [
    "bq AS (SELECT item_id, text FROM benchmark)",
    S.hash_embed_cte("qv", "bq", "item_id", "text"),
    "cc AS (SELECT original_index, prompt, output FROM corpus WHERE output IS NOT NULL)",
    S.hash_embed_cte("cvx", "cc", "original_index", "output"),
    """sims AS (
  SELECT q.item_id, c.original_index AS vec_id, sum(q.value * c.value) AS sim
  FROM qv q JOIN cvx c ON q.bucket = c.bucket GROUP BY 1, 2)""",
    """best AS (
  SELECT * FROM (
    SELECT b.item_id, c.original_index AS vec_id, c.prompt, coalesce(s.sim, 0.0) AS sim,
           row_number() OVER (PARTITION BY b.item_id ORDER BY round(coalesce(s.sim, 0.0), 9) DESC,
                              c.original_index) AS rn
    FROM bq b CROSS JOIN cc c
    LEFT JOIN sims s ON s.item_id = b.item_id AND s.vec_id = c.original_index) WHERE rn = 1)"""]


@register("prompt_from_text", V.oracle(f"""
SELECT b.item_id AS target_id, length(b.text)::BIGINT AS text_length,
       CASE WHEN len({S.words('b.text')}) > 0 THEN 64::BIGINT END AS embedding_dimension,
       x.prompt, round(x.sim, 6) AS similarity, x.prompt IS NOT NULL AS success,
       CASE WHEN len({S.words('b.text')}) = 0 THEN 'empty text' END AS error
FROM bq b LEFT JOIN best x ON x.item_id = b.item_id""", _GV, _PFT_CTES))
def q_prompt_from_text(spark, d):
    b = V.table(spark, d, "benchmark").select(F.col("item_id"), "text")
    c = V.corpus(spark, d).where(F.col("output").isNotNull())
    return _r6(G.prompt_from_text(b, c, "item_id", exact=True), ["similarity"])


def _raw_file(spark, d):
    docs = V.table(spark, d, "documents")
    e = V.table(spark, d, "embeddings")
    j = docs.join(e, docs.doc_id == e.vec_id, "left")
    js = F.when(F.col("embedding").isNotNull(),
                F.to_json(F.transform("embedding", lambda x: x.cast("double"))))
    return j.select("doc_id", "lang", F.coalesce(js, F.concat(F.lit("["), F.col("lang"))).alias("embedding_json"))


@register("process_file", V.oracle(f"""
SELECT d.doc_id, d.lang, r.prompt, round(r.sim, 6) AS similarity, r.prompt IS NOT NULL AS success,
       CASE WHEN e.embedding IS NULL THEN 'invalid embedding' END AS error
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
LEFT JOIN (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(sim, 9) DESC, vec_id) AS rank
    FROM (SELECT a.vec_id AS target_id, b.original_index AS vec_id, b.prompt,
                 {S.cosine('a.embedding', 'b.embedding')} AS sim
          FROM emb a JOIN corpus b ON true) s) WHERE rank = 1) r ON r.target_id = d.doc_id""", _GV))
def q_process_file(spark, d):
    r = G.process_embeddings(_raw_file(spark, d), V.corpus(spark, d), "doc_id", "embedding_json", 64, exact=True)
    return _r6(r, ["similarity"])


# ----------------------------------------------------------------- E-01, E-03
def _test_set_sql(select: str) -> str:
    """All candidates of every prompt-owning vector against its prompt."""
    evaluated = f"""tev AS (
  SELECT k.target_id, k.slot, k.prompt AS text1, p.prompt AS text2,
         CASE WHEN c.output IS NOT NULL THEN {S.cosine('p.embedding', 'c.embedding')} END AS similarity,
         {S.word_count('k.prompt')} AS words
  FROM cand_ids k JOIN corpus p ON p.original_index = k.target_id JOIN corpus c ON c.original_index = k.vec_id),
gen AS (SELECT target_id * 100 + slot AS target_id, text1, text2 FROM tev)"""
    ids = CAND_SQL.replace("candidates AS", "cand_ids AS").replace("rank AS slot, prompt", "rank AS slot, vec_id, prompt")
    rows = ("SELECT 'embedding_similarity' AS metric, similarity AS value FROM tev "
            "UNION ALL SELECT 'prompt_length', words::DOUBLE FROM tev UNION ALL " + TEXT_METRIC_ROWS + " UNION ALL " + DIV_METRIC_ROWS)
    ctes = [ids, evaluated, *[c for c in TEXT_METRIC_CTES if c not in (CAND_SQL, GEN_SQL)], *DIV_METRIC_CTES]
    return V.oracle(select.format(summary=SUMMARY_SQL.format(rows=rows)), _GV, ctes)


def evaluated_test_set(spark, d):
    c = V.corpus(spark, d)
    told = EV.evaluate_test_set(c.select("original_index", "prompt", "embedding"), c, n_candidates=N_CANDIDATES, exact=True)
    return _r6(told.select("metric", "mean", "std", "median"), ["mean", "std", "median"])


@register("evaluate_test_set", _test_set_sql("{summary}"))
def q_evaluate_test_set(spark, d):
    return evaluated_test_set(spark, d)


@register("eval_report", _test_set_sql("""
SELECT metric, mean, std, median, CASE WHEN metric IN ('embedding_similarity', 'diversity_distinct_1grams') THEN
  CASE WHEN mean > 0.8 THEN 'high' WHEN mean > 0.6 THEN 'middle' ELSE 'low' END END AS verdict
FROM ({summary})"""))
def q_eval_report(spark, d):
    """E-03: the E-01 metric table with verdicts."""
    return EV.report(evaluated_test_set(spark, d))
