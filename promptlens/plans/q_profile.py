"""Profile queries (A-01..A-10, P-02..P-11, P-22) bound to the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.operators import profile as P
from promptlens.operators import profilestore as PS
from promptlens.plans import sqlfrag as S
from promptlens.plans import views as V
from promptlens.plans.registry import register
from promptlens.session import scratch_path


@register("profile_counts", V.oracle("""
SELECT count(*) AS total_samples,
       count_if(prompt IS NULL) AS null_prompts, count_if(output IS NULL) AS null_outputs,
       count_if(prompt = '') AS empty_prompts, count_if(output = '') AS empty_outputs
FROM pairs""", ["pairs"]))
def q_profile_counts(spark, d):
    return P.profile_counts(V.pairs(spark, d))


@register("profile_distinct", V.oracle("""
SELECT count(DISTINCT prompt) AS unique_prompts, count(DISTINCT output) AS unique_outputs,
       count(*) - count(DISTINCT prompt) AS duplicate_prompts,
       count(*) - count(DISTINCT output) AS duplicate_outputs
FROM pairs""", ["pairs"]))
def q_profile_distinct(spark, d):
    return P.profile_distinct(V.pairs(spark, d))


@register("profile_lengths", V.oracle(f"""
SELECT round(avg(length(prompt)), 6) AS avg_prompt_length,
       round(avg(length(output)), 6) AS avg_output_length,
       round(avg({S.word_count('prompt')}), 6) AS avg_prompt_words,
       round(avg({S.word_count('output')}), 6) AS avg_output_words,
       min(length(prompt)) AS min_prompt_length, max(length(prompt)) AS max_prompt_length,
       min(length(output)) AS min_output_length, max(length(output)) AS max_output_length
FROM pairs""", ["pairs"]))
def q_profile_lengths(spark, d):
    r = P.profile_lengths(V.pairs(spark, d))
    return r.select(*[F.round(c, 6).alias(c) if c.startswith("avg") else c for c in r.columns])


@register("text_lengths", V.oracle(f"""
SELECT original_index, length(prompt) AS prompt_chars, {S.word_count('prompt')} AS prompt_words,
       length(output) AS output_chars, {S.word_count('output')} AS output_words
FROM textcases""", ["textcases"]))
def q_text_lengths(spark, d):
    t = V.textcases(spark, d)
    return t.select("original_index",
                    T.char_len("prompt").cast("long").alias("prompt_chars"),
                    T.word_count("prompt").cast("long").alias("prompt_words"),
                    T.char_len("output").cast("long").alias("output_chars"),
                    T.word_count("output").cast("long").alias("output_words"))


@register("sentence_counts", V.oracle(f"""
SELECT original_index, {S.sentence_count('output')} AS output_sentences FROM textcases""",
                                      ["textcases"]))
def q_sentence_counts(spark, d):
    t = V.textcases(spark, d)
    return t.select("original_index", T.sentence_count("output").cast("long").alias("output_sentences"))


@register("prompt_starters", V.oracle(f"""
SELECT starter, n, first_index FROM (
  SELECT coalesce({S.lower_words('prompt')}[1], '') AS starter, count(*) AS n,
         min(original_index) AS first_index
  FROM textcases WHERE prompt IS NOT NULL GROUP BY 1)
ORDER BY n DESC, first_index LIMIT 20""", ["textcases"]))
def q_prompt_starters(spark, d):
    return P.prompt_starters(V.textcases(spark, d), 20)


@register("prompt_types", V.oracle(f"""
SELECT count_if({S.is_question('prompt')}) AS question_prompts,
       count_if({S.is_instruction('prompt')}) AS instruction_prompts,
       count_if(coalesce(contains(prompt, ':'), false)) AS context_prompts,
       count(*) - count_if({S.is_question('prompt')}) - count_if({S.is_instruction('prompt')}) AS other_prompts
FROM textcases""", ["textcases"]))
def q_prompt_types(spark, d):
    return P.prompt_types(V.textcases(spark, d))


@register("prompt_classes", V.oracle(f"""
SELECT original_index,
       CASE WHEN {S.is_question('prompt')} THEN 'question'
            WHEN {S.is_instruction('prompt')} THEN 'instruction' ELSE 'other' END AS prompt_class,
       coalesce(contains(prompt, ':'), false) AS has_context
FROM textcases""", ["textcases"]))
def q_prompt_classes(spark, d):
    t = V.textcases(spark, d)
    return t.select("original_index", T.classify_prompt("prompt").alias("prompt_class"),
                    T.has_context("prompt").alias("has_context"))


@register("output_flags", V.oracle(f"""
SELECT count_if({S.is_code('output')}) AS code_outputs,
       count_if({S.is_list('output')}) AS list_outputs,
       count_if({S.is_explanation('output')}) AS explanation_outputs
FROM textcases""", ["textcases"]))
def q_output_flags(spark, d):
    return P.output_flags(V.textcases(spark, d))


@register("sentence_stats", V.oracle(f"""
SELECT round(avg(s), 6) AS avg_sentences_per_output,
       round(median(s), 6) AS median_sentences_per_output
FROM (SELECT {S.sentence_count('output')}::DOUBLE AS s FROM pairs)""", ["pairs"]))
def q_sentence_stats(spark, d):
    r = P.sentence_stats(V.pairs(spark, d))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@register("length_histogram", V.oracle("""
SELECT (CASE WHEN mx = mn THEN 0 ELSE least(floor((v - mn) / ((mx - mn) / 50)), 49) END)::BIGINT AS bin,
       count(*) AS n
FROM (SELECT length(prompt)::DOUBLE AS v FROM pairs WHERE prompt IS NOT NULL) x,
     (SELECT min(length(prompt))::DOUBLE AS mn, max(length(prompt))::DOUBLE AS mx FROM pairs) s
GROUP BY 1""", ["pairs"]))
def q_length_histogram(spark, d):
    return P.length_histogram(V.pairs(spark, d), "prompt", 50)


@register("length_relation", V.oracle("""
SELECT count(*) AS n_pairs,
       round(corr(length(prompt)::DOUBLE, length(output)::DOUBLE), 6) AS length_corr,
       round(avg(length(prompt)), 6) AS avg_prompt_length,
       round(avg(length(output)), 6) AS avg_output_length
FROM pairs WHERE output IS NOT NULL""", ["pairs"]))
def q_length_relation(spark, d):
    r = P.length_relation(V.pairs(spark, d))
    return r.select("n_pairs", *[F.round(c, 6).alias(c) for c in r.columns if c != "n_pairs"])


@register("word_frequency", V.oracle(f"""
SELECT word, count(*) AS n FROM (SELECT unnest({S.lower_words('prompt')}) AS word FROM pairs)
GROUP BY 1 ORDER BY n DESC, word LIMIT 50""", ["pairs"]))
def q_word_frequency(spark, d):
    return P.word_frequency(V.pairs(spark, d), "prompt", 50)


STOP_SHARE = 0.2  # words of so many prompts, or more, are taken for stop words
_STOP = f"""sw AS (
  SELECT word FROM (SELECT DISTINCT original_index, unnest({S.lower_words('prompt')}) AS word FROM pairs)
  GROUP BY word HAVING count(*) >= {STOP_SHARE} * (SELECT count(*) FROM pairs))"""


@register("word_frequency_stop", V.oracle(f"""
SELECT word, count(*) AS n FROM (SELECT unnest({S.lower_words('prompt')}) AS word FROM pairs)
WHERE word NOT IN (SELECT word FROM sw) GROUP BY 1 ORDER BY n DESC, word LIMIT 50""", ["pairs"], [_STOP]))
def q_word_frequency_stop(spark, d):
    """A-10 without stop words, here the words of a fifth of all prompts."""
    p = V.pairs(spark, d)
    words = p.select("original_index", F.explode(F.array_distinct(T.lower_words("prompt"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = words.where(F.col("n") >= STOP_SHARE * p.agg(F.count(F.lit(1))).scalar())
    return P.word_frequency(p, "prompt", 50, often)


@register("length_bins", V.oracle("""
SELECT least(floor((p - min_p) / nullif(max_p - min_p, 0) * 20), 19)::BIGINT AS prompt_bin,
       least(floor((o - min_o) / nullif(max_o - min_o, 0) * 20), 19)::BIGINT AS output_bin, count(*) AS n
FROM (SELECT length(prompt)::DOUBLE AS p, length(output)::DOUBLE AS o, min(length(prompt)::DOUBLE) OVER () AS min_p,
             max(length(prompt)::DOUBLE) OVER () AS max_p, min(length(output)::DOUBLE) OVER () AS min_o, max(length(output)::DOUBLE) OVER () AS max_o
      FROM pairs WHERE output IS NOT NULL) GROUP BY 1, 2""", ["pairs"]))
def q_length_bins(spark, d):
    """A-09 in two dimensions."""
    return P.length_bins(V.pairs(spark, d), 20)


@register("profile_merged", V.oracle(f"""
SELECT count(*) AS total_samples, count_if(prompt IS NULL) AS null_prompts, count_if(output IS NULL) AS null_outputs,
       count_if(prompt = '') AS empty_prompts, count_if(output = '') AS empty_outputs,
       round(avg(length(prompt)), 6) AS avg_prompt_length, round(avg(length(output)), 6) AS avg_output_length,
       round(avg({S.word_count('prompt')}), 6) AS avg_prompt_words, round(avg({S.word_count('output')}), 6) AS avg_output_words,
       min(length(prompt))::INT AS min_prompt_length, max(length(prompt))::INT AS max_prompt_length,
       min(length(output))::INT AS min_output_length, max(length(output))::INT AS max_output_length,
       round(avg({S.sentence_count('output')}), 6) AS avg_sentences_per_output,
       count_if({S.is_question('prompt')}) AS question_prompts, count_if({S.is_instruction('prompt')}) AS instruction_prompts,
       count_if({S.is_code('output')}) AS code_outputs, count_if({S.is_list('output')}) AS list_outputs,
       count_if({S.is_explanation('output')}) AS explanation_outputs
FROM pairs""", ["pairs"]))
def q_profile_merged(spark, d):
    """A-01..A-09 from the profiles of three batches, one of them added twice."""
    p = V.pairs(spark, d)
    store = PS.ProfileStore(spark, scratch_path(spark, "profiles"))
    for batch in (0, 1, 2, 1):
        store.add(p.where(F.col("original_index") % 3 == batch), str(batch))
    r = store.report().drop("other_prompts", "unique_prompts_estimate", "unique_outputs_estimate", "median_sentences_estimate")
    return r.select(*[F.round(c, 6).alias(c) if c.startswith("avg") else c for c in r.columns])
