"""Evaluation of generated prompts: text metrics, summaries, verdicts and the
whole test-set job (A-18..A-21, A-26, E-01, E-03, P-24).

Everything is a long table (metric, value) with one summary at the end, so the
values are read once and counted once whatever the number of metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens.functions.frames import grouped_summary, written
from promptlens.operators import textsim as TS
from promptlens.operators.embed import EmbeddingProvider
from promptlens.operators.generate import evaluate_generated, generate_prompts
from promptlens.operators.respond import ResponseLedger, TextProvider

TEXT_METRICS = ("bleu", "rouge_1", "rouge_2", "rouge_l", "jaccard", "word_overlap")
DIVERSITY_METRICS = ("vocabulary_size", "type_token_ratio", "avg_pairwise_similarity",
                     "distinct_1grams", "distinct_2grams", "distinct_3grams")
#: Metrics that a report gives a verdict on.
JUDGED = ("embedding_similarity", "diversity_distinct_1grams")


def text_metrics(pairs: DataFrame, keys: list[str], t1: str = "text1", t2: str = "text2") -> DataFrame:
    """keys and the ``TEXT_METRICS`` of each pair of texts."""
    told = TS.jaccard_pairs(pairs, keys, t1, t2)
    for part in (TS.bleu_pairs, TS.rouge_pairs, TS.rouge_l_pairs):
        told = told.join(part(pairs, keys, t1, t2), keys)
    return told.select(*keys, *TEXT_METRICS)


def long(df: DataFrame, prefix: str, columns) -> DataFrame:
    """(metric, value): a row per row and column."""
    stack = "stack(%d, %s) as (metric, value)" % (len(columns), ", ".join(f"'{prefix}{c}', cast({c} as double)" for c in columns))
    return df.selectExpr(stack)


def summary(rows: DataFrame) -> DataFrame:
    """metric, n, mean, std (population), min, max and exact median; rows
    without a value do not count."""
    return grouped_summary(rows, "value", ["metric"])


def verdict(mean: Column) -> Column:
    """Strictly above 0.8 high, above 0.6 middle, else low."""
    return F.when(mean > 0.8, "high").when(mean > 0.6, "middle").otherwise("low")


def report(told: DataFrame) -> DataFrame:
    """A summary with the verdict on each of ``JUDGED``, null for the others."""
    return told.withColumn("verdict", F.when(F.col("metric").isin(*JUDGED), verdict(F.col("mean"))))


def effectiveness(evals: DataFrame, model: str = "model") -> DataFrame:
    """Per model: how many prompts it answered, how many failed, and the means
    over those that it answered (null if none)."""
    ok = F.col("success")
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    return evals.groupBy(model).agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("errors"), mean("similarity").alias("cosine_similarity"),
        mean("prompt_words").alias("prompt_length"), mean("response_words").alias("response_length"))


def evaluate_test_set(test: DataFrame, corpus: DataFrame, n_samples: int | None = None, n_candidates: int = 1,
                      key: str = "original_index", exact: bool = False, text_provider: TextProvider | None = None,
                      provider: EmbeddingProvider | None = None, ledger: ResponseLedger | None = None) -> DataFrame:
    """Evaluate the prompts generated for ``test`` (key, prompt, embedding).

    ``n_candidates`` prompts are generated for each vector (all rows, or the
    ``n_samples`` with the smallest keys); each is compared to the row's own
    prompt, and what it yields to the row's vector. Sets of several candidates
    are measured for diversity. Returns :func:`summary`."""
    if n_samples is not None:
        test = test.orderBy(key).limit(n_samples)
    made = written(generate_prompts(test, corpus, n=n_candidates, target_key=key, corpus_key=key, exact=exact), "generated")
    evals = written(evaluate_generated(made, corpus, test, target_key=key, corpus_key=key, text_provider=text_provider,
                                       provider=provider, ledger=ledger), "evaluated")
    reference = test.select(F.col(key).cast("long").alias("target_id"), F.col("prompt").alias("text2"))
    pairs = made.where("success").select("target_id", "slot", F.col("prompt").alias("text1")).join(reference, "target_id")
    rows = (long(evals.where("success"), "", ["similarity"]).withColumn("metric", F.lit("embedding_similarity"))
            .union(long(made.where("success").select(TS.T.word_count("prompt").alias("prompt_length")), "", ["prompt_length"]))
            .union(long(text_metrics(written(pairs, "pairs"), ["target_id", "slot"]), "text_", TEXT_METRICS)))
    if n_candidates > 1:
        rows = rows.union(long(TS.diversity(made.where("success"), "target_id", "slot"), "diversity_", DIVERSITY_METRICS))
    return summary(rows)
