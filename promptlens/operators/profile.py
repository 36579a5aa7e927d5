"""Profile of a prompt/output table (counts, distincts, lengths, prompt
types, output flags, sentences, histograms, word frequency).

Input: any frame with ``original_index``, ``prompt``, ``output``. Every
function is one or two aggregations; partial (map-side) aggregation keeps
shuffles to one row per group per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.functions.frames import grouped_summary


def profile_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("prompt").isNull()).alias("null_prompts"),
        F.count_if(F.col("output").isNull()).alias("null_outputs"),
        F.count_if(F.col("prompt") == "").alias("empty_prompts"),
        F.count_if(F.col("output") == "").alias("empty_outputs"))


def profile_distinct(df: DataFrame) -> DataFrame:
    """nunique ignores null; duplicates = rows - nunique (nulls count). What is
    shuffled is a digest per distinct text of a task, and each column is an
    aggregate of its own, so no row is multiplied."""
    def unique(column: str) -> DataFrame:
        digests = df.where(F.col(column).isNotNull()).select(F.unhex(F.sha2(column, 256)).alias("d")).distinct()
        return digests.agg(F.count(F.lit(1)).alias("n"))

    n = df.agg(F.count(F.lit(1)).alias("n"))
    told = n.select("n", unique("prompt").scalar().alias("unique_prompts"), unique("output").scalar().alias("unique_outputs"))
    return told.select("unique_prompts", "unique_outputs",
                       (F.col("n") - F.col("unique_prompts")).alias("duplicate_prompts"),
                       (F.col("n") - F.col("unique_outputs")).alias("duplicate_outputs"))


def with_lengths(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        T.char_len("prompt").cast("long").alias("prompt_length"),
        T.char_len("output").cast("long").alias("output_length"),
        T.word_count("prompt").cast("long").alias("prompt_words"),
        T.word_count("output").cast("long").alias("output_words"))


def profile_lengths(df: DataFrame) -> DataFrame:
    x = with_lengths(df)
    return x.agg(
        F.avg("prompt_length").alias("avg_prompt_length"),
        F.avg("output_length").alias("avg_output_length"),
        F.avg("prompt_words").alias("avg_prompt_words"),
        F.avg("output_words").alias("avg_output_words"),
        F.min("prompt_length").alias("min_prompt_length"),
        F.max("prompt_length").alias("max_prompt_length"),
        F.min("output_length").alias("min_output_length"),
        F.max("output_length").alias("max_output_length"))


def prompt_starters(df: DataFrame, k: int = 20) -> DataFrame:
    """Top-k lower-cased first words; ties in first-seen order."""
    s = df.where(F.col("prompt").isNotNull()).select(
        T.first_word("prompt").alias("starter"), "original_index")
    g = s.groupBy("starter").agg(F.count(F.lit(1)).alias("n"),
                                 F.min("original_index").alias("first_index"))
    top = g.orderBy(F.desc("n"), F.asc("first_index")).limit(k)
    return top.select("starter", "n", "first_index")


def prompt_types(df: DataFrame) -> DataFrame:
    c = df.agg(F.count(F.lit(1)).alias("n"),
               F.count_if(T.is_question("prompt")).alias("question_prompts"),
               F.count_if(T.is_instruction("prompt")).alias("instruction_prompts"),
               F.count_if(T.has_context("prompt")).alias("context_prompts"))
    return c.select("question_prompts", "instruction_prompts", "context_prompts",
                    (F.col("n") - F.col("question_prompts") - F.col("instruction_prompts"))
                    .alias("other_prompts"))


def output_flags(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(T.is_code("output")).alias("code_outputs"),
                  F.count_if(T.is_list("output")).alias("list_outputs"),
                  F.count_if(T.is_explanation("output")).alias("explanation_outputs"))


def sentence_stats(df: DataFrame) -> DataFrame:
    """Mean and exact median of sentences per output (null outputs skipped).

    Both come from the counts of the values, see ``grouped_summary``."""
    s = df.select(T.sentence_count("output").alias("sentences"))
    told = grouped_summary(s, "sentences").select("mean", "median")
    return told.groupBy().agg(F.max("mean").alias("avg_sentences_per_output"), F.max("median").alias("median_sentences_per_output"))


def length_histogram(df: DataFrame, column: str = "prompt", bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max] of character length; last bin
    closed. min/max enter as scalar subqueries (no join)."""
    x = df.select(T.char_len(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    lo = x.select(F.min("v")).scalar()
    hi = x.select(F.max("v")).scalar()
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))).cast("long")
    return x.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def length_relation(df: DataFrame) -> DataFrame:
    x = with_lengths(df).where(F.col("output").isNotNull())
    return x.agg(F.count(F.lit(1)).alias("n_pairs"),
                 F.corr(F.col("prompt_length").cast("double"),
                        F.col("output_length").cast("double")).alias("length_corr"),
                 F.avg("prompt_length").alias("avg_prompt_length"),
                 F.avg("output_length").alias("avg_output_length"))


def length_bins(df: DataFrame, bins: int = 20) -> DataFrame:
    """Pairs with an output by equal-width bins of both lengths: prompt_bin,
    output_bin, n; the last bin of either is closed."""
    x = with_lengths(df).where(F.col("output").isNotNull()).select(
        F.col("prompt_length").cast("double").alias("p"), F.col("output_length").cast("double").alias("o"))
    ends = x.agg(*[f(c).alias(f"{side}_{c}") for c in ("p", "o") for side, f in (("lo", F.min), ("hi", F.max))])

    def placed(c: str):
        lo, hi = (ends.select(f"{side}_{c}").scalar() for side in ("lo", "hi"))
        at = F.least(F.floor((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins), F.lit(bins - 1))
        return F.coalesce(at, F.lit(0)).cast("long")

    return x.where(F.col("p").isNotNull()).select(placed("p").alias("prompt_bin"), placed("o").alias("output_bin")).groupBy("prompt_bin", "output_bin").agg(
        F.count(F.lit(1)).alias("n"))


def word_frequency(df: DataFrame, column: str = "prompt", k: int = 50, stop_words: DataFrame | None = None) -> DataFrame:
    """Most common lower-cased words, without those of ``stop_words`` (word);
    partial aggregation combines hot words map-side before the shuffle, and
    stop words leave after it, when a word is one row."""
    w = df.select(F.explode(T.lower_words(column)).alias("word"))
    g = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if stop_words is not None:
        g = g.join(stop_words.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")
    return g.orderBy(F.desc("n"), F.asc("word")).limit(k)
