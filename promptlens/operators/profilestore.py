"""Mergeable profiles (A-01..A-11): one row per batch, merged without a rescan.

A batch's row holds counts, sums, extremes, one HLL sketch per text column (A-02)
and one KLL sketch of sentences per output (A-07). All of them merge: counts and
sums add, extremes compare, sketches unite. A store is a folder to which each
batch adds its row; a report reads the rows and never the batches. What a report
says of counts, means and extremes is exact; distinct texts are within about
``2 / sqrt(2 ** HLL_BITS)`` and the rank of the median within about
``2 / KLL_SIZE``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.functions import text as T

HLL_BITS, KLL_SIZE = 14, 400
TEXTS = ("prompt", "output")
_COUNTS = ("rows", *(f"{kind}_{t}s" for t in TEXTS for kind in ("null", "empty")), *(f"{t}s" for t in TEXTS),
           *(f"{t}_{unit}" for t in TEXTS for unit in ("chars", "words")), "sentences", "question_prompts", "instruction_prompts",
           "code_outputs", "list_outputs", "explanation_outputs")


def profile_batch(df: DataFrame) -> DataFrame:
    """One row for ``df`` (prompt, output)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for t in TEXTS:
        aggs += [F.count_if(F.col(t).isNull()).alias(f"null_{t}s"), F.count_if(F.col(t) == "").alias(f"empty_{t}s"), F.count(t).alias(f"{t}s"),
                 total(T.char_len(t)).alias(f"{t}_chars"), total(T.word_count(t)).alias(f"{t}_words"),
                 F.min(T.char_len(t)).alias(f"min_{t}"), F.max(T.char_len(t)).alias(f"max_{t}"),
                 F.hll_sketch_agg(t, HLL_BITS).alias(f"distinct_{t}s")]
    aggs += [total(T.sentence_count("output")).alias("sentences"),
             F.count_if(T.is_question("prompt")).alias("question_prompts"), F.count_if(T.is_instruction("prompt")).alias("instruction_prompts"),
             F.count_if(T.is_code("output")).alias("code_outputs"), F.count_if(T.is_list("output")).alias("list_outputs"),
             F.count_if(T.is_explanation("output")).alias("explanation_outputs"),
             F.kll_sketch_agg_bigint(T.sentence_count("output").cast("long"), F.lit(KLL_SIZE)).alias("sentence_sketch")]
    return df.agg(*aggs)


def merge(profiles: DataFrame) -> DataFrame:
    """Rows of :func:`profile_batch` as one."""
    return profiles.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS],
        *[f(f"{side}_{t}").alias(f"{side}_{t}") for t in TEXTS for side, f in (("min", F.min), ("max", F.max))],
        *[F.hll_union_agg(f"distinct_{t}s").alias(f"distinct_{t}s") for t in TEXTS],
        F.kll_merge_agg_bigint("sentence_sketch", F.lit(KLL_SIZE)).alias("sentence_sketch"))


def report(profile: DataFrame) -> DataFrame:
    """What a merged profile says."""
    mean = lambda total, n: F.try_divide(F.col(total), F.col(n))
    return profile.select(
        F.col("rows").alias("total_samples"), *[f"{kind}_{t}s" for t in TEXTS for kind in ("null", "empty")],
        *[mean(f"{t}_{unit}", f"{t}s").alias(f"avg_{t}_{name}") for t in TEXTS for unit, name in (("chars", "length"), ("words", "words"))],
        *[F.col(f"{side}_{t}").alias(f"{side}_{t}_length") for t in TEXTS for side in ("min", "max")],
        mean("sentences", "outputs").alias("avg_sentences_per_output"),
        "question_prompts", "instruction_prompts", (F.col("rows") - F.col("question_prompts") - F.col("instruction_prompts")).alias("other_prompts"),
        "code_outputs", "list_outputs", "explanation_outputs",
        *[F.hll_sketch_estimate(f"distinct_{t}s").alias(f"unique_{t}s_estimate") for t in TEXTS],
        F.when(F.col("outputs") > 0, F.kll_sketch_get_quantile_bigint("sentence_sketch", F.lit(0.5))).alias("median_sentences_estimate"))


class ProfileStore:
    """Profile rows under one folder, a folder per added batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, df: DataFrame, batch: str | None = None) -> None:
        """Add the profile of ``df``. A named batch replaces its earlier row,
        so a batch that is run again counts once."""
        path = os.path.join(self.root, f"batch={batch or uuid.uuid4().hex}")
        profile_batch(df).write.mode("overwrite").parquet(path)

    def report(self) -> DataFrame:
        return report(merge(self.spark.read.parquet(self.root).drop("batch")))
