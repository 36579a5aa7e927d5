"""Prompt -> response through a pluggable text provider, with a ledger.

A provider is opened once per task and called on Arrow batches of distinct
prompts. Every answer, and every failure, is appended to a ledger keyed by the
prompt's hash and the provider's model before anything reads it: a prompt is
asked once however many rows carry it, a rerun asks only what has not been
settled, and a prompt that has failed is tried again until ``max_attempts``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.operators.embed import call_with_retries
from promptlens.session import scratch_path

MAX_ATTEMPTS = 3
ANSWER = "response string, tokens_used int, success boolean, error string"
LEDGER = "prompt_hash string, prompt string, model string, attempt int, " + ANSWER


class TextProvider(Protocol):
    model: str

    def open(self) -> None: ...

    def respond(self, prompts: list[str]) -> list[tuple[str | None, int, str | None]]:
        """-> per prompt (response or None, tokens_used, error or None)."""
        ...


class EchoProvider:
    """Offline text model: a prompt yields itself."""
    model = "offline"

    def open(self) -> None:
        pass

    def respond(self, prompts):
        return [(p, max(1, int(len(p.split()) * 0.75)), None) for p in prompts]


class ResponseLedger:
    """Append-only answers of text providers under one folder, a folder per run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, model: str) -> DataFrame:
        """The last attempt of each prompt: prompt_hash, attempt and the answer."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            rows = self.spark.createDataFrame([], LEDGER)
        else:
            rows = self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(self.root)
        last = rows.where(F.col("model") == model).groupBy("prompt_hash").agg(F.max_by(
            F.struct("attempt", "response", "tokens_used", "success", "error"), F.struct("success", "attempt")).alias("a"))
        return last.select("prompt_hash", "a.*")

    def append(self, answers: DataFrame) -> None:
        answers.write.parquet(os.path.join(self.root, f"run={uuid.uuid4().hex}"))


def prompt_hash(prompt: str):
    return F.sha2(F.col(prompt), 256)


def answer(df: DataFrame, prompt: str, provider: TextProvider) -> DataFrame:
    """``df`` with the provider's answer to every row; no ledger. A call that
    fails is repeated prompt by prompt, so a bad prompt fails alone."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.open()
        for pdf in batches:
            told = call_with_retries(provider.respond, pdf[prompt].tolist())
            yield pdf.assign(response=[r[0] for r in told], tokens_used=pd.Series([r[1] for r in told], index=pdf.index, dtype="int32"),
                             success=[r[2] is None and r[0] is not None for r in told], error=[r[2] for r in told])[
                [*names, "response", "tokens_used", "success", "error"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, {ANSWER}")


def respond(df: DataFrame, prompt: str, provider: TextProvider, ledger: ResponseLedger | None = None,
            max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """``df`` with response, tokens_used, success, error and attempt. Null and
    blank prompts are not asked: success false, error ``empty prompt``."""
    spark = df.sparkSession
    ledger = ledger or ResponseLedger(spark, scratch_path(spark, "responses"))
    keyed = df.withColumn("_hash", prompt_hash(prompt))
    asked = keyed.where(F.size(T.words(prompt)) > 0).select(F.col("_hash").alias("prompt_hash"), F.col(prompt).alias("prompt"))
    asked = asked.dropDuplicates(["prompt_hash"])
    past = ledger.read(provider.model)
    todo = asked.join(past.select("prompt_hash", F.col("attempt").alias("_n"), F.col("success").alias("_ok")), "prompt_hash", "left")
    todo = todo.where(~F.coalesce(F.col("_ok"), F.lit(False)) & (F.coalesce(F.col("_n"), F.lit(0)) < max_attempts))
    todo = todo.select("prompt_hash", "prompt", F.lit(provider.model).alias("model"), (F.coalesce(F.col("_n"), F.lit(0)) + 1).alias("attempt"))
    ledger.append(answer(todo, "prompt", provider))
    told = ledger.read(provider.model)
    out = keyed.join(told, keyed["_hash"] == told["prompt_hash"], "left").drop("_hash", "prompt_hash")
    blank = F.col("success").isNull()
    return (out.withColumn("error", F.when(blank, F.lit("empty prompt")).otherwise(F.col("error")))
            .withColumn("success", F.coalesce(F.col("success"), F.lit(False))))
