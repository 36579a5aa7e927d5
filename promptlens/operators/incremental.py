"""Incremental embedding job: cache lookups, merges, training joins,
resume ledger, batch plans and run summaries.

Keyed de-duplication is written as ``groupBy + max_by/min_by`` rather than a
``row_number`` window: the aggregate combines map-side, so a text repeated in
a third of all rows still leaves one row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.functions.frames import with_row_index, written
from promptlens.operators.embed import EmbeddingProvider, embed_texts


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep, per ``key``, the row with the largest ``order`` (dict overwrite)."""
    cols = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return g.select(key, "_r.*")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return g.select(key, "_r.*")


def cache_misses(texts: DataFrame, cache: DataFrame, key: str = "text_hash",
                 order: str = "original_index") -> DataFrame:
    """Texts whose hash is not cached, one row per hash (the first seen).

    Cached texts go first; what is left is narrowed to the smallest ``order``
    per hash on the two key columns alone, and only those rows' texts move."""
    missing = texts.join(cache.select(key), key, "left_anti")
    first = missing.groupBy(key).agg(F.min(order).alias(order))
    return missing.join(first, [key, order], "left_semi").dropDuplicates([key])


def cache_merge(existing: DataFrame, new: DataFrame, key: str = "text_hash") -> DataFrame:
    """existing UNION new; on a shared key the new row wins. Both hold a key
    once. Only keys are compared: with few new rows they go to the cache's tasks,
    and its vectors stay where they are."""
    kept = existing.join(new.select(key), key, "left_anti")
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns))


def training_join(dataset: DataFrame, cache: DataFrame, key: str = "text_hash") -> DataFrame:
    """Dataset rows with the cached vector of their text; duplicates of a
    text share one vector. Many-to-one on a unique cache key: AQE's skew
    join splits a hot hash on the dataset side."""
    return dataset.join(cache, key, "inner")


def embed_incremental(dataset: DataFrame, cache: DataFrame, text_col: str = "output",
                      provider: EmbeddingProvider | None = None,
                      key: str = "text_hash") -> tuple[DataFrame, DataFrame]:
    """One incremental step: misses -> embed -> merge -> training rows.

    Returns (new cache, training rows). Only successful vectors enter the
    cache; rows of failed texts are absent from the training rows."""
    miss = cache_misses(dataset.select("original_index", key, text_col), cache, key)
    new = embed_texts(miss, text_col, provider).where(F.col("success"))
    # written once: both results read it, the provider is called once per miss
    new = written(new.select(key, F.col("original_index").alias("vec_id"), "embedding",
                             F.size("embedding").alias("embedding_dim")), "new-vectors")
    # misses are not in the cache, so the new cache is an append
    merged = cache.select(key, "vec_id", "embedding", "embedding_dim").unionByName(new)
    train = training_join(dataset, merged, key)
    return merged, train


# ----------------------------------------------------------------- ledger
def resume_remaining(rows: DataFrame, ledger: DataFrame, key: str = "original_index") -> DataFrame:
    """Rows not yet done or previously failed: anti-join on the successes."""
    done = ledger.where(F.col("success")).select(key)
    return rows.join(done, key, "left_anti")


def progress_ledger(ledger: DataFrame, key: str = "original_index") -> DataFrame:
    """Counters derived from a ledger of attempts (one row per attempt)."""
    last = last_wins(ledger, key, "attempt")
    return last.agg(F.max(key).alias("last_processed_index"),
                    F.count_if(F.col("success")).alias("total_processed"),
                    F.count_if(~F.col("success")).alias("failed_count"))


class Ledger:
    """Attempts of a run under one folder: (key, success, attempt), appended by
    batch, read as a whole. The last attempt of a row counts."""

    SCHEMA = "original_index long, success boolean, attempt int"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, attempts: DataFrame) -> None:
        attempts.select(F.col("original_index").cast("long"), "success", F.col("attempt").cast("int")).write.mode("append").parquet(self.root)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.root)

    def failed(self, max_attempts: int) -> DataFrame:
        """Rows whose last attempt failed and that may be tried again."""
        last = last_wins(self.read(), "original_index", "attempt")
        return last.where(~F.col("success") & (F.col("attempt") < max_attempts))


# ----------------------------------------------------------------- batches
def batch_plan(df: DataFrame, size: int, key: str = "original_index",
               last_processed: int = -1) -> DataFrame:
    """batch_num = floor(i / size); batches before the resume point are
    dropped (start batch = (last + 1) // size)."""
    start = (last_processed + 1) // size
    b = F.floor(F.col(key) / F.lit(size)).cast("long")
    return df.withColumn("batch_num", b).where(F.col("batch_num") >= start)


def batch_summary(df: DataFrame, size: int, key: str = "original_index",
                  text_col: str = "output") -> DataFrame:
    x = batch_plan(df.where(F.col("success").isNotNull()), size, key)
    tok = F.when(F.col("success"), T.token_estimate(text_col)).otherwise(F.lit(0))
    return x.groupBy("batch_num").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("success")).alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
        F.sum(tok).cast("long").alias("tokens"))


def run_summary(df: DataFrame, elapsed_seconds: float, text_col: str = "output") -> DataFrame:
    x = df.where(F.col("success").isNotNull())
    tok = F.when(F.col("success"), T.token_estimate(text_col)).otherwise(F.lit(0))
    g = x.agg(F.count(F.lit(1)).alias("total"),
              F.count_if(F.col("success")).alias("successful"),
              F.count_if(~F.col("success")).alias("failed"),
              F.coalesce(F.sum(tok), F.lit(0)).cast("long").alias("total_tokens"))
    return g.select(
        "total", "successful", "failed",
        F.coalesce(F.try_divide(F.col("successful"), F.col("total")), F.lit(0.0)).alias("success_rate"),
        "total_tokens", T.cost_estimate("total_tokens").alias("estimated_cost"),
        F.coalesce(F.try_divide(F.lit(float(elapsed_seconds)), F.col("successful")),
                   F.lit(0.0)).alias("avg_seconds_per_success"))


def request_summary(df: DataFrame) -> DataFrame:
    g = df.agg(F.count(F.lit(1)).alias("total"),
               F.count_if(F.col("success")).alias("successful"))
    return g.select("total", "successful", (F.col("total") - F.col("successful")).alias("failed"),
                    F.coalesce(F.try_divide(F.col("successful"), F.col("total")),
                               F.lit(0.0)).alias("success_rate"))


def similarity_summary(df: DataFrame, sim: str = "similarity") -> DataFrame:
    """avg/max/min similarity over successful rows; 0.0 when there are none."""
    ok = df.where(F.col("success"))
    return ok.agg(F.coalesce(F.avg(sim), F.lit(0.0)).alias("avg_similarity"),
                  F.coalesce(F.max(sim), F.lit(0.0)).alias("max_similarity"),
                  F.coalesce(F.min(sim), F.lit(0.0)).alias("min_similarity"))


def throughput(df: DataFrame, time_us: str = "us") -> DataFrame:
    """Items per second and seconds per item over the log's time span."""
    g = df.agg(F.count(F.lit(1)).alias("items"),
               ((F.max(time_us) - F.min(time_us)) / F.lit(1e6)).alias("span_seconds"))
    return g.select("items", "span_seconds",
                    F.coalesce(F.try_divide(F.col("items"), F.col("span_seconds")), F.lit(0.0))
                    .alias("items_per_second"),
                    F.coalesce(F.try_divide(F.col("span_seconds"), F.col("items")), F.lit(0.0))
                    .alias("seconds_per_item"))


# ----------------------------------------------------------------- splits
def data_splits(df: DataFrame, key: str, seed: int = 42, train: float = 0.8,
                val: float = 0.1) -> DataFrame:
    """Seeded shuffle (order by md5(seed|key)) and an exact split:
    n_train = int(train*n), n_val = int(val*n), the rest test."""
    x = df.select(key, F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))).alias("_h"))
    x = with_row_index(x, ["_h", key], "_rn")
    n = df.count()
    n_train = int(n * train)
    n_val = int(n * val)
    split = (F.when(F.col("_rn") < n_train, F.lit("train"))
             .when(F.col("_rn") < n_train + n_val, F.lit("val")).otherwise(F.lit("test")))
    return x.select(key, split.alias("split"))


def middle_slice(df: DataFrame, n: int, key: str = "original_index") -> DataFrame:
    """Rows [start, start + n) of the ``key`` order, start = (total - n) // 2
    (clamped at 0)."""
    x = with_row_index(df, [key], "_pos")
    total = df.select(F.count(F.lit(1))).scalar()
    start = F.greatest(F.floor((total - F.lit(n)) / 2), F.lit(0))
    return x.where((F.col("_pos") >= start) & (F.col("_pos") < start + F.lit(n))).drop("_pos")


def head_n(df: DataFrame, n: int, key: str = "original_index") -> DataFrame:
    """First n rows in ``key`` order (a top-n sort, not a full sort)."""
    return df.orderBy(key).limit(n)
