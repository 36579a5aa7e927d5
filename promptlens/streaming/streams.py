"""Structured Streaming forms of the incremental jobs.

* resumable embedding: file stream -> provider -> foreachBatch append; the
  streaming checkpoint replaces the reference's progress file, so a restart
  resumes after the last committed micro-batch.
* streaming upsert: each micro-batch becomes the next version of a keyed
  vector table (latest wins): only the buckets it touches are written, once,
  and the version carries the batch id, so a replayed batch is a no-op.
* streaming dedupe: ``dropDuplicates`` on the text hash (state = seen hashes),
  or within a watermark (state = the hashes of that span).
* rate monitor: watermark + sliding / tumbling event-time windows, emitted in
  update mode and merged per window key by foreachBatch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.functions.frames import written
from promptlens.operators.embed import EmbeddingProvider, embed_texts
from promptlens.operators.incremental import last_wins
from promptlens.sources.vectortable import VectorTable, open_or_create


def split_to_files(df: DataFrame, path: str, order: str, parts: int) -> str:
    """Write ``df`` as ``parts`` time-ordered parquet folders (equal-width
    ranges of ``order``, oldest first), so a file stream reading one folder per
    trigger sees the data in order."""
    b = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    if lo is None:
        return write_parts(df.withColumn("_part", F.lit(0)), path, "_part", 1)
    step = (hi - lo) / parts if hi != lo else 1
    bounds = [lo + i * step for i in range(1, parts)]
    part = sum((F.coalesce(F.col(order) >= F.lit(x), F.lit(False)).cast("int") for x in bounds), F.lit(0))
    return write_parts(df.withColumn("_part", part), path, "_part", parts)


def write_parts(df: DataFrame, path: str, part: str, parts: int, one_file: bool = False) -> str:
    """Write the rows of ``part`` = 0, 1, ... into folders of their own, one
    after the other, so that a file stream meets them in that order. ``df`` is
    evaluated once."""
    rows = written(df, "stream-parts")
    for i in range(parts):
        some = rows.where(F.col(part) == i).drop(part)
        (some.coalesce(1) if one_file else some).write.mode("overwrite").parquet(os.path.join(path, f"part={i:04d}"))
    return path


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_embed(spark: SparkSession, src: str, schema, out: str, key: str, text_col: str,
                 provider: EmbeddingProvider | None = None, max_files: int = 8) -> DataFrame:
    """Embed a file stream into an append-only parquet table (one micro-batch
    per input file); rerunning resumes from the checkpoint."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .option("recursiveFileLookup", "true").parquet(src))
    emb = embed_texts(stream.select(key, text_col), text_col, provider)

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one folder per micro-batch, overwritten on replay: idempotent
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))

    q = (emb.writeStream.foreachBatch(sink).trigger(availableNow=True)
         .option("checkpointLocation", out + "-checkpoint").start())
    _run(q)
    return spark.read.parquet(out)


def upsert_batch(spark: SparkSession, table_root: str, batch: DataFrame, key: str, batch_id: int,
                 order: str | None = None, buckets: int = 64) -> int:
    """Merge one micro-batch into the versioned table: its buckets are written
    once and the next version is put in place with the batch's number, so a
    replay is a no-op and a crash before that leaves the table as it was."""
    rows = batch.drop(order) if order else batch
    table = open_or_create(spark, table_root, rows.schema, key, buckets=buckets)
    return table.upsert(batch, order=order, source="stream", batch_id=batch_id)


def current_version(spark: SparkSession, table_root: str) -> DataFrame:
    return VectorTable(spark, table_root).read()


def stream_upsert(spark: SparkSession, src: str, schema, table_root: str, key: str,
                  value_cols: list[str], max_files: int = 8) -> DataFrame:
    """Each micro-batch, the latest ``_order`` of a key first, into the table;
    returns the table at the version that the stream has reached."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .option("recursiveFileLookup", "true").parquet(src))

    open_or_create(spark, table_root, stream.select(key, *value_cols).schema, key)

    def sink(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(spark, table_root, batch.select(key, *value_cols, "_order"), key, batch_id, order="_order")

    q = (stream.writeStream.foreachBatch(sink).trigger(availableNow=True)
         .option("checkpointLocation", table_root + "-checkpoint").start())
    _run(q)
    return current_version(spark, table_root)


def stream_dedupe(spark: SparkSession, src: str, schema, out: str, key: str,
                  max_files: int = 8) -> DataFrame:
    """First row of each key, however far apart: the state holds every key."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .option("recursiveFileLookup", "true").parquet(src))
    return _to_files(stream.dropDuplicates([key]), out)


def stream_dedupe_within(spark: SparkSession, src: str, schema, out: str, key: str, ts: str, within: str,
                         max_files: int = 8) -> DataFrame:
    """First row of each key, as long as its repeats come within ``within`` of
    event time: a key leaves the state when the watermark has passed that, so
    the state is bounded by the rows of that span."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .option("recursiveFileLookup", "true").parquet(src))
    return _to_files(stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key]), out)


def _to_files(rows: DataFrame, out: str) -> DataFrame:
    q = (rows.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start())
    _run(q)
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def stream_window_counts(spark: SparkSession, src: str, schema, out: str, ts: str,
                         group: str, window: str, slide: str | None, watermark: str,
                         max_files: int = 8, extra_aggs=None) -> DataFrame:
    """Event-time window aggregates with a watermark; update-mode results
    are merged per (window, group) in foreachBatch (last update wins)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .option("recursiveFileLookup", "true").parquet(src))
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    w = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    aggs = [F.count(F.lit(1)).alias("n")] + list(extra_aggs or [])
    g = s.groupBy(w.alias("w"), group).agg(*aggs)
    g = g.select(F.unix_micros(F.col("w.start")).alias("window_start_us"), group,
                 *[c for c in g.columns if c not in ("w", group)])

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"_batch={batch_id}"))

    q = (g.writeStream.outputMode("update").foreachBatch(sink).trigger(availableNow=True)
         .option("checkpointLocation", out + "-checkpoint").start())
    _run(q)
    res = spark.read.parquet(out)
    return last_wins(res.withColumn("_k", F.struct("window_start_us", group)), "_k", "_batch") \
        .drop("_k", "_batch")
