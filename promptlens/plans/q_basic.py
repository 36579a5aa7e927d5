"""Source and sink round trips (SRC-01..05, SNK-01..06, P-16, P-25, F-03).

Each query writes data derived from the given tables to a fresh folder under
the shared checkpoint directory with the library's writer, reads it back with
the library's reader and returns the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.functions import vector as VX
from promptlens.plans import views as V
from promptlens.plans.registry import register
from promptlens.session import scratch_path
from promptlens.sources import io as IO
from promptlens.sources.vectortable import VectorTable

FETCH_LO, FETCH_HI = 100, 200
ROWS_PER_BUCKET = 64  # indices per bucket of the range layout; small, so that the test tables have several


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


@register("src_pairs", V.oracle("SELECT original_index, prompt, output FROM pairs", ["pairs"]))
def q_src_pairs(spark, d):
    path = scratch_path(spark, "pairs-csv")
    IO.write_pairs_csv(V.pairs(spark, d), path)
    return IO.read_pairs(spark, path)


@register("src_embeddings", V.oracle("""
SELECT vec_id, label, len(embedding) AS dims, round(list_sum(embedding), 6) AS vsum FROM emb""", ["emb"]))
def q_src_embeddings(spark, d):
    path = scratch_path(spark, "emb") + ".jsonl"
    e = V.emb(spark, d)
    e.select("vec_id", "label", F.to_json("embedding").alias("embedding")).write.json(path)
    r = IO.read_embeddings(spark, path, schema="vec_id long, label int, embedding string")
    return _r6(r.select("vec_id", "label", F.size("embedding").cast("long").alias("dims"),
                        VX.vec_sum("embedding").alias("vsum")), ["vsum"])


@register("src_embeddings_csv", V.oracle("""
SELECT vec_id, label, len(embedding) AS dims, round(list_sum(embedding), 6) AS vsum FROM emb""", ["emb"]))
def q_src_embeddings_csv(spark, d):
    """SRC-02 from a CSV with the vector as JSON text."""
    path = scratch_path(spark, "emb") + ".csv"
    V.emb(spark, d).select("vec_id", "label", F.to_json("embedding").alias("embedding")).write.option("header", True).option(
        "quoteAll", True).option("escape", '"').csv(path)
    r = IO.read_embeddings(spark, path, schema="vec_id long, label int, embedding string")
    return _r6(r.select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), VX.vec_sum("embedding").alias("vsum")), ["vsum"])


@register("src_cache", V.oracle("""
SELECT text_hash, vec_id, embedding_dim::BIGINT AS embedding_dim, round(list_sum(embedding), 6) AS vsum FROM cache""",
                                ["cache"]))
def q_src_cache(spark, d):
    path = scratch_path(spark, "cache")
    IO.write_cache(V.cache(spark, d), path)
    c = IO.read_cache(spark, path)
    return _r6(c.select("text_hash", "vec_id", F.col("embedding_dim").cast("long").alias("embedding_dim"),
                        VX.vec_sum("embedding").alias("vsum")), ["vsum"])


@register("cache_roundtrip", V.oracle("""
SELECT text_hash, vec_id, round(list_sum(embedding), 6) AS vsum FROM cache""", ["cache"]))
def q_cache_roundtrip(spark, d):
    path = scratch_path(spark, "cache") + ".jsonl"
    IO.write_cache(V.cache(spark, d), path, fmt="jsonl")
    c = IO.read_cache(spark, path)
    return _r6(c.select("text_hash", "vec_id", VX.vec_sum("embedding").alias("vsum")), ["vsum"])


def _training(spark, d):
    c = V.corpus(spark, d)
    return c.select("original_index", "prompt", "output", "embedding",
                    T.token_estimate(F.coalesce("output", F.lit(""))).alias("tokens"))


@register("training_required_fields", V.oracle("""
SELECT count(*) AS rows, count_if(embedding IS NULL) AS missing_embedding, count_if(prompt IS NULL) AS missing_prompt,
       count_if(output IS NULL) AS missing_output, count_if(embedding IS NOT NULL AND prompt IS NOT NULL) AS usable
FROM corpus""", ["corpus"]))
def q_training_required_fields(spark, d):
    path = scratch_path(spark, "train") + ".jsonl"
    IO.write_training(_training(spark, d), path)
    return IO.required_fields_report(IO.read_training(spark, path))


@register("training_roundtrip", V.oracle("""
SELECT original_index, prompt, output, round(list_sum(embedding), 6) AS vsum FROM corpus""", ["corpus"]))
def q_training_roundtrip(spark, d):
    path = scratch_path(spark, "train-pq")
    IO.write_training(_training(spark, d), path, fmt="parquet")
    t = IO.usable_training(IO.read_training(spark, path, fmt="parquet"))
    return _r6(t.select("original_index", "prompt", "output", VX.vec_sum("embedding").alias("vsum")), ["vsum"])


@register("results_roundtrip", V.oracle("""
SELECT original_index, success, toxic FROM results""", ["results"]))
def q_results_roundtrip(spark, d):
    path = scratch_path(spark, "results") + ".jsonl"
    IO.write_results(V.results(spark, d).select("original_index", "success", "toxic"), path)
    return spark.read.schema("original_index long, success boolean, toxic int").json(path)


def _records(spark, d):
    """Vector records typed by the row's data split (T-03/T-04)."""
    from promptlens.operators.incremental import data_splits
    t = _training(spark, d)
    splits = data_splits(V.pairs(spark, d), "original_index", seed=42).withColumnRenamed("split", "kind")
    return IO.vector_records(t.join(splits, "original_index"), kind_col="kind")


_REC_SQL = """sp AS (
  SELECT original_index, CASE WHEN rn < floor(n * 0.8) THEN 'train'
    WHEN rn < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT original_index, row_number() OVER (ORDER BY md5('42|' || original_index), original_index) - 1 AS rn,
               count(*) OVER () AS n FROM pairs)),
rec AS (
  SELECT s.split || '-' || c.original_index AS id, c.original_index, c.prompt, c.output, c.embedding,
         greatest(1, floor(len(list_filter(regexp_split_to_array(coalesce(c.output, ''), '\\s+'), lambda w: w <> '')) * 0.75))::INT AS tokens,
         s.split AS type
  FROM corpus c JOIN sp s ON s.original_index = c.original_index)"""


@register("vector_records", V.oracle("SELECT id, prompt, tokens, type FROM rec", ["corpus"], [_REC_SQL]))
def q_vector_records(spark, d):
    r = _records(spark, d)
    return r.select("id", "metadata.prompt", "metadata.tokens", "metadata.type")


@register("hash_records", V.oracle("""
SELECT c.text_hash AS id, min(d.output) AS text, min(d.text_hash) AS text_hash, round(min(list_sum(c.embedding)), 6) AS vsum
FROM cache c JOIN docs d ON d.text_hash = c.text_hash GROUP BY 1""", ["cache", "docs"]))
def q_hash_records(spark, d):
    """P-16, the record shape keyed by the hash of the text."""
    r = IO.hash_records(V.cache(spark, d), V.docs(spark, d).withColumn("prompt", F.lit(None).cast("string")))
    return _r6(r.select("id", "metadata.text", "metadata.text_hash", VX.vec_sum("values").alias("vsum")), ["vsum"])


@register("fetch_vectors", V.oracle(f"""
SELECT id, original_index AS index, prompt, output, tokens, type, round(list_sum(embedding), 6) AS vsum
FROM rec WHERE type = 'train' AND original_index >= {FETCH_LO} AND original_index < {FETCH_HI}""",
                                    ["corpus"], [_REC_SQL]))
def q_fetch_vectors(spark, d):
    rec = _records(spark, d)
    table = VectorTable(spark, scratch_path(spark, "vectors")).create(rec.schema, "id", ROWS_PER_BUCKET, "range", "index")
    table.upsert(rec)
    f = IO.fetch_vectors(table.fetch(FETCH_LO, FETCH_HI), FETCH_LO, FETCH_HI, "train")
    return _r6(f.select("id", "index", "prompt", "output", "tokens", "type",
                        VX.vec_sum("embedding").alias("vsum")), ["vsum"])


@register("format_training", V.oracle("""
SELECT id, prompt, output, tokens, round(list_sum(embedding), 6) AS vsum FROM rec""", ["corpus"], [_REC_SQL]))
def q_format_training(spark, d):
    rec = _records(spark, d)
    parts = [IO.fetch_vectors(rec, 0, 1 << 62, k) for k in ("train", "val", "test")]
    f = IO.format_training(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return _r6(f.select("id", "prompt", "output", "tokens", VX.vec_sum("embedding").alias("vsum")), ["vsum"])


@register("vector_upsert", V.oracle("""
SELECT 'doc-' || c.vec_id AS id,
       round(CASE WHEN d.lang = 'en' THEN -list_sum(c.embedding) ELSE list_sum(c.embedding) END, 6) AS vsum,
       CASE WHEN d.lang = 'en' THEN 'second' ELSE 'first' END AS src
FROM cache c JOIN docs d ON d.original_index = c.vec_id""", ["cache", "docs"]))
def q_vector_upsert(spark, d):
    """First batch: every cache vector. Second batch: the vectors of the
    English documents again, negated -- they must replace the first values
    and leave every other id untouched."""
    c = V.cache(spark, d)
    langs = V.docs(spark, d).select(F.col("original_index").alias("vec_id"), "lang")
    first = c.select(F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("id"),
                     F.col("embedding").alias("values"), F.lit("first").alias("src"))
    second = c.join(langs, "vec_id").where(F.col("lang") == "en").select(
        F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("id"),
        F.transform("embedding", lambda x: -x).alias("values"), F.lit("second").alias("src"))
    table = VectorTable(spark, scratch_path(spark, "vec-table")).create(first.schema, "id", buckets=16)
    table.upsert(first)
    table.upsert(second)
    t = table.read()
    return _r6(t.select("id", VX.vec_sum("values").alias("vsum"), "src"), ["vsum"])


@register("report_roundtrip", V.oracle("""
SELECT metric, value FROM (
  SELECT count(*) AS total_samples, count_if(prompt IS NULL) AS null_prompts, count_if(output IS NULL) AS null_outputs,
         count_if(prompt = '') AS empty_prompts, count_if(output = '') AS empty_outputs FROM pairs)
UNPIVOT (value FOR metric IN (total_samples, null_prompts, null_outputs, empty_prompts, empty_outputs))""",
                                       ["pairs"]))
def q_report_roundtrip(spark, d):
    """SNK-06: a profile report as a long (metric, value) table written to
    JSON with a timestamp and read back."""
    from promptlens.operators.profile import profile_counts
    r = profile_counts(V.pairs(spark, d))
    cols = r.columns
    long = r.selectExpr("stack(%d, %s) as (metric, value)" % (
        len(cols), ", ".join(f"'{c}', cast({c} as bigint)" for c in cols)))
    path = scratch_path(spark, "report") + ".json"
    IO.write_report(long, path)
    back = spark.read.schema("metric string, value long, generated_at timestamp").json(path)
    return back.select("metric", "value")
