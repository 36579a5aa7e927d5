"""Pipeline queries: hashing, tokens, cache, joins, ledger, batches,
summaries, splits (P-01, P-12..P-17, J-01..J-03, J-07, J-09, W-06, W-07,
U-02, V-05, V-14, A-12..A-14, A-16, A-17, F-05, SRC-04, SRC-06..08, SNK-08,
T-03/04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.functions import vector as VX
from promptlens.operators import embed as OE
from promptlens.operators import incremental as OP
from promptlens.plans import sqlfrag as S
from promptlens.plans import views as V
from promptlens.plans.registry import register
from promptlens.session import scratch_path

BATCH_SIZE = 200
ELAPSED_SECONDS = 120.0


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


@register("text_hash", V.oracle("""
SELECT original_index, md5(prompt) AS text_hash FROM pairs""", ["pairs"]))
def q_text_hash(spark, d):
    return V.pairs(spark, d).select("original_index", T.text_hash("prompt").alias("text_hash"))


@register("token_estimates", V.oracle(f"""
SELECT original_index, greatest(1, floor({S.word_count('prompt')} * 0.75))::BIGINT AS token_estimate,
       ({S.word_count('prompt')} * 2)::BIGINT AS embed_tokens,
       ({S.word_count('prompt')} * 2 + 500)::BIGINT AS chat_tokens
FROM pairs""", ["pairs"]))
def q_token_estimates(spark, d):
    p = V.pairs(spark, d)
    return p.select("original_index", T.token_estimate("prompt").cast("long").alias("token_estimate"),
                    T.request_tokens("prompt", "embed").cast("long").alias("embed_tokens"),
                    T.request_tokens("prompt", "chat").cast("long").alias("chat_tokens"))


@register("cost_estimate", V.oracle(f"""
SELECT sum(t)::BIGINT AS total_tokens, round(sum(t) / 1e6 * 0.02, 6) AS estimated_cost
FROM (SELECT greatest(1, floor({S.word_count('output')} * 0.75)) AS t FROM pairs WHERE output IS NOT NULL)""",
                                    ["pairs"]))
def q_cost_estimate(spark, d):
    p = V.pairs(spark, d).where(F.col("output").isNotNull())
    g = p.agg(F.sum(T.token_estimate("output")).cast("long").alias("total_tokens"))
    return g.select("total_tokens", F.round(T.cost_estimate("total_tokens"), 6).alias("estimated_cost"))


@register("null_texts", V.oracle("""
SELECT count(*) AS total, count_if(prompt IS NULL) AS null_prompts,
       count_if(output IS NULL) AS null_outputs, count_if(output IS NOT NULL) AS embeddable_outputs
FROM pairs""", ["pairs"]))
def q_null_texts(spark, d):
    p = V.pairs(spark, d)
    return p.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col("prompt").isNull()).alias("null_prompts"),
                 F.count_if(F.col("output").isNull()).alias("null_outputs"),
                 F.count_if(F.col("output").isNotNull()).alias("embeddable_outputs"))


@register("row_index", V.oracle("""
SELECT original_index, conv_id, turn FROM pairs""", ["pairs"]))
def q_row_index(spark, d):
    return V.pairs(spark, d).select("original_index", "conv_id", "turn")


@register("head_n", V.oracle("""
SELECT original_index, prompt FROM pairs ORDER BY original_index LIMIT 100""", ["pairs"]))
def q_head_n(spark, d):
    return OP.head_n(V.pairs(spark, d).select("original_index", "prompt"), 100)


@register("middle_slice", V.oracle("""
SELECT original_index, prompt FROM pairs, (SELECT greatest((count(*) - 100) // 2, 0) AS s FROM pairs) c
WHERE original_index >= c.s AND original_index < c.s + 100""", ["pairs"]))
def q_middle_slice(spark, d):
    return OP.middle_slice(V.pairs(spark, d).select("original_index", "prompt"), 100)


# ----------------------------------------------------------------- hashing / cache
@register("hash_embed", V.oracle("""
SELECT original_index, bucket, round(value, 6) AS value FROM hv""", ["pairs"],
                                 [S.hash_embed_cte("hv", "pairs", "original_index", "prompt")]))
def q_hash_embed(spark, d):
    p = V.pairs(spark, d).select("original_index", "prompt")
    e = OE.embed_texts(p, "prompt")
    return _r6(OE.sparse_vector(e, "original_index"), ["value"])


@register("cache_misses", V.oracle("""
SELECT text_hash, min(original_index) AS original_index FROM docs
WHERE text_hash NOT IN (SELECT text_hash FROM cache) GROUP BY 1""", ["docs", "cache"]))
def q_cache_misses(spark, d):
    m = OP.cache_misses(V.docs(spark, d).select("original_index", "text_hash"), V.cache(spark, d))
    return m.select("text_hash", "original_index")


@register("last_wins", V.oracle("""
SELECT text_hash, max(original_index) AS original_index FROM docs GROUP BY 1""", ["docs"]))
def q_last_wins(spark, d):
    return OP.last_wins(V.docs(spark, d).select("text_hash", "original_index"), "text_hash",
                        "original_index")


@register("training_join", V.oracle("""
SELECT d.original_index, d.text_hash, c.vec_id, c.embedding_dim::BIGINT AS embedding_dim
FROM docs d JOIN cache c ON d.text_hash = c.text_hash""", ["docs", "cache"]))
def q_training_join(spark, d):
    j = OP.training_join(V.docs(spark, d).select("original_index", "text_hash"), V.cache(spark, d))
    return j.select("original_index", "text_hash", "vec_id",
                    F.col("embedding_dim").cast("long").alias("embedding_dim"))


@register("existing_ids", V.oracle("""
SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)""", []))
def q_existing_ids(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id")
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return docs.join(e, "doc_id", "left_semi")


_MISS_EMB = S.hash_embed_cte("mv", "miss", "text_hash", "output")
_MISS = """miss AS (
  SELECT d.text_hash, d.original_index, d.output FROM docs d
  JOIN (SELECT text_hash, min(original_index) AS oi FROM docs
        WHERE text_hash NOT IN (SELECT text_hash FROM cache) GROUP BY 1) m
    ON d.text_hash = m.text_hash AND d.original_index = m.oi)"""
_MERGED = """merged AS (
  SELECT text_hash, vec_id, embedding_dim::BIGINT AS embedding_dim,
         list_sum(embedding) AS vsum FROM cache
  UNION ALL
  SELECT m.text_hash, m.original_index AS vec_id, 64::BIGINT AS embedding_dim,
         (SELECT sum(value) FROM mv WHERE mv.text_hash = m.text_hash) AS vsum
  FROM miss m WHERE m.text_hash IN (SELECT text_hash FROM mv))"""


@register("cache_merge", V.oracle("""
SELECT text_hash, vec_id, embedding_dim, round(vsum, 6) AS vsum FROM merged""",
                                  ["docs", "cache"], [_MISS, _MISS_EMB, _MERGED]))
def q_cache_merge(spark, d):
    merged, _ = OP.embed_incremental(V.docs(spark, d), V.cache(spark, d))
    return _r6(merged.select("text_hash", "vec_id",
                             F.col("embedding_dim").cast("long").alias("embedding_dim"),
                             VX.vec_sum("embedding").alias("vsum")), ["vsum"])


@register("embed_incremental", V.oracle("""
SELECT d.original_index, d.text_hash, m.vec_id, m.embedding_dim, round(m.vsum, 6) AS vsum
FROM docs d JOIN merged m ON d.text_hash = m.text_hash""",
                                        ["docs", "cache"], [_MISS, _MISS_EMB, _MERGED]))
def q_embed_incremental(spark, d):
    _, train = OP.embed_incremental(V.docs(spark, d), V.cache(spark, d))
    return _r6(train.select("original_index", "text_hash", "vec_id",
                            F.col("embedding_dim").cast("long").alias("embedding_dim"),
                            VX.vec_sum("embedding").alias("vsum")), ["vsum"])


# ----------------------------------------------------------------- results / ledger
@register("success_split", V.oracle("""
SELECT original_index, CASE WHEN success THEN 'success' ELSE 'failed' END AS outcome
FROM results WHERE success IS NOT NULL""", ["results"]))
def q_success_split(spark, d):
    r = V.results(spark, d).where(F.col("success").isNotNull())
    return r.select("original_index", F.when(F.col("success"), "success").otherwise("failed")
                    .alias("outcome"))


@register("result_join", V.oracle("""
SELECT d.doc_id AS original_index, d.lang, r.success, r.toxic
FROM documents d JOIN results r ON d.doc_id = r.original_index""", ["results"]))
def q_result_join(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("original_index"), "lang")
    r = V.results(spark, d).select("original_index", "success", "toxic")
    return docs.join(r, "original_index")


@register("resume_remaining", V.oracle("""
SELECT original_index FROM docs
WHERE original_index NOT IN (SELECT original_index FROM results WHERE success)""", ["docs", "results"]))
def q_resume_remaining(spark, d):
    ledger = V.results(spark, d).where(F.col("success").isNotNull()).select("original_index", "success")
    return OP.resume_remaining(V.docs(spark, d).select("original_index"), ledger)


@register("progress_ledger", V.oracle("""
SELECT max(original_index) AS last_processed_index, count_if(success) AS total_processed,
       count_if(NOT success) AS failed_count
FROM results WHERE success IS NOT NULL""", ["results"]))
def q_progress_ledger(spark, d):
    ledger = (V.results(spark, d).where(F.col("success").isNotNull())
              .select("original_index", "success", F.lit(1).alias("attempt")))
    return OP.progress_ledger(ledger)


_TRIES = """tries AS (
  SELECT original_index, success, 1 AS attempt FROM results WHERE success IS NOT NULL
  UNION ALL SELECT original_index, original_index % 2 = 0, 2 FROM results WHERE NOT success
  UNION ALL SELECT original_index, false, 3 FROM results WHERE NOT success AND original_index % 2 = 1)"""


@register("progress_retries", V.oracle("""
SELECT max(original_index) AS last_processed_index, count_if(success) AS total_processed, count_if(NOT success) AS failed_count
FROM (SELECT original_index, max_by(success, attempt) AS success FROM tries GROUP BY 1)""", ["results"], [_TRIES]))
def q_progress_retries(spark, d):
    """SNK-08 with retries: failed rows are tried again, those with an even
    index come through at the second attempt, the others never."""
    first = V.results(spark, d).where(F.col("success").isNotNull()).select("original_index", "success", F.lit(1).alias("attempt"))
    ledger = OP.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.append(first)
    even = F.col("original_index") % 2 == 0
    for attempt, outcome in ((2, even), (3, F.lit(False))):
        ledger.append(ledger.failed(max_attempts=3).select("original_index", outcome.alias("success"), F.lit(attempt).alias("attempt")))
    return OP.progress_ledger(ledger.read())


@register("batch_plan", V.oracle(f"""
SELECT original_index, (original_index // {BATCH_SIZE})::BIGINT AS batch_num FROM docs
WHERE original_index // {BATCH_SIZE} >= (399 + 1) // {BATCH_SIZE}""", ["docs"]))
def q_batch_plan(spark, d):
    return OP.batch_plan(V.docs(spark, d).select("original_index"), BATCH_SIZE, last_processed=399)


@register("batch_summary", V.oracle(f"""
SELECT (original_index // {BATCH_SIZE})::BIGINT AS batch_num, count(*) AS rows,
       count_if(success) AS successes, count_if(NOT success) AS failures,
       sum(CASE WHEN success THEN greatest(1, floor({S.word_count('output')} * 0.75)) ELSE 0 END)::BIGINT AS tokens
FROM results WHERE success IS NOT NULL GROUP BY 1""", ["results"]))
def q_batch_summary(spark, d):
    return OP.batch_summary(V.results(spark, d), BATCH_SIZE)


@register("run_summary", V.oracle(f"""
SELECT total, successful, failed, round(coalesce(successful / nullif(total, 0), 0.0), 6) AS success_rate,
       total_tokens, round(total_tokens / 1e6 * 0.02, 6) AS estimated_cost,
       round(coalesce({ELAPSED_SECONDS} / nullif(successful, 0), 0.0), 6) AS avg_seconds_per_success
FROM (SELECT count(*) AS total, count_if(success) AS successful, count_if(NOT success) AS failed,
             coalesce(sum(CASE WHEN success THEN greatest(1, floor({S.word_count('output')} * 0.75)) ELSE 0 END), 0)::BIGINT AS total_tokens
      FROM results WHERE success IS NOT NULL)""", ["results"]))
def q_run_summary(spark, d):
    r = OP.run_summary(V.results(spark, d), ELAPSED_SECONDS)
    return _r6(r, ["success_rate", "estimated_cost", "avg_seconds_per_success"])


@register("request_summary", V.oracle("""
SELECT count(*) AS total, count_if(success) AS successful, count(*) - count_if(success) AS failed,
       round(coalesce(count_if(success) / nullif(count(*), 0), 0.0), 6) AS success_rate
FROM reqlog""", ["reqlog"]))
def q_request_summary(spark, d):
    return _r6(OP.request_summary(V.reqlog(spark, d)), ["success_rate"])


@register("throughput", V.oracle("""
SELECT items, round(span, 6) AS span_seconds, round(coalesce(items / nullif(span, 0), 0.0), 6) AS items_per_second,
       round(coalesce(span / nullif(items, 0), 0.0), 6) AS seconds_per_item
FROM (SELECT count(*) AS items, (max(us) - min(us)) / 1e6 AS span FROM reqlog)""", ["reqlog"]))
def q_throughput(spark, d):
    return _r6(OP.throughput(V.reqlog(spark, d)),
               ["span_seconds", "items_per_second", "seconds_per_item"])


@register("data_splits", V.oracle("""
SELECT original_index, CASE WHEN rn < floor(n * 0.8) THEN 'train'
  WHEN rn < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split
FROM (SELECT original_index, row_number() OVER (ORDER BY md5('42|' || original_index), original_index) - 1 AS rn,
             count(*) OVER () AS n FROM pairs)""", ["pairs"]))
def q_data_splits(spark, d):
    return OP.data_splits(V.pairs(spark, d), "original_index", seed=42)


@register("training_summary", V.oracle("""
SELECT count(*) AS examples, count_if(embedding IS NOT NULL AND prompt IS NOT NULL) AS usable,
       count_if(output IS NULL) AS missing_output, count_if(prompt IS NULL) AS missing_prompt,
       count_if(embedding IS NULL) AS missing_embedding
FROM corpus""", ["corpus"]))
def q_training_summary(spark, d):
    c = V.corpus(spark, d)
    return c.agg(F.count(F.lit(1)).alias("examples"),
                 F.count_if(F.col("embedding").isNotNull() & F.col("prompt").isNotNull()).alias("usable"),
                 F.count_if(F.col("output").isNull()).alias("missing_output"),
                 F.count_if(F.col("prompt").isNull()).alias("missing_prompt"),
                 F.count_if(F.col("embedding").isNull()).alias("missing_embedding"))
