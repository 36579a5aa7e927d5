"""Embedding -> prompt by retrieval, evaluation of generated prompts,
variants and the offline prompt scorer.

The reference maps a vector to a prompt with a trained network; here the
prompt of the nearest training row (leave-one-out) plays that part, and a
deterministic offline provider stands in for the hosted text/embedding
models, so every result is reproducible and checkable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.functions.frames import written
from promptlens.functions import vector as VX
from promptlens.operators.ann import topk_approx
from promptlens.operators.embed import EmbeddingProvider, HashProvider, embed_texts, hash_score
from promptlens.operators.respond import ResponseLedger, TextProvider, respond
from promptlens.operators.vectors import topk_similar

# Fixed values of the variant generator, verbatim and in their natural order.
VARIANT_STYLES = ["more specific", "more creative", "more detailed", "more concise",
                  "more engaging"]
REFINE_GATE = 0.7


def generate_prompts(targets: DataFrame, corpus: DataFrame, n: int = 1,
                     target_key: str = "vec_id", corpus_key: str = "original_index",
                     vec: str = "embedding", exclude_self: bool = True, exact: bool = False) -> DataFrame:
    """Envelope per (target, slot): prompt of the slot-th nearest corpus row,
    its similarity, success and error. A target without any candidate gets
    one row with ``success = false``. The search is that of the cell tree
    (:mod:`promptlens.operators.ann`); ``exact`` compares every target with
    every corpus row instead."""
    search = topk_similar if exact else topk_approx
    nn = search(targets, corpus, k=n, target_key=target_key, corpus_key=corpus_key, vec=vec, exclude_self=exclude_self)
    prompts = corpus.select(F.col(corpus_key).cast("long").alias("vec_id"), "prompt")
    got = nn.join(prompts, "vec_id")
    t = targets.select(F.col(target_key).cast("long").alias("target_id"))
    env = t.join(got, "target_id", "left")
    return env.select("target_id", F.col("rank").alias("slot"), "vec_id", "prompt", "similarity",
                      F.col("prompt").isNotNull().alias("success"),
                      F.when(F.col("prompt").isNull(), F.lit("no candidate")).alias("error"))


def embed_corpus(corpus: DataFrame, text_col: str = "output", key: str = "original_index",
                 provider: EmbeddingProvider | None = None) -> DataFrame:
    """Corpus rows with a provider vector of ``text_col`` (failed rows dropped)."""
    e = embed_texts(corpus.select(key, "prompt", text_col), text_col, provider)
    return e.where(F.col("success")).select(key, "prompt", text_col, "embedding")


def prompt_from_text(texts: DataFrame, corpus: DataFrame, key: str, text_col: str = "text",
                     provider: EmbeddingProvider | None = None, exact: bool = False) -> DataFrame:
    """Embed each text, then generate from the vector (nearest corpus output
    by the same provider). Adds text_length and embedding_dimension."""
    provider = provider or HashProvider()
    q = written(embed_texts(texts.select(key, text_col), text_col, provider), "embedded-texts")
    ok = q.where(F.col("success"))
    cv = written(embed_corpus(corpus, provider=provider), "embedded-corpus")
    gen = generate_prompts(ok.select(key, "embedding"), cv, n=1, target_key=key,
                           exclude_self=False, exact=exact)
    meta = q.select(F.col(key).cast("long").alias("target_id"),
                    F.length(text_col).cast("long").alias("text_length"),
                    F.size("embedding").cast("long").alias("embedding_dimension"),
                    F.col("success").alias("embedded"), F.col("error").alias("embed_error"))
    out = meta.join(gen, "target_id", "left")
    return out.select("target_id", "text_length",
                      F.when(F.col("embedded"), F.col("embedding_dimension")).alias("embedding_dimension"),
                      "prompt", "similarity",
                      (F.col("embedded") & F.coalesce(F.col("success"), F.lit(False))).alias("success"),
                      F.coalesce(F.col("embed_error"), F.col("error")).alias("error"))


def process_embeddings(df: DataFrame, corpus: DataFrame, key: str, vec_json: str,
                       expected_dim: int, exact: bool = False) -> DataFrame:
    """Parse a vector given as JSON text, generate for the good rows, carry
    every other column, and isolate bad rows as ``success = false``."""
    parsed = df.withColumn("_v", F.from_json(F.col(vec_json), "array<double>"))
    bad_reason = (F.when(F.col("_v").isNull(), F.lit("invalid embedding"))
                  .when(F.size("_v") != expected_dim, F.lit("wrong dimension"))
                  .when(F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
                        F.lit("invalid embedding")))
    parsed = parsed.withColumn("_err", bad_reason)
    good = parsed.where(F.col("_err").isNull()).select(F.col(key).alias("_k"), F.col("_v").alias("embedding"))
    gen = generate_prompts(good, corpus, n=1, target_key="_k", exclude_self=False, exact=exact)
    gen = gen.select(F.col("target_id").alias("_k"), "prompt", "similarity",
                     F.col("success").alias("_ok"), F.col("error").alias("_gerr"))
    out = parsed.join(gen, parsed[key].cast("long") == gen["_k"], "left")
    carry = [c for c in df.columns if c != vec_json]
    return out.select(*carry, "prompt", "similarity",
                      (F.col("_err").isNull() & F.coalesce(F.col("_ok"), F.lit(False))).alias("success"),
                      F.coalesce(F.col("_err"), F.col("_gerr")).alias("error"))


def evaluate_generated(gen: DataFrame, corpus: DataFrame, targets: DataFrame,
                       target_key: str = "vec_id", corpus_key: str = "original_index",
                       text_provider: TextProvider | None = None, provider: EmbeddingProvider | None = None,
                       ledger: ResponseLedger | None = None) -> DataFrame:
    """Similarity of what the generated prompt yields to the target.

    With a text provider, its response to the prompt is embedded by
    ``provider``, which must be the one that the targets were embedded by.
    Without one, the response of a retrieved prompt is the output of its
    training row, and that output's vector is the row's stored vector.
    No response -> success false, similarity 0.0, an error."""
    tv = targets.select(F.col(target_key).cast("long").alias("target_id"),
                        F.col("embedding").alias("_tv"))
    if text_provider is None:
        rows = corpus.select(F.col(corpus_key).cast("long").alias("vec_id"),
                             F.col("output").alias("response"), F.col("embedding").alias("_rv"))
        x = gen.join(rows, "vec_id", "left").withColumn("_why", F.lit(None).cast("string"))
    else:
        told = respond(gen.select("target_id", "slot", "vec_id", "prompt", F.col("success").alias("_made"), F.col("error").alias("_made_error")),
                       "prompt", text_provider, ledger)
        told = told.select("target_id", "slot", "prompt", F.col("_made").alias("success"), F.col("_made_error").alias("error"),
                           F.when(F.col("_made"), F.col("response")).alias("response"), F.col("error").alias("_why"))
        vectors = embed_texts(told.where(F.col("response").isNotNull()).select("response").distinct(), "response", provider)
        vectors = vectors.select(F.col("response").alias("_text"), F.col("embedding").alias("_rv"), F.col("error").alias("_embed_error"))
        x = told.join(vectors, told["response"] == vectors["_text"], "left")
        x = x.withColumn("_why", F.coalesce("_why", "_embed_error"))
    x = x.join(tv, "target_id", "left")
    ok = F.col("success") & F.col("response").isNotNull() & F.col("_why").isNull()
    return x.select(
        "target_id", "slot", "prompt",
        F.when(ok, VX.cosine("_tv", "_rv")).otherwise(F.lit(0.0)).alias("similarity"),
        T.word_count("prompt").cast("long").alias("prompt_words"),
        F.when(ok, T.word_count("response")).otherwise(F.lit(0)).cast("long").alias("response_words"),
        ok.alias("success"),
        F.when(~F.col("success"), F.col("error")).when(F.col("_why").isNotNull(), F.col("_why"))
        .when(F.col("response").isNull(), F.lit("no response")).alias("error"))


def prompt_quality(gen: DataFrame, corpus: DataFrame, targets: DataFrame,
                   target_key: str = "vec_id", corpus_key: str = "original_index") -> DataFrame:
    """Per generated prompt: similarity, prompt words, both norms, success."""
    rows = corpus.select(F.col(corpus_key).cast("long").alias("vec_id"), F.col("embedding").alias("_rv"))
    tv = targets.select(F.col(target_key).cast("long").alias("target_id"), F.col("embedding").alias("_tv"))
    x = gen.join(rows, "vec_id", "left").join(tv, "target_id", "left")
    return x.select("target_id", "slot", VX.cosine("_tv", "_rv").alias("similarity"),
                    T.word_count("prompt").cast("long").alias("prompt_words"),
                    VX.l2_norm("_tv").alias("target_norm"), VX.l2_norm("_rv").alias("generated_norm"),
                    "success")


def diverse_variants(df: DataFrame, n: int = 5, prompt: str = "prompt") -> DataFrame:
    """n offline rewrites per prompt, style i mod 5, temperature 0.5 + 0.3 i.
    The offline rewrite is a fixed template; a null base falls back to ''."""
    styles = F.array(*[F.lit(s) for s in VARIANT_STYLES])
    x = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("variant"))
    style = F.element_at(styles, (F.col("variant") % len(VARIANT_STYLES)) + 1)
    return x.select("*", style.alias("style"),
                    (F.lit(0.5) + F.col("variant") * F.lit(0.3)).alias("temperature"),
                    F.concat(F.lit("Make it "), style, F.lit(": "),
                             F.coalesce(F.col(prompt), F.lit(""))).alias("variant_prompt"))


# ----------------------------------------------------------------- scorer
def target_vectors(targets: DataFrame, key: str, text_col: str,
                   provider: EmbeddingProvider | None = None) -> DataFrame:
    """Target vector = provider vector of the text the prompt should yield."""
    e = embed_texts(targets.select(key, text_col), text_col, provider)
    return e.where(F.col("success")).select(F.col(key).cast("long").alias("target_id"),
                                            F.col("embedding").alias("target_vec"))


def score_prompts(cands: DataFrame, tvecs: DataFrame, prompt: str = "prompt",
                  provider: EmbeddingProvider | None = None, out: str = "score",
                  text_provider: TextProvider | None = None, ledger: ResponseLedger | None = None) -> DataFrame:
    """score = cosine(target vector, vector of the text the prompt yields).

    Without providers a prompt yields itself and the score is a JVM
    expression. A text provider is asked once per distinct prompt, an
    embedding provider once per distinct text. Failures score 0."""
    if provider is None and text_provider is None:
        x = cands.join(tvecs.select("target_id", VX.normalize("target_vec").alias("_tv")), "target_id", "left")
        return x.select(*cands.columns, hash_score(F.col(prompt), F.col("_tv")).alias(out))
    if text_provider is None:
        said = cands.select("*", F.col(prompt).alias("_said"))
    else:
        asked = respond(cands.select(F.col(prompt).alias("_prompt")).distinct(), "_prompt", text_provider, ledger)
        asked = asked.select("_prompt", F.when(F.col("success"), F.col("response")).alias("_said"))
        said = cands.join(asked, cands[prompt].eqNullSafe(asked["_prompt"]), "left").select(*[cands[c] for c in cands.columns], "_said")
    texts = embed_texts(said.where(F.col("_said").isNotNull()).select("_said").distinct(), "_said", provider)
    vectors = texts.where(F.col("success")).select(F.col("_said").alias("_text"), "embedding")
    j = said.join(vectors, said["_said"] == vectors["_text"], "left").join(tvecs, "target_id", "left")
    score = F.coalesce(VX.cosine("embedding", "target_vec"), F.lit(0.0))
    return j.select(*cands.columns, F.when(F.col("_text").isNotNull(), score).otherwise(F.lit(0.0)).alias(out))


def candidate_pool(targets: DataFrame, corpus: DataFrame, tvecs: DataFrame, n: int = 5, target_key: str = "vec_id",
                   corpus_key: str = "original_index", exact: bool = False, provider: EmbeddingProvider | None = None,
                   text_provider: TextProvider | None = None, ledger: ResponseLedger | None = None) -> DataFrame:
    """target_id, slot, prompt, score: the prompts of the ``n`` nearest corpus
    rows of each target, scored; what the search strategies start from."""
    made = generate_prompts(targets, corpus, n=n, target_key=target_key, corpus_key=corpus_key, exact=exact).where("success")
    return score_prompts(made.select("target_id", "slot", "prompt"), tvecs, "prompt", provider, "score", text_provider, ledger)


def best_per_target(df: DataFrame, score: str = "score", tie: str = "slot",
                    key: str = "target_id") -> DataFrame:
    """argmax of score per target; the lowest ``tie`` wins ties."""
    cols = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.round(score, 9), -F.col(tie))).alias("_b"))
    return g.select(key, "_b.*")


def generate_with_refinement(evals: DataFrame, tvecs: DataFrame, gate: float = REFINE_GATE,
                             n_variants: int = 3, provider: EmbeddingProvider | None = None,
                             text_provider: TextProvider | None = None, ledger: ResponseLedger | None = None) -> DataFrame:
    """Gate (success and similarity > gate) -> n variants -> score -> best.
    Targets failing the gate keep their prompt with no variants."""
    passed = evals.where(F.col("success") & (F.col("similarity") > gate))
    v = diverse_variants(passed.select("target_id", "prompt"), n_variants)
    v = v.select("target_id", "variant", "style", F.col("variant_prompt").alias("vp"))
    scored = score_prompts(v, tvecs, "vp", provider, "score", text_provider, ledger)
    best = best_per_target(scored.withColumnRenamed("variant", "slot"), "score", "slot")
    out = evals.select("target_id", "prompt", "similarity", "success").join(
        best.select("target_id", F.col("vp").alias("best_variant"), F.col("score").alias("best_variant_score"),
                    F.col("style").alias("best_style")), "target_id", "left")
    return out.withColumn("refined", F.col("best_variant").isNotNull())
