"""Invariants of the iterative operators and the streaming restart."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from promptlens.session import scratch_path


def test_refinement_never_loses(spark):
    from promptlens.operators import refine as R
    from promptlens.plans.q_generate import candidate_pool, tvecs
    pool = candidate_pool(spark, SF_SMALL).cache()
    tv = tvecs(spark, SF_SMALL).cache()
    init = {r.target_id: r.score for r in pool.where("slot = 1").collect()}
    best0 = {r.target_id: r.score for r in pool.groupBy("target_id").agg(F.max("score").alias("score")).collect()}
    hc = {r.target_id: r.score for r in R.refine(R.RefineConfig("hill_climbing", 4), pool, tv).collect()}
    bs = {r.target_id: r.score for r in R.refine(R.RefineConfig("beam_search", 3), pool, tv).collect()}
    ev = {r.target_id: r.score for r in R.refine(R.RefineConfig("evolutionary", 3), pool, tv).collect()}
    for t, s in init.items():
        assert hc[t] >= s - 1e-12
    for t, s in best0.items():
        assert bs[t] >= s - 1e-12
        assert ev[t] >= s - 1e-12
    try:
        R.RefineConfig("nope")
        raise AssertionError("unknown strategy accepted")
    except ValueError:
        pass


def test_stream_restart_no_duplicates(spark):
    from promptlens.plans import views as V
    from promptlens.streaming import streams as ST
    docs = V.docs(spark, SF_SMALL).select("original_index", "output", "text_hash")
    src = scratch_path(spark, "restart-src")
    ST.split_to_files(docs.where("original_index < 100"), src + "/a", "original_index", 2)
    out = scratch_path(spark, "restart-out")
    first = ST.stream_embed(spark, src, docs.schema, out, "original_index", "output").count()
    ST.split_to_files(docs.where("original_index >= 100"), src + "/b", "original_index", 2)
    res = ST.stream_embed(spark, src, docs.schema, out, "original_index", "output")
    assert first == docs.where("original_index < 100").count()
    assert res.count() == docs.count()
    assert res.select("original_index").distinct().count() == docs.count()


def test_upsert_replay_is_idempotent(spark):
    from promptlens.streaming import streams as ST
    root = scratch_path(spark, "upsert-replay")
    b1 = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    b2 = spark.createDataFrame([("b", 20), ("c", 3)], "k string, v long")
    ST.upsert_batch(spark, root, b1, "k", 0)
    ST.upsert_batch(spark, root, b2, "k", 1)
    want = {("a", 1), ("b", 20), ("c", 3)}
    got = {(r.k, r.v) for r in ST.current_version(spark, root).collect()}
    assert got == want
    ST.upsert_batch(spark, root, b1, "k", 0)   # replay of a committed batch: no-op
    assert {(r.k, r.v) for r in ST.current_version(spark, root).collect()} == want
    ST.upsert_batch(spark, root, b2, "k", 2)   # same rows again under a new id: same table
    assert {(r.k, r.v) for r in ST.current_version(spark, root).collect()} == want


def test_profile_identities(spark):
    """The published profile's identities: question + instruction + other =
    total, and duplicates = rows - distinct (nulls count as duplicates)."""
    import __spark_entry__ as E
    q = E.queries()
    t = q["prompt_types"](spark, SF_SMALL).first()
    c = q["profile_counts"](spark, SF_SMALL).first()
    dd = q["profile_distinct"](spark, SF_SMALL).first()
    from promptlens.plans import views as V
    total_cases = V.textcases(spark, SF_SMALL).count()
    assert t.question_prompts + t.instruction_prompts + t.other_prompts == total_cases
    assert dd.duplicate_outputs == c.total_samples - dd.unique_outputs
    assert dd.duplicate_outputs >= c.null_outputs
