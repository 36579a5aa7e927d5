"""Mergeable profiles and embedding files."""

import json
import math

from pyspark.sql import functions as F

from promptlens.operators import profilestore as PS
from promptlens.operators.vectors import validate_dims
from promptlens.session import scratch_path
from promptlens.sources import io as IO


def rows(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("what is "), (F.col("id") % 5000).cast("string")).alias("prompt"),
        F.when(F.col("id") % 10 != 0, F.concat(F.lit("said"), F.repeat(F.lit(". x"), (F.col("id") % 41).cast("int")))).alias("output"))


def test_halves_merged_are_the_whole(spark):
    df = rows(spark, 20_000).withColumn("half", F.monotonically_increasing_id() % 2)
    store = PS.ProfileStore(spark, scratch_path(spark, "profiles"))
    store.add(df.where("half = 0"), "a")
    store.add(df.where("half = 1"), "b")
    store.add(df.where("half = 1"), "b")  # again: replaced
    merged, whole = store.report().first().asDict(), PS.report(PS.profile_batch(df)).first().asDict()
    estimates = [k for k in whole if k.endswith("_estimate")]
    assert {k: v for k, v in merged.items() if k not in estimates} == {k: v for k, v in whole.items() if k not in estimates}
    assert merged["total_samples"] == 20_000 and merged["null_outputs"] == 2_000
    error = 2 / math.sqrt(2 ** PS.HLL_BITS)
    exact = df.agg(F.count_distinct("prompt"), F.count_distinct("output")).first()
    for k, n in zip(("unique_prompts_estimate", "unique_outputs_estimate"), exact):
        assert abs(merged[k] - n) <= max(1, error * n)
    counts = sorted(r[0] for r in df.where("output is not null").select(F.size(F.split("output", "[.!?]+", -1))).collect())
    rank = [i / len(counts) for i, c in enumerate(counts) if c == merged["median_sentences_estimate"]]
    assert min(abs(r - 0.5) for r in rank) <= 2 / PS.KLL_SIZE + 0.02


def test_profile_of_nothing(spark):
    r = PS.report(PS.profile_batch(rows(spark, 0))).first()
    assert r["total_samples"] == 0 and r["avg_prompt_length"] is None and r["unique_prompts_estimate"] == 0 and r["median_sentences_estimate"] is None


def test_embedding_files_of_all_kinds(spark, tmp_path):
    """One document, lines and CSV give the same rows; odd components stay and
    are counted as invalid; rows without a vector go."""
    items = [{"id": 1, "embedding": [1.0, 2.0]}, {"id": 2, "embedding": [3.0, None]}, {"id": 3, "embedding": None}, {"id": 4, "embedding": [5.0, 6.0]}]
    (tmp_path / "a.json").write_text(json.dumps(items, indent=1))
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in items))
    quoted = ['{},"{}"'.format(x["id"], json.dumps(x["embedding"])) if x["embedding"] else f"{x['id']}," for x in items]
    (tmp_path / "a.csv").write_text("id,embedding\n" + "\n".join(quoted) + "\n")
    for name in ("a.json", "a.jsonl", "a.csv"):
        df = IO.read_embeddings(spark, str(tmp_path / name))
        got = {int(r["id"]): r["embedding"] for r in df.collect()}
        assert got == {1: [1.0, 2.0], 2: [3.0, None], 4: [5.0, 6.0]}, name
        report = validate_dims(df, 2).first()
        assert (report["total"], report["invalid_count"]) == (3, 1)
