"""Operator behaviour on small literal frames: slices, batches, splits,
mutation edits, rolling windows against brute force, determinism."""

from pyspark.sql import functions as F

from promptlens.functions.frames import grouped_median, grouped_summary, value_counts, with_row_index
from promptlens.functions.rolling import rolling_range
from promptlens.operators import incremental as OP
from promptlens.operators import refine as R


def test_middle_slice(spark):
    df = spark.range(11).withColumnRenamed("id", "original_index")
    got = sorted(r[0] for r in OP.middle_slice(df, 4).collect())
    assert got == [3, 4, 5, 6]


def test_batches(spark):
    df = spark.range(401).withColumnRenamed("id", "original_index").withColumn("success", F.lit(True)) \
        .withColumn("output", F.lit("a b"))
    got = {r.batch_num: r.rows for r in OP.batch_summary(df, 200).collect()}
    assert got == {0: 200, 1: 200, 2: 1}


def test_split_sizes(spark):
    df = spark.range(279).withColumnRenamed("id", "k")
    got = {r.split: r["count"] for r in OP.data_splits(df, "k").groupBy("split").count().collect()}
    assert got == {"train": 223, "val": 27, "test": 29}


def test_row_index_and_median(spark):
    df = spark.createDataFrame([(i % 7, (i * 37) % 101) for i in range(500)], "g int, v int")
    idx = with_row_index(df.withColumn("u", F.col("g") * 1000 + F.col("v")).dropDuplicates(["u"]), ["u"], "i", 8)
    rows = idx.orderBy("u").collect()
    assert [r.i for r in rows] == list(range(len(rows)))
    import statistics
    med = {r.g: r.median for r in grouped_median(df, "v", ["g"]).collect()}
    for g in range(7):
        vals = [(i * 37) % 101 for i in range(500) if i % 7 == g]
        assert med[g] == statistics.median(vals)


def test_median_of_few_hot_and_odd_values(spark):
    """Ten values, one value in most rows, null keys, extremes far apart."""
    import statistics
    rows = [("few", float(i % 10)) for i in range(997)] + [("hot", 0.0)] * 500 + [("hot", float(i)) for i in range(499)]
    rows += [(None, x) for x in (1.5, 2.5, -1e9, 1e9)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert {r.g: r.m for r in grouped_median(df, "v", ["g"], out="m").collect()} == \
        {g: statistics.median(v) for g, v in want.items()}
    assert grouped_median(df, "v", out="m").first().m == statistics.median([v for _, v in rows if v is not None])
    assert grouped_median(df.limit(0), "v", ["g"]).count() == 0


def test_summary_with_a_far_extreme(spark):
    """One extreme value: slices are cut by counts of values, the input is read
    for the counts only, and hot values cost a row."""
    import statistics
    values = [float(i) for i in range(5000)] + [1e300, -1e300] + [2500.0] * 3000 + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None]
    told = grouped_summary(df, "v")
    r = told.first()
    assert (r["n"], r["median"], r["min"], r["max"]) == (len(known), statistics.median(known), -1e300, 1e300)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan  # the written counts alone are read
    spread = value_counts(df, "v", []).groupBy("_at").count().collect()
    assert len(spread) > 1 and max(x["count"] for x in spread) < 5000
    two = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), (None, 3.0), (None, 5.0)], "g string, v double")
    got = {x["g"]: x for x in grouped_summary(two, "v", ["g"]).collect()}
    assert abs(got["a"]["std"] - 1.247219128924647) < 1e-12 and got["a"]["median"] == 2.0
    assert (got[None]["mean"], got[None]["median"], got[None]["std"]) == (4.0, 4.0, 1.0)


def test_rolling_range_matches_brute_force(spark):
    # a hot key (a third of rows) plus many small keys, with timestamp ties
    rows = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{i % 17}" if i % 17 else None
        rows.append((i, key, (i * 7919) % 1000 // 2, i % 5))
    df = spark.createDataFrame(rows, "id long, key string, t long, v long")
    for width in (50, 60, 13, 1):
        got = {r.id: (r.win_count, r.win_sum, r.win_oldest)
               for r in rolling_range(df, ["key"], "t", width, value="v").collect()}
        for i, key, t, v in rows:
            frame = [(t2, v2) for _, k2, t2, v2 in rows if k2 == key and t - width < t2 <= t]
            assert got[i] == (len(frame), sum(x[1] for x in frame), min(x[0] for x in frame)), (width, i)


def test_bad_vectors_are_invalid(spark):
    """F-01: null, NaN and infinite components, other dimensions, null vectors."""
    from promptlens.operators.vectors import invalid_dims, validate_dims
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (6, None), (7, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    r = validate_dims(df, 2).first()
    assert (r["valid"], r["total"], r["invalid_count"]) == (False, 7, 6)
    assert {x["id"]: x["dims"] for x in invalid_dims(df, 2, "id").collect()} == {2: 2, 3: 2, 4: 2, 5: 1, 6: None, 7: 0}
    assert validate_dims(df.where("id = 1"), 2).first()["valid"] and not validate_dims(df.limit(0), 2).first()["valid"]


def test_edits(spark):
    df = spark.createDataFrame([("a b c",), ("a b c d",), ("w1 w2 w3 w4 w5 w6 w7",)], "p string")
    w = F.split("p", " ")
    dl = [r[0] for r in df.select(F.array_join(R.edit_delete(w, F.lit(0)), " ")).collect()]
    assert dl == ["a b c", "b c d", "w2 w3 w4 w5 w6 w7"]
    rs = [r[0] for r in df.select(F.array_join(R.edit_restructure(w), " ")).collect()]
    assert rs[2] == "w4 w5 w6 w7 w1 w2 w3" and rs[0] == "a b c"
    sw = [r[0] for r in df.select(F.array_join(R.edit_swap(w, F.lit(2)), " ")).collect()]
    assert sw[0] == "a b c" and sw[1] == "a b d c"


def test_mutation_partition_independent(spark):
    df = spark.createDataFrame([(i, f"create a plan number {i} for the team today") for i in range(200)],
                               "target_id long, prompt string")
    m = R.mutate(F.col("prompt"), 0.3, 42, F.col("target_id"), 0)
    a = {r[0]: r[1] for r in df.repartition(1).select("target_id", m).collect()}
    b = {r[0]: r[1] for r in df.repartition(8).select("target_id", m).collect()}
    assert a == b
    assert sum(a[i] != f"create a plan number {i} for the team today" for i in a) > 50
    vocab = set(" ".join(f"create a plan number {i} for the team today" for i in range(200)).split())
    vocab |= set(R.MODIFIERS) | {s for v in R.SYNONYMS.values() for s in v}
    assert all(set(p.split()) <= vocab for p in a.values())


def test_provider_rows_fail_alone(spark):
    """A provider error fails only its rows; retries then give up."""
    from promptlens.operators import embed as OE

    class Flaky(OE.HashProvider):
        def embed(self, texts):
            if any(t and "boom" in t for t in texts):
                raise OE.TransientError("boom")
            return super().embed(texts)

    OE.BACKOFF_SECONDS = (0.0, 0.0)
    rows = [(1, "a b c"), (2, "   "), (3, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: (r.success, r.error) for r in OE.embed_texts(df, "t", Flaky()).collect()}
    assert got[1] == (True, None) and got[2] == (False, "empty text") and got[3] == (False, "empty text")
    bad = spark.createDataFrame([(9, "boom here")], "id long, t string")
    r = OE.embed_texts(bad, "t", Flaky()).first()
    assert r.success is False and r.error.startswith("failed after 3 attempts")
    # one bad text among many in one batch, and an exception that is no retry case
    many = spark.createDataFrame([(i, "boom" if i == 7 else f"text {i}") for i in range(20)], "id long, t string").coalesce(1)
    assert {r.id for r in OE.embed_texts(many, "t", Flaky()).where("not success").collect()} == {7}

    class Broken(OE.HashProvider):
        def embed(self, texts):
            if "boom" in texts:
                raise KeyError("boom")
            return super().embed(texts)

    got = {r.id: r.error for r in OE.embed_texts(many, "t", Broken()).collect()}
    assert got.pop(7).startswith("KeyError") and set(got.values()) == {None}


def test_provider_is_called_once_per_text(spark):
    from promptlens.operators import embed as OE
    from promptlens.operators.generate import prompt_from_text
    calls = spark.sparkContext.accumulator(0)

    class Counting(OE.HashProvider):
        def embed(self, texts):
            calls.add(len(texts))
            return super().embed(texts)

    corpus = spark.createDataFrame([(i, f"p{i}", f"out {i}") for i in range(30)], "original_index long, prompt string, output string")
    texts = spark.createDataFrame([(i, f"out {i}") for i in range(12)], "id long, text string")
    got = prompt_from_text(texts, corpus, "id", provider=Counting()).collect()
    assert {(r.target_id, r.prompt) for r in got} == {(i, f"p{i}") for i in range(12)}
    assert calls.value == 42


def test_topk_matches_brute_force_any_blocking(spark):
    """Exact top-k equals numpy brute force for several block layouts."""
    import numpy as np
    from promptlens.operators.vectors import topk_similar
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 16))
    rows = [(i, X[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = Xn @ Xn.T
    np.fill_diagonal(S, -np.inf)
    want = {i: list(np.argsort(-S[i], kind="stable")[:5]) for i in range(300)}
    for block_rows, tasks in [(2048, 1), (64, 3), (50, 16), (1000, 7)]:
        got = {}
        for r in topk_similar(df, df, k=5, block_rows=block_rows, min_tasks=tasks).collect():
            got.setdefault(r.target_id, {})[r.rank] = r.vec_id
        assert {t: [v[i] for i in range(1, 6)] for t, v in got.items()} == want, (block_rows, tasks)


def test_topk_copies_of_a_vector_do_not_grow_with_the_rows(spark):
    """A vector is copied once per row or column of the grid, however many
    blocks the tables have; duplicates and rows without a vector included."""
    import re
    from promptlens.operators.vectors import topk_similar
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(400)] + [(399, [0.0, 4.0, 1.0]), (500, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_similar(df, df, k=3, block_rows=10, min_tasks=4)
    plan = found._jdf.queryExecution().analyzed().toString()
    copies = [int(x) + 1 for x in re.findall(r"explode\(sequence\(0, (\d+)", plan)]
    assert copies and max(copies) <= 4
    got = {}
    for r in found.collect():
        got.setdefault(r.target_id, []).append((r["rank"], r.vec_id, round(r.similarity, 9)))
    assert len(got) == 400 and all([x[0] for x in sorted(v)] == [1, 2, 3] for v in got.values())
    assert [x[1] for x in sorted(got[0])] == [35, 70, 105]


def _windows(plan):
    return [x.split("Window ")[1] for x in plan.splitlines() if "Window " in x]


def test_no_rolling_window_is_by_key_alone(spark):
    """Events meet by (key, bucket), bucket totals by (key, span)."""
    df = spark.createDataFrame([(1, "a", 5, 1)], "id long, key string, t long, v long")
    plan = rolling_range(df, ["key"], "t", 60, value="v")._jdf.queryExecution().optimizedPlan().toString()
    found = _windows(plan)
    assert found
    for w in found:
        by = w.rsplit("], [", 2)[1]
        assert "key#" in by and ("_b#" in by or "_span#" in by), w
    assert "Join" not in plan  # the rows carry their columns along


def test_one_key_over_a_year(spark):
    """Every 20 minutes for a year, one key: exact day and minute windows."""
    step, day = 1_200_000_000, 86_400_000_000
    n = 365 * 72
    df = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * step).alias("t"), (F.col("id") % 3).alias("v"), F.lit("x").alias("payload"))
    got = rolling_range(df, ["key"], "t", day, value="v").orderBy("t").collect()
    assert len(got) == n and got[0]["payload"] == "x"
    for i in (0, 1, 71, 72, 100, 5000, n - 1):
        first = max(0, i - 71)
        assert (got[i]["win_count"], got[i]["win_sum"], got[i]["win_oldest"]) == (i - first + 1, sum(j % 3 for j in range(first, i + 1)), first * step)
    assert {r["win_count"] for r in rolling_range(df, ["key"], "t", 60_000_000).select("win_count").distinct().collect()} == {1}


def test_generation_envelopes(spark):
    """Bad vectors and targets without candidates come back as rows with
    success = false and an error, next to the good rows."""
    from promptlens.operators.generate import generate_prompts, process_embeddings
    corpus = spark.createDataFrame([(10, "p ten", "o", [1.0, 0.0]), (11, "p eleven", "o", [0.0, 1.0])],
                                   "original_index long, prompt string, output string, embedding array<double>")
    raw = spark.createDataFrame([(1, "x", "[0.9, 0.1]"), (2, "y", "[1.0"), (3, "z", "[1.0, 0.0, 0.0]"),
                                 (4, "n", "[1.0, null]")],
                                "id long, tag string, vec string")
    got = {r.id: r for r in process_embeddings(raw, corpus, "id", "vec", 2).collect()}
    assert got[1].success and got[1].prompt == "p ten" and got[1].tag == "x"
    assert (got[2].success, got[2].error) == (False, "invalid embedding")
    assert (got[3].success, got[3].error) == (False, "wrong dimension")
    assert (got[4].success, got[4].error) == (False, "invalid embedding")
    empty = corpus.where("original_index < 0")
    t = spark.createDataFrame([(5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    for exact in (True, False):
        r = generate_prompts(t, empty, n=1, exact=exact).collect()
        assert len(r) == 1 and r[0].success is False and r[0].error == "no candidate"
