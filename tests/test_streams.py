"""The exact limiter in a stream, late rows, restarts; bounded dedupe."""

import random

from pyspark.sql import functions as F

from promptlens.operators.limits import rate_limit_rpm
from promptlens.session import scratch_path
from promptlens.streaming import limiter as LM
from promptlens.streaming import streams as ST

SCHEMA = "event_id long, us long, endpoint string"
SECOND = 1_000_000
BASE = 1_700_000_000 * SECOND


def events(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("event_id", F.timestamp_micros("us").alias("ts"), "endpoint")


def part(spark, src, name, rows):
    events(spark, rows).coalesce(1).write.parquet(f"{src}/{name}")


def run(spark, src, out, **kw):
    schema = events(spark, []).schema
    decided, late = LM.stream_limits(spark, src, schema, out, ["endpoint"], 3, delay="30 seconds", max_files=1, **kw)
    told = {r["id"]: (r["endpoint"], r["prior_requests"], r["throttled"], r["wait_us"]) for r in decided.collect() if r["id"] >= 0}
    return told, sorted(r["id"] for r in late.collect())


def audit(spark, rows):
    got = rate_limit_rpm(spark.createDataFrame(rows, SCHEMA), ["endpoint"], 3)
    return {r["event_id"]: (r["endpoint"], r["prior_requests"], r["throttled"], r["wait_us"]) for r in got.collect()}


def log(n, seed=1):
    """A hot endpoint, a rare one, one without a name; ties."""
    rng = random.Random(seed)
    return [(i, BASE + i * 400_000 // 3 * 3 - (i % 5 == 0) * (i * 400_000 % SECOND), rng.choice(["hot"] * 6 + ["rare", None])) for i in range(n)]


def end(k):
    return [(-1, BASE + 10_000_000 * SECOND + k, "end")]


def test_restarts_go_on_where_the_stream_was(spark):
    """Three runs over a growing folder decide as one audit of the whole log."""
    rows = log(900)
    src, out = scratch_path(spark, "lim-src"), scratch_path(spark, "lim-out")
    part(spark, src, "a", rows[:300])
    first, late = run(spark, src, out)
    assert first == {} or max(first) < 300
    part(spark, src, "b", rows[300:600])
    second, late = run(spark, src, out)
    assert late == [] and first.items() <= second.items() and 0 < len(second) < 600
    part(spark, src, "c", rows[600:])
    part(spark, src, "d", end(0))
    part(spark, src, "e", end(1))
    third, late = run(spark, src, out)
    assert late == [] and second.items() <= third.items()
    assert third == audit(spark, rows)
    again, _ = run(spark, src, out)
    assert again == third  # nothing new, nothing twice


def test_late_requests_are_kept_apart_and_not_counted(spark):
    rows = log(400)
    held = [r for r in rows[:150] if r[0] % 20 == 7]  # about a minute behind the watermark when they come
    on_time = [r for r in rows if r not in held]
    src, out = scratch_path(spark, "late-src"), scratch_path(spark, "late-out")
    part(spark, src, "a", on_time[:390])
    part(spark, src, "b", held + on_time[390:])
    part(spark, src, "c", end(0))
    part(spark, src, "d", end(1))
    told, late = run(spark, src, out)
    assert late == sorted(r[0] for r in held) and told == audit(spark, on_time)


def test_within_a_watermark_the_state_is_bounded(spark):
    """1,000 keys, each twice, 10 seconds apart: with a minute of memory all
    repeats go, and the state holds that minute's keys."""
    rows = sorted([(i, BASE + i * SECOND, f"k{i}") for i in range(1000)] + [(5000 + i, BASE + (i + 10) * SECOND, f"k{i}") for i in range(1000)], key=lambda r: r[1])
    src = scratch_path(spark, "dd-src")
    for i in range(10):
        part(spark, src, f"p{i}", rows[i * 200:(i + 1) * 200])
    schema = events(spark, []).schema
    kept = ST.stream_dedupe_within(spark, src, schema, scratch_path(spark, "dd-out"), "endpoint", "ts", "60 seconds", max_files=1)
    assert kept.count() == 1000 and kept.select("endpoint").distinct().count() == 1000
    sizes = {}
    for name, frame in (("all", lambda s: s.dropDuplicates(["endpoint"])),
                        ("within", lambda s: s.withWatermark("ts", "60 seconds").dropDuplicatesWithinWatermark(["endpoint"]))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
        q = (frame(stream).writeStream.format("noop").trigger(availableNow=True)
             .option("checkpointLocation", scratch_path(spark, f"dd-{name}")).start())
        q.awaitTermination()
        sizes[name] = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert sizes["all"] == 1000 and sizes["within"] < 400
