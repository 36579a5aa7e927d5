"""Streaming queries (ST-01..ST-05). Each runs a Structured Streaming query
to completion (``availableNow``) over files derived from the given tables
and returns the sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlens.functions import vector as VX
from promptlens.functions.timecols import epoch_micros
from promptlens.plans import sqlfrag as S
from promptlens.plans import views as V
from promptlens.plans.q_limits import RPM_LIMIT
from promptlens.plans.registry import register
from promptlens.session import scratch_path
from promptlens.streaming import limiter as LM
from promptlens.streaming import streams as ST

PARTS = 4


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


def _docs_files(spark, d):
    docs = V.docs(spark, d).select("original_index", "output", "text_hash")
    src = ST.split_to_files(docs, scratch_path(spark, "docs-src"), "original_index", PARTS)
    return src, docs.schema


@register("stream_embed", V.oracle("""
SELECT d.original_index, d.text_hash, round(h.vsum, 6) AS vsum
FROM docs d JOIN (SELECT original_index, sum(value) AS vsum FROM dv GROUP BY 1) h USING (original_index)""",
                                   ["docs"], [S.hash_embed_cte("dv", "docs", "original_index", "output")]))
def q_stream_embed(spark, d):
    src, schema = _docs_files(spark, d)
    out = ST.stream_embed(spark, src, schema, scratch_path(spark, "emb-out"), "original_index", "output")
    docs = V.docs(spark, d).select("original_index", "text_hash")
    r = out.where(F.col("success")).join(docs, "original_index")
    return _r6(r.select("original_index", "text_hash", VX.vec_sum("embedding").alias("vsum")), ["vsum"])


@register("stream_upsert", V.oracle("""
SELECT text_hash, max(original_index) AS original_index, count(*) AS copies FROM docs GROUP BY 1""", ["docs"]))
def q_stream_upsert(spark, d):
    docs = V.docs(spark, d)
    x = docs.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"))
    src_df = docs.join(x, "text_hash").select("original_index", "text_hash", "copies",
                                              F.col("original_index").alias("_order"))
    src = ST.split_to_files(src_df, scratch_path(spark, "ups-src"), "original_index", PARTS)
    t = ST.stream_upsert(spark, src, src_df.schema, scratch_path(spark, "vec-table"), "text_hash",
                         ["original_index", "copies"])
    return t.select("text_hash", "original_index", "copies")


@register("stream_dedupe", V.oracle("SELECT DISTINCT text_hash FROM docs", ["docs"]))
def q_stream_dedupe(spark, d):
    src, schema = _docs_files(spark, d)
    return ST.stream_dedupe(spark, src, schema, scratch_path(spark, "dedupe-out"), "text_hash") \
        .select("text_hash")


def _events_files(spark, d):
    raw = V.table(spark, d, "events")
    # an absolute instant built from zone-free epoch micros: windows do not
    # move with the session time zone
    ev = raw.select("event_id", F.timestamp_micros(epoch_micros(raw, "ts")).alias("ts"),
                    F.col("event_type").alias("endpoint"), "value")
    src = ST.split_to_files(ev, scratch_path(spark, "ev-src"), "event_id", PARTS)
    return src, ev.schema


@register("stream_rate", V.oracle("""
SELECT ws AS window_start_us, endpoint, count(*) AS n FROM (
  SELECT event_type AS endpoint, (epoch_us(ts) // 10000000) * 10000000 - k * 10000000 AS ws
  FROM events, range(0, 6) r(k)) x
GROUP BY 1, 2""", []))
def q_stream_rate(spark, d):
    src, schema = _events_files(spark, d)
    return ST.stream_window_counts(spark, src, schema, scratch_path(spark, "rate-out"), "ts", "endpoint",
                                   "60 seconds", "10 seconds", "1 day")


@register("stream_requests", V.oracle("""
SELECT (epoch_us(ts) // 60000000) * 60000000 AS window_start_us, event_type AS endpoint, count(*) AS n,
       count_if(event_type <> 'error') AS ok, round(avg(value), 6) AS avg_value
FROM events GROUP BY 1, 2""", []))
def q_stream_requests(spark, d):
    src, schema = _events_files(spark, d)
    r = ST.stream_window_counts(spark, src, schema, scratch_path(spark, "req-out"), "ts", "endpoint",
                                "1 minute", None, "1 day",
                                extra_aggs=[F.count_if(F.col("endpoint") != "error").alias("ok"),
                                            F.avg("value").alias("avg_value")])
    return _r6(r, ["avg_value"])


@register("stream_tokens", V.oracle("""
SELECT ws AS window_start_us, endpoint, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM (
  SELECT event_type AS endpoint, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens,
         (epoch_us(ts) // 3600000000) * 3600000000 - k * 3600000000 AS ws
  FROM events, range(0, 24) r(k)) x
GROUP BY 1, 2""", []))
def q_stream_tokens(spark, d):
    """ST-04, day form: 24 h token and request windows sliding by 1 h."""
    raw = V.table(spark, d, "events")
    ev = raw.select("event_id", F.timestamp_micros(epoch_micros(raw, "ts")).alias("ts"),
                    F.col("event_type").alias("endpoint"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))
    src = ST.split_to_files(ev, scratch_path(spark, "tok-src"), "event_id", PARTS)
    r = ST.stream_window_counts(spark, src, ev.schema, scratch_path(spark, "tok-out"), "ts", "endpoint",
                                "24 hours", "1 hour", "2 days",
                                extra_aggs=[F.sum("tokens").cast("long").alias("tokens")])
    return r


# ----------------------------------------------------------------- exact limiter
DELAY_SECONDS = 3600
MARKER = -1  # id of the two requests that end the log, far behind the others


def _limited(spark, d, shuffled: bool):
    """The events in time-ordered parts, each a trigger of its own. Where
    ``shuffled``, every tenth comes a part later than its time. Of two last
    requests, of no endpoint, the first moves the watermark past all others
    and the second is a trigger that sees it."""
    raw = V.table(spark, d, "events")
    ev = raw.select("event_id", F.timestamp_micros(epoch_micros(raw, "ts")).alias("ts"), F.col("event_type").alias("endpoint"))
    ends = ev.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    part = F.floor((F.unix_micros("ts") - lo) * PARTS / (hi - lo + 1)).cast("int")
    if shuffled:
        part = F.when((F.col("event_id") % 10 == 0) & (part < PARTS - 1), part + 1).otherwise(part)
    last = spark.range(2).select(F.lit(MARKER).cast("long").alias("event_id"), F.timestamp_micros(F.lit(hi + 2 * DELAY_SECONDS * 1_000_000)).alias("ts"),
                                 F.lit(None).cast("string").alias("endpoint"), (F.col("id") + PARTS).cast("int").alias("_part"))
    src = ST.write_parts(ev.withColumn("_part", part).union(last), scratch_path(spark, "lim-src"), "_part", PARTS + 2, one_file=True)
    return LM.stream_limits(spark, src, ev.schema, scratch_path(spark, "lim-out"), ["endpoint"], RPM_LIMIT,
                            delay=f"{DELAY_SECONDS} seconds", max_files=1)


@register("stream_limiter", V.oracle(f"""
SELECT event_id, endpoint, count(*) OVER w - 1 AS prior_requests, (count(*) OVER w - 1) >= {RPM_LIMIT} AS throttled,
       (CASE WHEN count(*) OVER w - 1 >= {RPM_LIMIT} THEN 60000000 - (us - min(us) OVER w) ELSE 0 END)::BIGINT AS wait_us
FROM reqlog WINDOW w AS (PARTITION BY endpoint ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""",
                                     ["reqlog"]))
def q_stream_limiter(spark, d):
    """ST-04 exact: the stream decides as the batch audit W-01 does."""
    decided, _ = _limited(spark, d, shuffled=False)
    return decided.where(F.col("id") != MARKER).select(F.col("id").alias("event_id"), "endpoint", "prior_requests", "throttled", "wait_us")


_LATE = f"""ends AS (SELECT min(us) AS lo, max(us) AS hi FROM reqlog),
parted AS (
  SELECT event_id, endpoint, us, CASE WHEN event_id % 10 = 0 AND p < {PARTS - 1} THEN p + 1 ELSE p END AS p
  FROM (SELECT r.*, (us - lo) * {PARTS} // (hi - lo + 1) AS p FROM reqlog r, ends)),
marks AS (
  SELECT p, (max(max(us)) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - {DELAY_SECONDS * 1000}) * 1000 AS mark
  FROM parted GROUP BY p),
arrived AS (SELECT r.*, coalesce(us < mark, false) AS late FROM parted r JOIN marks m ON m.p = r.p)"""


@register("stream_late", V.oracle(f"""
SELECT event_id, endpoint, late, CASE WHEN NOT late THEN count(*) OVER w - 1 END AS prior_requests,
       CASE WHEN NOT late THEN count(*) OVER w - 1 >= {RPM_LIMIT} END AS throttled
FROM arrived WINDOW w AS (PARTITION BY endpoint, late ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""",
                                  ["reqlog"], [_LATE]))
def q_stream_late(spark, d):
    """ST-04, late rows: told apart and kept, and not counted."""
    decided, late = _limited(spark, d, shuffled=True)
    decided = decided.where(F.col("id") != MARKER).select(F.col("id").alias("event_id"), "endpoint", F.lit(False).alias("late"), "prior_requests", "throttled")
    return decided.union(late.select("id", "endpoint", F.lit(True), F.lit(None).cast("long"), F.lit(None).cast("boolean")))


@register("stream_dedupe_within", V.oracle("SELECT DISTINCT text_hash FROM docs", ["docs"]))
def q_stream_dedupe_within(spark, d):
    """ST-03 bounded: a document a second, a week to come back in."""
    docs = V.docs(spark, d).select("original_index", "text_hash", F.timestamp_seconds("original_index").alias("ts"))
    src = ST.split_to_files(docs, scratch_path(spark, "dedupe-src"), "original_index", PARTS)
    return ST.stream_dedupe_within(spark, src, docs.schema, scratch_path(spark, "dedupe-out"), "text_hash", "ts", "7 days").select("text_hash")
