"""Request-side rules as audits over a request log: rolling request and
token limits, per-endpoint minute limits, tier lookup, request validation.

The reference enforces these live (sleeping); here they are computed for
every logged request, so a log of any size can be checked after the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.functions.rolling import rolling_range

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000

# Rate-limit tiers (requests/min, requests/day, tokens/min,
# tokens/day, concurrent requests, batch queue limit); None = not limited.
TIERS = [
    ("free", 100, 2000, 40000, None, 5, None),
    ("tier_1", 3000, None, 1000000, None, 20, 3000000),
    ("tier_2", 5000, None, 1000000, None, 30, 20000000),
    ("tier_3", 5000, None, 5000000, None, 50, 100000000),
    ("tier_4", 10000, None, 5000000, None, 100, 500000000),
    ("tier_5", 10000, None, 10000000, None, 200, 4000000000),
]
TIER_SCHEMA = ("tier string, requests_per_minute long, requests_per_day long, tokens_per_minute long, "
               "tokens_per_day long, concurrent_requests long, batch_queue_limit long")

# Per-endpoint requests per minute of the service.
ENDPOINT_LIMITS = [("health", 60), ("one", 30), ("text", 20), ("batch", 10), ("parallel", 5)]

# Request validation bounds of the service.
EXPECTED_DIM = 1024
MAX_TEXT_CHARS = 8192
MAX_BATCH = 100
MAX_CONCURRENT = 50


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, TIER_SCHEMA)


def rate_limit_rpm(log: DataFrame, keys: list[str], limit: int, ts: str = "us",
                   id_col: str = "event_id") -> DataFrame:
    """Requests in the last 60 s before each request (peers included);
    throttled when that prior count reaches ``limit``; wait = 60 s minus the
    age of the oldest request in the window."""
    r = rolling_range(log.select(id_col, *keys, ts), keys, ts, MINUTE_US)
    prior = F.col("win_count") - 1
    throttled = prior >= F.lit(limit)
    return r.select(id_col, *keys, prior.alias("prior_requests"), throttled.alias("throttled"),
                    F.when(throttled, F.lit(MINUTE_US) - (F.col(ts) - F.col("win_oldest")))
                    .otherwise(F.lit(0)).cast("long").alias("wait_us"))


def rate_limit_tokens(log: DataFrame, keys: list[str], daily_limit: int | None,
                      ts: str = "us", tokens: str = "tokens", id_col: str = "event_id") -> DataFrame:
    """24 h token sum of earlier requests plus this request's estimate
    against the daily limit; a null limit never triggers."""
    r = rolling_range(log.select(id_col, *keys, ts, tokens), keys, ts, DAY_US, value=tokens, with_oldest=False)
    prior = F.col("win_sum") - F.col(tokens)
    lim = F.lit(daily_limit).cast("long")
    exceeds = F.coalesce(prior + F.col(tokens) > lim, F.lit(False))
    return r.select(id_col, *keys, prior.cast("long").alias("prior_tokens"), exceeds.alias("exceeds"))


def endpoint_violations(log: DataFrame, limits: DataFrame, key: str = "client",
                        endpoint: str = "endpoint", ts: str = "us",
                        id_col: str = "event_id") -> DataFrame:
    """Per (client, endpoint) minute counts against the endpoint's limit.
    ``limits`` has one row per endpoint; Spark picks the join by its size."""
    r = rolling_range(log.select(id_col, key, endpoint, ts), [key, endpoint], ts, MINUTE_US, with_oldest=False)
    j = r.join(limits, endpoint, "left")
    prior = F.col("win_count") - 1
    return j.select(id_col, key, endpoint, F.col("limit_per_minute"),
                    prior.alias("prior_requests"),
                    F.coalesce(prior >= F.col("limit_per_minute"), F.lit(False)).alias("violation"))


def tier_lookup(requests: DataFrame, spark: SparkSession, tier_col: str = "tier",
                items_col: str = "items") -> DataFrame:
    """Join the 6-row tier table (broadcast); effective concurrency =
    min(items, tier concurrency). Unknown tiers are left out (see
    ``tier_rejects``)."""
    t = F.broadcast(tiers(spark))
    j = requests.join(t, requests[tier_col] == t["tier"], "inner").drop(t["tier"])
    return j.withColumn("effective_concurrency",
                        F.least(F.col(items_col).cast("long"), F.col("concurrent_requests")))


def tier_rejects(requests: DataFrame, spark: SparkSession, tier_col: str = "tier") -> DataFrame:
    t = F.broadcast(tiers(spark).select(F.col("tier").alias("_tier")))
    return requests.join(t, requests[tier_col] == t["_tier"], "left_anti")


def validate_requests(df: DataFrame, dims: str = "dims", text: str = "text",
                      batch: str = "batch_size", expected_dim: int = EXPECTED_DIM,
                      max_chars: int = MAX_TEXT_CHARS, max_batch: int = MAX_BATCH) -> DataFrame:
    """Boolean checks plus the list of reasons (as text) per request."""
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.col(dims) != expected_dim, F.lit(True)), F.lit("bad dimensions")),
        F.when(F.size(T.words(text)) == 0, F.lit("empty text")),
        F.when(F.length(F.col(text)) > max_chars, F.lit("text too long")),
        F.when((F.col(batch) < 1) | (F.col(batch) > max_batch), F.lit("bad batch size"))))
    return df.select("*", (F.size(reasons) == 0).alias("valid"),
                     F.array_join(reasons, ",").alias("reasons"))


def tier_violations(log: DataFrame, client_tiers: DataFrame, spark: SparkSession, key: str = "client",
                    tier_col: str = "tier", ts: str = "us", tokens: str = "tokens",
                    id_col: str = "event_id") -> DataFrame:
    """Every logged request against its client's tier: requests and tokens of
    the last minute and day. Requests count without the present one, tokens
    with it; a null limit never triggers, a client of an unknown tier has no
    row (see ``tier_rejects``)."""
    minute = rolling_range(log.select(id_col, key, ts, tokens), [key], ts, MINUTE_US, value=tokens, with_oldest=False)
    minute = minute.withColumnsRenamed({"win_count": "minute_count", "win_sum": "minute_tokens"})
    both = rolling_range(minute, [key], ts, DAY_US, value=tokens, with_oldest=False)
    limits = client_tiers.select(key, tier_col).join(F.broadcast(tiers(spark)), "tier" if tier_col == "tier" else
                                                     F.col(tier_col) == F.col("tier"))  # 6 tiers
    j = both.join(limits, key)
    over = lambda used, limit: F.coalesce(used, F.lit(False)).alias(limit)
    minute_requests, day_requests = F.col("minute_count") - 1, F.col("win_count") - 1
    return j.select(id_col, key, "tier", minute_requests.alias("minute_requests"), day_requests.alias("day_requests"),
                    "minute_tokens", F.col("win_sum").alias("day_tokens"),
                    over(minute_requests >= F.col("requests_per_minute"), "over_rpm"),
                    over(day_requests >= F.col("requests_per_day"), "over_rpd"),
                    over(F.col("minute_tokens") > F.col("tokens_per_minute"), "over_tpm"),
                    over(F.col("win_sum") > F.col("tokens_per_day"), "over_tpd"))


def validate_concurrency(df: DataFrame, tier: str = "tier", concurrent: str = "max_concurrent",
                         most: int = MAX_CONCURRENT) -> DataFrame:
    """Requested concurrency in 1..``most`` and a known tier name."""
    reasons = F.array_compact(F.array(
        F.when(F.coalesce((F.col(concurrent) < 1) | (F.col(concurrent) > most), F.lit(True)), F.lit("bad concurrency")),
        F.when(~F.coalesce(F.col(tier).isin([t[0] for t in TIERS]), F.lit(False)), F.lit("unknown tier"))))
    return df.select("*", (F.size(reasons) == 0).alias("valid"), F.array_join(reasons, ",").alias("reasons"))
