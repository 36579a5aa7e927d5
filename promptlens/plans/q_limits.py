"""Rate-limit audits, tier lookup and request validation (W-01..W-03,
J-06, F-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlens.operators import limits as L
from promptlens.plans import sqlfrag as S
from promptlens.plans import views as V
from promptlens.plans.registry import register

RPM_LIMIT = 2          # small so both outcomes occur on the test tables
DAILY_TOKENS = 4000
REQ_DIM = 64           # vectors of the test tables
REQ_MAX_BATCH = 20

# event types of the log mapped onto the service's endpoints
ENDPOINT_OF_EVENT = [("view", "health"), ("click", "one"), ("signup", "text"),
                     ("purchase", "batch"), ("error", "parallel")]
TIER_NAMES = [t[0] for t in L.TIERS] + ["enterprise"]  # the last one is unknown on purpose


@register("rate_limit_rpm", V.oracle(f"""
SELECT event_id, endpoint, count(*) OVER w - 1 AS prior_requests, (count(*) OVER w - 1) >= {RPM_LIMIT} AS throttled,
       (CASE WHEN count(*) OVER w - 1 >= {RPM_LIMIT} THEN 60000000 - (us - min(us) OVER w) ELSE 0 END)::BIGINT AS wait_us
FROM reqlog WINDOW w AS (PARTITION BY endpoint ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""",
                                     ["reqlog"]))
def q_rate_limit_rpm(spark, d):
    return L.rate_limit_rpm(V.reqlog(spark, d), ["endpoint"], RPM_LIMIT)


@register("rate_limit_tokens", V.oracle(f"""
SELECT event_id, endpoint, (sum(tokens) OVER w - tokens)::BIGINT AS prior_tokens,
       coalesce(sum(tokens) OVER w > {DAILY_TOKENS}, false) AS exceeds
FROM reqlog WINDOW w AS (PARTITION BY endpoint ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""",
                                        ["reqlog"]))
def q_rate_limit_tokens(spark, d):
    return L.rate_limit_tokens(V.reqlog(spark, d), ["endpoint"], DAILY_TOKENS)


def _limits(spark):
    m = dict(L.ENDPOINT_LIMITS)
    rows = [(ev, m[ep]) for ev, ep in ENDPOINT_OF_EVENT]
    return spark.createDataFrame(rows, "endpoint string, limit_per_minute long")


_LIM_SQL = "lim AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{ev}', {dict(L.ENDPOINT_LIMITS)[ep]}::BIGINT)" for ev, ep in ENDPOINT_OF_EVENT) + ") v(endpoint, limit_per_minute))"


@register("endpoint_violations", V.oracle("""
SELECT r.event_id, r.client, r.endpoint, l.limit_per_minute, r.prior_requests,
       coalesce(r.prior_requests >= l.limit_per_minute, false) AS violation
FROM (SELECT event_id, client, endpoint, count(*) OVER w - 1 AS prior_requests FROM reqlog
      WINDOW w AS (PARTITION BY client, endpoint ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)) r
LEFT JOIN lim l ON r.endpoint = l.endpoint""", ["reqlog"], [_LIM_SQL]))
def q_endpoint_violations(spark, d):
    return L.endpoint_violations(V.reqlog(spark, d), _limits(spark))


def _client_tiers(spark, d):
    """One row per client: its request count and a tier chosen by volume
    (tier index = floor(log2(requests)), capped at the unknown last name)."""
    log = V.reqlog(spark, d)
    names = F.array(*[F.lit(n) for n in TIER_NAMES])
    g = log.groupBy("client").agg(F.count(F.lit(1)).alias("items"))
    idx = F.least(F.lit(len(TIER_NAMES) - 1), F.floor(F.log2(F.col("items")))).cast("int")
    return g.select("client", F.element_at(names, idx + 1).alias("tier"), "items")


_TIER_SQL = "tiers AS (SELECT * FROM (VALUES " + ", ".join(
    "('{}', {})".format(t[0], ", ".join("NULL::BIGINT" if x is None else f"{x}::BIGINT" for x in t[1:]))
    for t in L.TIERS) + ") v(tier, requests_per_minute, requests_per_day, tokens_per_minute, tokens_per_day, " \
    "concurrent_requests, batch_queue_limit))"
_CT_SQL = "ct AS (SELECT client, [" + ", ".join(f"'{n}'" for n in TIER_NAMES) + \
    f"][least({len(TIER_NAMES) - 1}, floor(log2(count(*))))::INT + 1] AS tier, count(*) AS items " \
    "FROM reqlog GROUP BY client)"


@register("tier_lookup", V.oracle("""
SELECT c.client, c.tier, c.items, t.requests_per_minute, t.requests_per_day, t.tokens_per_minute,
       t.tokens_per_day, t.concurrent_requests, t.batch_queue_limit,
       least(c.items, t.concurrent_requests) AS effective_concurrency
FROM ct c JOIN tiers t ON c.tier = t.tier""", ["reqlog"], [_TIER_SQL, _CT_SQL]))
def q_tier_lookup(spark, d):
    return L.tier_lookup(_client_tiers(spark, d), spark)


@register("tier_rejects", V.oracle("""
SELECT client, tier, items FROM ct WHERE tier NOT IN (SELECT tier FROM tiers)""", ["reqlog"],
                                   [_TIER_SQL, _CT_SQL]))
def q_tier_rejects(spark, d):
    return L.tier_rejects(_client_tiers(spark, d), spark)


@register("validate_requests", V.oracle(f"""
SELECT request_id, valid, reasons FROM (
  SELECT request_id, len(r) = 0 AS valid, array_to_string(r, ',') AS reasons FROM (
    SELECT request_id, list_filter([
      CASE WHEN coalesce(dims <> {REQ_DIM}, true) THEN 'bad dimensions' END,
      CASE WHEN len({S.words('text')}) = 0 THEN 'empty text' END,
      CASE WHEN length(text) > 8192 THEN 'text too long' END,
      CASE WHEN batch_size < 1 OR batch_size > {REQ_MAX_BATCH} THEN 'bad batch size' END], lambda x: x IS NOT NULL) AS r
    FROM requests))""", ["requests"]))
def q_validate_requests(spark, d):
    r = L.validate_requests(V.requests(spark, d), expected_dim=REQ_DIM, max_batch=REQ_MAX_BATCH)
    return r.select("request_id", "valid", "reasons")


_TV = """tv AS (
  SELECT r.event_id, r.client, t.*, count(*) OVER m - 1 AS minute_requests, count(*) OVER d - 1 AS day_requests,
         sum(coalesce(r.tokens, 0)) OVER m AS minute_tokens, sum(coalesce(r.tokens, 0)) OVER d AS day_tokens
  FROM reqlog r JOIN ct c ON c.client = r.client LEFT JOIN tiers t ON t.tier = c.tier
  WINDOW m AS (PARTITION BY r.client ORDER BY r.us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW),
         d AS (PARTITION BY r.client ORDER BY r.us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW))"""


@register("tier_violations", V.oracle("""
SELECT event_id, client, tier, minute_requests, day_requests, CAST(minute_tokens AS BIGINT) AS minute_tokens,
       CAST(day_tokens AS BIGINT) AS day_tokens,
       coalesce(minute_requests >= requests_per_minute, false) AS over_rpm,
       coalesce(day_requests >= requests_per_day, false) AS over_rpd,
       coalesce(minute_tokens > tokens_per_minute, false) AS over_tpm,
       coalesce(day_tokens > tokens_per_day, false) AS over_tpd
FROM tv WHERE tier IS NOT NULL""", ["reqlog"], [_TIER_SQL, _CT_SQL, _TV]))
def q_tier_violations(spark, d):
    """W-03: requests and tokens per minute and day against the client's tier."""
    return L.tier_violations(V.reqlog(spark, d), _client_tiers(spark, d), spark)


@register("validate_concurrency", V.oracle(f"""
SELECT client, len(r) = 0 AS valid, array_to_string(r, ',') AS reasons FROM (
  SELECT client, list_filter([
    CASE WHEN items < 1 OR items > {L.MAX_CONCURRENT} THEN 'bad concurrency' END,
    CASE WHEN tier NOT IN (SELECT tier FROM tiers) THEN 'unknown tier' END], lambda x: x IS NOT NULL) AS r
  FROM ct)""", ["reqlog"], [_TIER_SQL, _CT_SQL]))
def q_validate_concurrency(spark, d):
    """F-02: requested concurrency (here the client's requests) and tier name."""
    return L.validate_concurrency(_client_tiers(spark, d), concurrent="items").select("client", "valid", "reasons")
