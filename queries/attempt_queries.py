"""Endpoint analytics over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.operators import attempts as att
from queries.registry import query
from queries.standins import ATTEMPTS_SQL, ENDPOINTS_SQL, attempts, endpoints, pools, table

HEALTH_SQL = f"""
{ATTEMPTS_SQL},
runs_of AS (SELECT *, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint_id ORDER BY attempted_at DESC, id DESC) AS s FROM attempts),
tails AS (SELECT endpoint_id, count(*) FILTER (s = 0) AS consecutive_failures,
            max(attempted_at) FILTER (s = 0 AND outcome = 'rate_limited') + INTERVAL 120 SECOND AS cooldown_until FROM runs_of GROUP BY 1),
ewma AS (SELECT endpoint_id, list_reduce(list(duration_ms ORDER BY attempted_at, id), lambda a, v: a * 0.8 + v * 0.2) AS e
         FROM attempts WHERE outcome = 'success' GROUP BY 1),
counts AS (SELECT endpoint_id, count(*) FILTER (outcome = 'success') AS success_count, count(*) FILTER (outcome <> 'success') AS failure_count,
             arg_max(outcome, attempted_at) AS last FROM attempts GROUP BY 1)
"""


@query("endpoint_health", f"""
WITH {HEALTH_SQL}
SELECT endpoint_id, success_count, failure_count, consecutive_failures, round(e, 4) AS ewma_latency_ms,
  CASE last WHEN 'success' THEN 'healthy' WHEN 'rate_limited' THEN 'cooldown' ELSE 'degraded' END AS status,
  epoch_us(cooldown_until) AS cooldown_until_us
FROM counts JOIN tails USING (endpoint_id) LEFT JOIN ewma USING (endpoint_id)""")
def endpoint_health(spark, d):
    return health_columns(att.endpoint_health(attempts(spark, d)))


def health_columns(health):
    return health.select(
        "endpoint_id", "success_count", "failure_count", "consecutive_failures", F.round("ewma_latency_ms", 4).alias("ewma_latency_ms"),
        "status", F.unix_micros("cooldown_until").alias("cooldown_until_us"))


@query("failure_streaks", f"""
WITH {ATTEMPTS_SQL}, g AS (SELECT *, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint_id ORDER BY attempted_at, id) AS grp FROM attempts)
SELECT id, endpoint_id, sum(CASE WHEN outcome = 'success' THEN 0 ELSE 1 END) OVER (PARTITION BY endpoint_id, grp ORDER BY attempted_at, id)::BIGINT AS consecutive_failures FROM g""")
def failure_streaks(spark, d):
    return att.failure_streaks(attempts(spark, d)).select("id", "endpoint_id", "consecutive_failures")


@query("endpoint_summary", f"""
WITH {ENDPOINTS_SQL} SELECT protocol, status, count(*) AS endpoints, CAST(sum(success_count) AS BIGINT) AS success_count,
  CAST(sum(failure_count) AS BIGINT) AS failure_count FROM endpoints GROUP BY ALL""")
def endpoint_summary(spark, d):
    return att.endpoint_summary(endpoints(spark, d))


@query("rank_endpoints", f"""
WITH {ENDPOINTS_SQL} SELECT id, pool_id, least_latency, failover FROM (
  SELECT id, pool_id, CAST(row_number() OVER (PARTITION BY pool_id ORDER BY ewma_latency_ms NULLS LAST, failure_count, id) AS INTEGER) AS least_latency,
    CAST(row_number() OVER (PARTITION BY pool_id ORDER BY failure_count, ewma_latency_ms NULLS LAST, id) AS INTEGER) AS failover FROM endpoints)""")
def rank_endpoints(spark, d):
    ep = endpoints(spark, d)
    by_latency = att.rank_endpoints(ep, "least_latency").select("id", "pool_id", F.col("rank").alias("least_latency"))
    return by_latency.join(att.rank_endpoints(ep, "failover").select("id", F.col("rank").alias("failover")), "id")


@query("pool_endpoint_counts", f"WITH {ENDPOINTS_SQL} SELECT p.id, name, count(e.id) AS endpoints FROM pools p LEFT JOIN endpoints e ON e.pool_id = p.id GROUP BY ALL")
def pool_endpoint_counts(spark, d):
    return att.pool_endpoint_counts(pools(spark, d), endpoints(spark, d))


@query("endpoint_status", f"""
WITH {ENDPOINTS_SQL} SELECT name AS pool, uri, protocol, dns_mode, status, success_count, failure_count, secret_ref IS NOT NULL AS has_secret
FROM endpoints e JOIN pools p ON e.pool_id = p.id""")
def endpoint_status(spark, d):
    return att.endpoint_status(endpoints(spark, d), pools(spark, d))


@query("eligible_endpoints", f"""
WITH {ENDPOINTS_SQL}, leases AS (SELECT user_id AS id, ts + INTERVAL 900 SECOND AS expires_at, CASE WHEN event_type = 'view' THEN ts END AS released_at FROM events),
active AS (SELECT id, count(*) AS n FROM leases WHERE released_at IS NULL AND expires_at > TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1)
SELECT e.id, protocol, coalesce(n, 0) AS active_leases FROM endpoints e LEFT JOIN active USING (id)
WHERE status NOT IN ('disabled', 'quarantined', 'unavailable') AND (cooldown_until IS NULL OR cooldown_until <= TIMESTAMP '2024-01-16 00:00:00')
  AND protocol IN ('socks5', 'socks5_host') AND coalesce(n, 0) < 30 AND id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def eligible_endpoints(spark, d):
    now = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    leases = table(spark, d, "events").select(
        F.col("user_id").alias("endpoint_id"), (F.col("ts") + F.expr("INTERVAL 900 SECONDS")).alias("expires_at"),
        F.when(F.col("event_type") == "view", F.col("ts")).alias("released_at"))
    excluded = table(spark, d, "supplier").filter(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("id"))
    ep = endpoints(spark, d).withColumn("max_concurrency", F.lit(30))
    return att.eligible_endpoints(ep, leases, now, "socks5", excluded).select("id", "protocol", "active_leases")


@query("provider_circuit", f"""
WITH a AS (SELECT event_type AS provider_id, c_nationkey AS pool_id, user_id AS endpoint_id, CASE WHEN value >= 10 THEN 'rate_limited' ELSE 'cancelled' END AS outcome
  FROM events JOIN customer ON user_id = c_custkey),
sizes AS (SELECT c_nationkey AS pool_id, count(*) AS endpoints FROM customer GROUP BY 1),
f AS (SELECT provider_id, pool_id, count(DISTINCT endpoint_id) AS failing_endpoints FROM a WHERE outcome = 'rate_limited' GROUP BY ALL)
SELECT provider_id, pool_id, failing_endpoints, failing_endpoints >= least(3, greatest(1, endpoints)) AS blocked FROM f JOIN sizes USING (pool_id)""")
def provider_circuit(spark, d):
    ep = table(spark, d, "customer").select(F.col("c_custkey").alias("endpoint_id"), F.col("c_nationkey").alias("pool_id"))
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("provider_id"), F.col("user_id").alias("endpoint_id"),
        F.when(F.col("value") >= 10, "rate_limited").otherwise("cancelled").alias("outcome")).join(ep, "endpoint_id")
    return att.provider_circuit(rows, ep.groupBy("pool_id").agg(F.count(F.lit(1)).alias("endpoints")))


@query("coverage_summary", f"""
WITH {ENDPOINTS_SQL}
SELECT 'providers_total' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'providers_failed', count(*) FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'network_attempts', count(*) FROM events UNION ALL SELECT 'proxy_rotations', count(*) FROM events WHERE event_type IN ('error', 'purchase')
UNION ALL SELECT 'direct_attempts', count(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'cooldowns', count(*) FROM endpoints WHERE status = 'cooldown'""")
def coverage_summary(spark, d):
    requests = table(spark, d, "supplier").select(F.when(F.col("s_acctbal") < 0, "failed").otherwise("completed").alias("status"))
    kind = F.col("event_type")
    log = table(spark, d, "events").select(
        F.when(kind.isin("error", "purchase", "view"), kind).alias("rotation_reason"), F.when(kind != "view", F.col("user_id")).alias("endpoint_id"))
    return att.coverage_summary(requests, log, endpoints(spark, d))
