"""Streaming jobs run to completion over whole tables (available-now trigger) and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.functions import urls
from casegraph.session import scratch_path
from casegraph.streaming import jobs
from queries.attempt_queries import HEALTH_SQL, health_columns
from queries.registry import query
from queries.standins import ATTEMPTS_SQL, attempt_columns, attempts, canonical_sql, table

HALF = "2024-01-16 00:00:00"


def stream_of(spark, d, name):
    """A table as a stream with its fixed schema, whether it is one file or a folder of part files: a glob path may be
    either."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def attempt_stream(spark, d):
    return attempt_columns(stream_of(spark, d, "events")).withColumn("attempted_at", F.col("attempted_at").cast("timestamp"))


@query("stream_import_urls", f"SELECT DISTINCT lower({canonical_sql('url')}) AS url FROM pages")
def stream_import_urls(spark, d):
    """Pages in two spellings; the second run over the same folder adds nothing."""
    loud = F.concat(F.upper(urls.scheme(F.col("url"))), F.substr("url", F.instr("url", F.lit(":"))))
    source = lambda: stream_of(spark, d, "pages").select(F.explode(F.array("url", loud)).alias("url"))
    out, checkpoint = scratch_path(spark, "urls"), scratch_path(spark, "urls-checkpoint")
    for _ in range(2):
        jobs.stream_import_urls(source(), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select(F.col("url_key").alias("url"))


@query("stream_attempt_windows", f"""
WITH {ATTEMPTS_SQL}, w AS (SELECT endpoint_id, time_bucket(INTERVAL 1 HOUR, attempted_at) AS s, outcome FROM attempts)
SELECT endpoint_id, epoch_us(s) AS start_us, count(*) AS attempts, count(*) FILTER (outcome <> 'success') AS failures FROM w
WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(attempted_at)) - INTERVAL 10 MINUTE FROM attempts) GROUP BY ALL""")
def stream_attempt_windows(spark, d):
    out = scratch_path(spark, "windows")
    jobs.stream_attempt_windows(attempt_stream(spark, d), out, scratch_path(spark, "windows-checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("endpoint_id", F.unix_micros("window_start").alias("start_us"), "attempts", "failures")


@query("stream_import_urls_bounded", f"SELECT DISTINCT lower({canonical_sql('url')}) AS url FROM pages")
def stream_import_urls_bounded(spark, d):
    """The form whose state expires: a URL's repeats come within the delay of its first sighting."""
    again = F.explode(F.array("url", F.upper("url")))
    source = stream_of(spark, d, "pages").select(again.alias("url"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 60).alias("seen_at"))
    out = scratch_path(spark, "bounded-urls")
    jobs.stream_import_urls(source, out, scratch_path(spark, "bounded-checkpoint"), within="1 hour", event_time="seen_at").awaitTermination()
    return spark.read.parquet(out).select(F.col("url_key").alias("url"))


@query("stream_attempt_windows_sliding", f"""
WITH {ATTEMPTS_SQL}, w AS (SELECT endpoint_id, time_bucket(INTERVAL 15 MINUTE, attempted_at) - k * INTERVAL 15 MINUTE AS s, outcome FROM attempts, range(0, 4) t(k))
SELECT endpoint_id, epoch_us(s) AS start_us, count(*) AS attempts, count(*) FILTER (outcome <> 'success') AS failures FROM w
WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(attempted_at)) - INTERVAL 10 MINUTE FROM attempts) GROUP BY ALL""")
def stream_attempt_windows_sliding(spark, d):
    """Windows of an hour that start every quarter."""
    out = scratch_path(spark, "sliding")
    jobs.stream_attempt_windows(attempt_stream(spark, d), out, scratch_path(spark, "sliding-checkpoint"), slide="15 minutes").awaitTermination()
    return spark.read.parquet(out).select("endpoint_id", F.unix_micros("window_start").alias("start_us"), "attempts", "failures")


@query("stream_attempt_sessions", f"""
WITH {ATTEMPTS_SQL}, g AS (SELECT *, CASE WHEN attempted_at < lag(attempted_at) OVER (PARTITION BY endpoint_id ORDER BY attempted_at) + INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS fresh FROM attempts),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY endpoint_id ORDER BY attempted_at) AS no FROM g)
SELECT endpoint_id AS session_key, epoch_us(min(attempted_at)) AS start_us, count(*) AS attempts, count(*) FILTER (outcome <> 'success') AS failures FROM s GROUP BY endpoint_id, no
HAVING max(attempted_at) + INTERVAL 7200 SECOND <= (SELECT date_trunc('millisecond', max(attempted_at)) - INTERVAL 10 MINUTE FROM attempts)""")
def stream_attempt_sessions(spark, d):
    out = scratch_path(spark, "sessions")
    stream = attempt_stream(spark, d).withColumnRenamed("endpoint_id", "session_key")
    jobs.stream_attempt_sessions(stream, out, scratch_path(spark, "sessions-checkpoint"), gap_seconds=7200).awaitTermination()
    return spark.read.parquet(out).select("session_key", F.unix_micros("session_start").alias("start_us"), "attempts", "failures")


@query("stream_endpoint_health", f"""
WITH {HEALTH_SQL}
SELECT endpoint_id, success_count, failure_count, consecutive_failures, round(e, 4) AS ewma_latency_ms,
  CASE last WHEN 'success' THEN 'healthy' WHEN 'rate_limited' THEN 'cooldown' ELSE 'degraded' END AS status,
  epoch_us(cooldown_until) AS cooldown_until_us
FROM counts JOIN tails USING (endpoint_id) LEFT JOIN ewma USING (endpoint_id)""")
def stream_endpoint_health(spark, d):
    """The log arrives in two halves with a restart between them and ends with a row without an endpoint, which lets the
    watermark pass the last attempts; the change log's newest rows equal the batch fold."""
    log = attempts(spark, d).withColumn("attempted_at", F.col("attempted_at").cast("timestamp"))
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("log", "health", "health-checkpoint"))
    early = F.col("attempted_at") < F.lit(HALF).cast("timestamp")
    end = log.agg(F.max("attempted_at").alias("newest")).select(
        *[(F.col("newest") + F.expr("INTERVAL 1 DAY") if f.name == "attempted_at" else F.lit(None).cast(f.dataType)).alias(f.name) for f in log.schema])
    for part in (log.filter(early), log.filter(~early), end):
        part.write.mode("append").parquet(folder)
        jobs.stream_endpoint_health(spark.readStream.schema(log.schema).parquet(folder), out, checkpoint).awaitTermination()
    return health_columns(jobs.latest_health(spark, out))


@query("stream_analyze", "SELECT DISTINCT 'username' AS category, c_name AS original_value FROM customer UNION SELECT DISTINCT 'config.segment', c_mktsegment FROM customer")
def stream_analyze(spark, d):
    """Configuration text files written from the customer table, analysed as they arrive; the second run finds nothing new."""
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("files", "analysis", "analysis-checkpoint"))
    lines = table(spark, d, "customer").select(F.explode(F.array(
        F.concat(F.lit("UserName="), F.col("c_name")), F.concat(F.lit("segment: "), F.col("c_mktsegment")))).alias("value"))
    lines.write.text(folder)
    for _ in range(2):
        jobs.stream_analyze(spark, folder, out, checkpoint, pattern="*.txt").awaitTermination()
    return spark.read.parquet(f"{out}/observations").select("category", "original_value").distinct()
