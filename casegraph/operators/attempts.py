"""Endpoint analytics over the append-only attempt log.

Health and streaks depend on the order of an endpoint's attempts. To keep a busy endpoint from landing in one task,
the log is cut into (endpoint, time slice) chunks; each chunk is summarized on its own, the small summaries are
combined per endpoint, and the result equals the sequential fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions.ordered import ranked

SLICE_SECONDS = 60
STATE = [
    "endpoint_id", "chunk", "success_count", "failure_count", "latency_sum", "first_latency", "tail_failures",
    "last_order", "last_outcome", "tail_cooldown",
]


def _slice(seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col("attempted_at").cast("timestamp")) / seconds)


def attempt_chunks(attempts: DataFrame, seconds: int = SLICE_SECONDS, cooldown: int = fv.COOLDOWN_SECONDS) -> DataFrame:
    """Summary per (endpoint, slice). Latency weights use the closed form of the moving average: a success followed by
    k later successes of its chunk weighs 0.2 * 0.8^k."""
    success = F.col("outcome") == "success"
    retry = F.col("retry_after_seconds") if "retry_after_seconds" in attempts.columns else F.lit(None).cast("double")
    newest_first = W.partitionBy("endpoint_id", "chunk").orderBy(F.desc("attempted_at"), F.desc("id"))
    later = newest_first.rowsBetween(W.unboundedPreceding, -1)
    rows = attempts.withColumn("chunk", _slice(seconds)).withColumn(
        "__later", F.coalesce(F.sum(success.cast("long")).over(later), F.lit(0))
    )
    order = F.struct(F.col("attempted_at").alias("at"), F.col("id").alias("id"))
    rotating = F.col("outcome").isin(fv.ROTATING_OUTCOMES)
    until = F.col("attempted_at").cast("timestamp") + F.make_dt_interval(
        secs=F.coalesce(retry, F.lit(float(cooldown))).cast("decimal(18,6)")
    )
    in_tail = ~success & (F.col("__later") == 0)
    return rows.groupBy("endpoint_id", "chunk").agg(
        F.count_if(success).alias("success_count"),
        F.count_if(~success).alias("failure_count"),
        F.coalesce(F.sum(F.when(success, F.col("duration_ms") * fv.EWMA_NEW * F.pow(F.lit(fv.EWMA_KEEP), "__later"))),
                   F.lit(0.0)).alias("latency_sum"),
        F.min_by(F.when(success, F.col("duration_ms")), F.when(success, order)).alias("first_latency"),
        F.count_if(in_tail).alias("tail_failures"),
        F.max(order).alias("last_order"),
        F.max_by("outcome", order).alias("last_outcome"),
        F.max_by(F.when(in_tail & rotating, until), F.when(in_tail & rotating, order)).alias("tail_cooldown"),
    ).select(*STATE)


def combine_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk summaries of an endpoint -> one summary of the same shape (associative in time order)."""
    later = W.partitionBy("endpoint_id").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)
    rows = chunks.withColumn("__later", F.coalesce(F.sum("success_count").over(later), F.lit(0)))
    open_tail = F.col("__later") == 0
    has_success = F.col("success_count") > 0
    return rows.groupBy("endpoint_id").agg(
        F.max("chunk").alias("chunk"),
        F.sum("success_count").alias("success_count"),
        F.sum("failure_count").alias("failure_count"),
        F.sum(F.col("latency_sum") * F.pow(F.lit(fv.EWMA_KEEP), "__later")).alias("latency_sum"),
        F.min_by(F.when(has_success, F.col("first_latency")), F.when(has_success, F.col("chunk"))).alias("first_latency"),
        F.sum(F.when(open_tail, F.col("tail_failures")).otherwise(0)).alias("tail_failures"),
        F.max("last_order").alias("last_order"),
        F.max_by("last_outcome", "last_order").alias("last_outcome"),
        F.max_by(
            F.when(open_tail, F.col("tail_cooldown")),
            F.when(open_tail & F.col("tail_cooldown").isNotNull(), F.col("chunk")),
        ).alias("tail_cooldown"),
    ).select(*STATE)


def health_view(state: DataFrame) -> DataFrame:
    """Readable health row from a combined summary."""
    last = F.col("last_outcome")
    ewma = F.col("latency_sum") + F.col("first_latency") * F.pow(F.lit(fv.EWMA_KEEP), "success_count")
    return state.select(
        "endpoint_id", "success_count", "failure_count", F.col("tail_failures").alias("consecutive_failures"),
        ewma.alias("ewma_latency_ms"),
        F.when(last == "success", "healthy").when(last.isin(fv.ROTATING_OUTCOMES), "cooldown").otherwise("degraded")
        .alias("status"),
        F.col("tail_cooldown").alias("cooldown_until"), F.col("last_order.at").alias("last_checked_at"),
    )


def endpoint_health(attempts: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """attempts(id, endpoint_id, attempted_at, outcome, duration_ms[, retry_after_seconds]) -> one row per endpoint."""
    return health_view(combine_chunks(attempt_chunks(attempts, seconds)))


def failure_streaks(attempts: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add the number of consecutive failures ending at each attempt.

    streak = position - position of the last success; positions are local to a chunk plus the count of earlier chunks."""
    success = F.col("outcome") == "success"
    order = W.partitionBy("endpoint_id", "chunk").orderBy("attempted_at", "id")
    local = (
        attempts.withColumn("chunk", _slice(seconds))
        .withColumn("__pos", F.row_number().over(order))
        .withColumn("__hit", F.max(F.when(success, F.col("__pos"))).over(order))
    )
    before = W.partitionBy("endpoint_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        local.groupBy("endpoint_id", "chunk").agg(F.max("__pos").alias("n"), F.max("__hit").alias("hit"))
        .withColumn("__start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("__last", F.coalesce(F.max(F.col("__start") + F.col("hit")).over(before), F.lit(0)))
        .select("endpoint_id", "chunk", "__start", "__last")
    )
    return (
        local.join(carry, ["endpoint_id", "chunk"])
        .withColumn(
            "consecutive_failures",
            F.col("__start") + F.col("__pos") - F.coalesce(F.col("__start") + F.col("__hit"), F.col("__last")),
        )
        .select(*attempts.columns, "consecutive_failures")
    )


def endpoint_summary(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("protocol", "status").agg(
        F.count(F.lit(1)).alias("endpoints"), F.sum("success_count").alias("success_count"),
        F.sum("failure_count").alias("failure_count"),
    )


def rank_endpoints(endpoints: DataFrame, policy: str, first: int | None = None) -> DataFrame:
    """Rank inside each pool. `least_latency`: moving average (missing last), then failures; `failover`: the reverse.
    With `first`, only the best rows are kept and the limit is applied before the shuffle; without it the ranking is
    split over range partitions, so a large pool does not land in one task."""
    latency = F.col("ewma_latency_ms").asc_nulls_last()
    order = [latency, F.col("failure_count").asc()] if policy == "least_latency" else [F.col("failure_count").asc(), latency]
    order.append(F.col("id").asc())
    if first is None:
        return ranked(endpoints, ["pool_id"], order, "rank")
    best = F.row_number().over(W.partitionBy("pool_id").orderBy(*order))
    return endpoints.withColumn("rank", best).filter(F.col("rank") <= first)


def provider_circuit(attempts: DataFrame, pool_sizes: DataFrame) -> DataFrame:
    """(provider_id, pool_id): distinct endpoints with a rotating failure and whether the provider is blocked."""
    failing = (
        attempts.filter(F.col("outcome").isin(fv.ROTATING_OUTCOMES))
        .select("provider_id", "pool_id", "endpoint_id").distinct()
        .groupBy("provider_id", "pool_id").agg(F.count(F.lit(1)).alias("failing_endpoints"))
    )
    limit = F.least(F.lit(fv.CIRCUIT_ENDPOINTS), F.greatest(F.lit(1), F.col("endpoints")))
    return failing.join(pool_sizes, "pool_id").select(
        "provider_id", "pool_id", "failing_endpoints", (F.col("failing_endpoints") >= limit).alias("blocked")
    )


def coverage_summary(provider_requests: DataFrame, attempts: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(name, n) rows; every count is one partial aggregate over one scan."""
    rotated = F.col("rotation_reason").isNotNull() & F.col("endpoint_id").isNotNull()
    counts = [
        provider_requests.agg(
            F.count(F.lit(1)).alias("providers_total"), F.count_if(F.col("status") != "completed").alias("providers_failed")),
        attempts.agg(
            F.count(F.lit(1)).alias("network_attempts"), F.count_if(rotated).alias("proxy_rotations"),
            F.count_if(F.col("endpoint_id").isNull()).alias("direct_attempts")),
        endpoints.agg(F.count_if(F.col("status") == "cooldown").alias("cooldowns")),
    ]
    out = None
    for df in counts:
        rows = df.unpivot([], df.columns, "name", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def pool_endpoint_counts(pools: DataFrame, endpoints: DataFrame) -> DataFrame:
    sizes = endpoints.groupBy(F.col("pool_id").alias("id")).agg(F.count(F.lit(1)).alias("endpoints"))
    return pools.join(sizes, "id", "left").withColumn("endpoints", F.coalesce("endpoints", F.lit(0)))


def endpoint_status(endpoints: DataFrame, pools: DataFrame, pool_name: str | None = None) -> DataFrame:
    chosen = pools.select(F.col("id").alias("pool_id"), F.col("name").alias("pool"))
    if pool_name is not None:
        chosen = chosen.filter(F.col("pool") == pool_name)
    return (
        endpoints.join(chosen, "pool_id")
        .select("pool", "uri", "protocol", "dns_mode", "status", "success_count", "failure_count",
                F.col("secret_ref").isNotNull().alias("has_secret"))
        .orderBy("pool", "uri")
    )


def eligible_endpoints(
    endpoints: DataFrame, leases: DataFrame, now: Column, protocol: str | None = None, excluded: DataFrame | None = None
) -> DataFrame:
    """Usable status, cooldown over, compatible protocol, not excluded, fewer active leases than allowed."""
    usable = endpoints.filter(
        ~F.col("status").isin(fv.UNUSABLE_ENDPOINT_STATUS)
        & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now))
    )
    if protocol == "socks5":
        usable = usable.filter(F.col("protocol").isin("socks5", "socks5_host"))
    elif protocol == "socks5_host":
        usable = usable.filter((F.col("protocol") == "socks5_host") & (F.col("dns_mode") == "remote"))
    elif protocol:
        usable = usable.filter(F.col("protocol") == protocol)
    active = (
        leases.filter(F.col("released_at").isNull() & (F.col("expires_at") > now))
        .groupBy(F.col("endpoint_id").alias("id")).agg(F.count(F.lit(1)).alias("active_leases"))
    )
    out = usable.join(active, "id", "left").withColumn("active_leases", F.coalesce("active_leases", F.lit(0)))
    out = out.filter(F.col("active_leases") < F.col("max_concurrency"))
    if excluded is not None:
        out = out.join(excluded.select("id"), "id", "left_anti")
    return out


def reset_endpoints(endpoints: DataFrame, pools: DataFrame, pool_name: str | None = None) -> DataFrame:
    """Endpoints of one pool (or of all) back to `unknown`. An unknown pool name is an error, never "all"."""
    chosen = pools.select(F.col("id").alias("pool_id"), F.col("name").alias("__name"))
    if pool_name is not None:
        chosen = chosen.filter(F.col("__name") == pool_name)
        if chosen.isEmpty():
            raise ValueError(f"unknown pool: {pool_name}")
    return endpoints.join(chosen.select("pool_id"), "pool_id", "left_semi").select(endpoints.columns).withColumns({
        "status": F.lit("unknown"), "consecutive_failures": F.lit(0), "cooldown_until": F.lit(None).cast("timestamp"),
    })
